"""Replacing releases on disk: old or new is seen whole, newer stays, reruns give the same files."""

import os

from pyspark.sql import functions as F

from siltstone.operators import store

ROWS = "key string, users long"


def of(spark, package, version, keys):
    release = f"{package}@{version}"
    return (
        spark.createDataFrame([(package, release, version)], "package string, release string, version string"),
        spark.createDataFrame([(package, release, k, n) for k, n in keys.items()], "package string, release string, key string, users long"),
    )


def seen(kept):
    return {(r["release"], r["key"]): r["users"] for r in kept.read("uses", ROWS).collect()}


def files(folder):
    return sorted(f"{d}/{f}".split("/package=")[1].split("/part-")[0] for d, _, names in os.walk(f"{folder}/uses") for f in names if f.startswith("part-"))


def test_replacement(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    assert seen(kept) == {} and kept.visible().collect() == [] and kept.clean("uses") == 0
    for package, version, keys in (("kit", "1.9", {"a": 1, "b": 2}), ("app", "1.0", {"a": 3})):
        listed, uses = of(spark, package, version, keys)
        kept.replace(listed, uses=uses)
    old = {("kit@1.9", "a"): 1, ("kit@1.9", "b"): 2, ("app@1.0", "a"): 3}
    assert seen(kept) == old
    listed, uses = of(spark, "kit", "1.10", {"a": 5, "c": 1})
    some = kept.stage(listed, uses=uses)  # stopped here: the old release is seen whole
    assert seen(kept) == old and len(files(tmp_path)) == 3
    some = kept.stage(listed, uses=uses)
    kept.swap(some)  # stopped here: the new release is seen whole, the old one's files are still there
    new = {("kit@1.10", "a"): 5, ("kit@1.10", "c"): 1, ("app@1.0", "a"): 3}
    assert seen(kept) == new and len(files(tmp_path)) == 3
    assert kept.clean("uses") == 1 and len(files(tmp_path)) == 2 and seen(kept) == new
    before = files(tmp_path)
    kept.replace(listed, uses=uses)
    assert files(tmp_path) == before and seen(kept) == new
    older = of(spark, "kit", "1.9", {"z": 9})
    assert kept.replace(older[0], uses=older[1]).collect() == [] and seen(kept) == new
    assert {r["key"]: r["users"] for r in store.counted(kept.read("uses", ROWS)).collect()} == {"a": 8, "c": 1}


def test_newest_of_several_and_odd_names(spark, tmp_path):
    kept = store.Store(spark, f"{tmp_path}/deep")
    parts = [of(spark, "a/b:c", v, {v: 1}) for v in ("1.2", "1.10", "1.9")]
    listed = parts[0][0].union(parts[1][0]).union(parts[2][0])
    uses = parts[0][1].union(parts[1][1]).union(parts[2][1])
    kept.replace(listed, uses=uses)
    assert seen(kept) == {("a/b:c@1.10", "1.10"): 1}
    assert kept.clean("uses") == 0
    kept.replace(listed.limit(0), uses=uses.limit(0))
    assert seen(kept) == {("a/b:c@1.10", "1.10"): 1}
    assert kept.read("uses", ROWS).where(F.col("package") != "a/b:c").count() == 0
