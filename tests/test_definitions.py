"""Definitions of long files: borders by frames that end at their row, so that a file's lines cost in proportion to their number."""

from siltstone.operators import definitions as D


def test_no_frame_is_read_again_for_every_line(spark):
    text = "import ./x\n\n# loose\n\n# doc\n# more\ndef f(x: Nat,\n    y: (Nat)) -> Nat:\n  g(x)\n\n@unsafe type T: Nat # (\n\n  end\n# trailing\n"
    found = D.extracted(spark.createDataFrame([("a", text), ("b", "# only\n"), ("c", "")], "id string, text string"))
    rows = {r["name"]: r for r in found.collect()}
    assert set(rows) == {"f", "T"}
    f, t = rows["f"], rows["T"]
    assert (f["start"], f["line"], f["end"], f["doc"], f["documented"]) == (5, 7, 9, "# doc\n# more", True)
    assert f["head"] == "def f(x: Nat,\n    y: (Nat)) -> Nat:" and (t["start"], t["line"], t["end"], t["documented"]) == (11, 11, 14, False)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
