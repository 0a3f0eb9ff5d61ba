"""Uses across files and releases on a small library written out by hand."""

import pytest

from siltstone.operators import artifacts

CORE = """type Num is Data:
  None{}
  Next{last: Num}

def Num.plus(a: Num, b: Num) -> Num:
  a
"""
JAR = """import Base

type Jar is Data:
  Jar{content: Num}
  Lid{content: Num}

# Takes the content, not shut.
def take(j: Jar) -> Num:
  j # shut

def take.all(j: Jar) -> Num:
  take(j)
"""
RELEASES = [("base", None, None, None), ("r1", "glass", "1.0", "0xaa"), ("r2", "other", "2.0", "0xbb")]


def found(spark, files, operators=None):
    rows = spark.createDataFrame([("base", "Base", CORE), *files], "release string, module string, text string")
    releases = spark.createDataFrame(RELEASES, "release string, name string, version string, hash string")
    return rows, releases, {(r["release"], r["module"], r["name"]): r for r in artifacts.artifacts(rows, releases, operators).collect()}


def test_uses_inside_a_release_cross_its_files(spark):
    main = "import Base\nimport ./jar.src as J\n\ndef start(x: J.Jar) -> Num:\n  J.take(x)\n"
    rows, releases, got = found(spark, [("r1", "jar", JAR), ("r1", "main", main), ("r1", "main", main)])
    edges = {tuple(r) for r in artifacts.uses(rows, releases)[1].collect()}
    assert edges == {
        ("base", "Base", "Num.plus", "Base", "Num"),
        ("r1", "jar", "take", "jar", "Jar"),
        ("r1", "jar", "take.all", "jar", "Jar"),
        ("r1", "jar", "take.all", "jar", "take"),
        ("r1", "main", "start", "jar", "Jar"),
        ("r1", "main", "start", "jar", "take"),
    }
    assert got["r1", "jar", "Jar"]["users"] == 3 and got["r1", "main", "start"]["users"] == 0 and got["base", "Base", "Num"]["users"] == 1
    assert got["r1", "jar", "take"]["external"] == ["Num"] and got["r1", "jar", "take"]["key"] == "glass/jar:take" and got["r1", "jar", "take"]["documented"]
    assert got["base", "Base", "Num.plus"]["key"] == "Num.plus" and not got["r1", "jar", "Jar"]["documented"]


@pytest.mark.parametrize("label", ["other@2.0", "0xbb"])
def test_uses_beyond_are_keys(spark, label):
    main = f"import Base\nimport {label}/jar.src as J\n\ndef start(x: Num) -> Num:\n  (J.take(J.Lid{{x}}) + None{{}} : Num)\n"
    _, _, got = found(spark, [("r1", "main", main), ("r2", "jar", JAR)], {"+": "Num.plus"})
    assert got["r1", "main", "start"]["external"] == ["Num", "Num.plus", "other/jar:Jar", "other/jar:take"] == got["r1", "main", "start"]["used"]


def test_names_through_several_imports_and_nearest_scope(spark):
    """Through two files; an own definition hides the base's; an import that leads nowhere and a name that nothing has are left out."""
    middle = "import other@2.0/deep/jar.src as J\n\ndef through(x: J.Jar) -> J.Jar:\n  x\n"
    main = "import Base\nimport ../src/middle as M\nimport gone@1.0/x.src as G\n\ndef Num(x: Any) -> Any:\n  x\n\ndef start(x: Num) -> Num:\n  M.J.take(M.through(x), G.lost, M.J.lost, lost, M.J)\n"
    rows, releases, got = found(spark, [("r1", "src/main", main), ("r1", "src/middle", middle), ("r2", "deep/jar", JAR)])
    assert got["r1", "src/main", "start"]["external"] == ["other/deep/jar:take"]
    assert got["r1", "src/main", "start"]["used"] == ["glass/src/main:Num", "glass/src/middle:through", "other/deep/jar:take"]
    ways = {tuple(r) for r in artifacts.imports(rows, releases).where("release = \'r1\'").collect()}
    assert ways == {("r1", "src/main", "", "base", "Base"), ("r1", "src/main", "M", "r1", "src/middle"), ("r1", "src/middle", "J", "r2", "deep/jar")}


def test_files_that_import_each_other_end(spark):
    a, b = "import ./b as B\n\ndef x(n: B.A.B.A.y) -> B.z:\n  n\n\ndef y(n: Num) -> Num:\n  n\n", "import ./a as A\n\ndef z(n: A.x) -> A.B.A.none:\n  n\n"
    _, _, got = found(spark, [("r1", "a", a), ("r1", "b", b)])
    assert {n: r["used"] for (_, _, n), r in got.items() if len(n) == 1} == {"x": ["glass/a:y", "glass/b:z"], "y": [], "z": ["glass/a:x"]}


def test_empty(spark):
    none = spark.createDataFrame([], "release string, module string, text string")
    assert artifacts.artifacts(none, spark.createDataFrame(RELEASES, "release string, name string, version string, hash string")).collect() == []
