"""Column functions on text against the rules' examples and plain models."""

import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import signatures
from siltstone.functions import text as T


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_tokens(spark):
    got = values(spark, T.tokens(F.col("t")), "box.i64be", "XMLReader", "+Z: Sort(q)", "so it is.", "", "k-M_n")
    assert got == [["box.i64be", "box", "i64be", "i64", "be"], ["xmlreader", "xml", "reader"], ["z", "sort", "q"], ["so", "it", "is"], [], ["k-m_n", "k", "m", "n"]]


def test_singular(spark):
    assert values(spark, T.singular(F.col("t")), "queries", "boxes", "words", "gas", "s", "pies") == ["query", "box", "word", "gas", "s", "pies"]


def test_sets(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [tuple(r) for r in rows.select(T.jaccard(F.col("x"), F.col("y")), T.share(F.col("x"), F.col("y"))).collect()] == [(1 / 3, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_lines(spark):
    assert values(spark, T.lines(F.col("t")), "a\r\nb\n", "", "\n", "a\n\nb", "a\x0bb") == [["a", "b"], [], [""], ["a", "", "b"], ["a\x0bb"]]


def test_versions_sort_by_number(spark):
    rows = spark.createDataFrame([("2.8.1",), ("2.11.0",)], "v string")
    assert rows.orderBy(T.version_order(F.col("v")).desc()).first()[0] == "2.11.0"


def test_names(spark):
    assert values(spark, T.parent_name(F.col("t")), "a.b.c", "a") == ["a.b", None]
    assert values(spark, T.last_part(F.col("t")), "a.b.c", "a") == ["c", "a"]
    assert values(spark, T.alias(F.lit("fast-hash-map"), F.col("t")), "main", "lib/3way", "lib/__") == ["FastHashMap", "M3way", "P"]


def test_sentences(spark):
    assert values(spark, T.first_sentence(F.col("t")), "Takes 0.5 of a cup. Then more", "Nothing ends here", "Why? So.") == ["Takes 0.5 of a cup.", "Nothing ends here", "Why?"]


def test_wording(spark):
    rows = spark.createDataFrame([(1,), (1234,)], "n int")
    assert [r[0] for r in rows.select(T.counted(F.col("n"), "result")).collect()] == ["1 result", "1,234 results"]
    assert values(spark, T.shortened(F.col("t"), 2), "a\nb\nc", "a") == ["a\nb\n…", "a"]
    assert values(spark, T.balance(T.without_comment(F.col("t"))), "f((x) # ((") == [1]


FOLD = "def Tree.fold(~K: Type, step: K -> Nat -> K, t: Tree<&1, K>, other) -> Pair<K, Nat>: # ends"


def test_signatures():
    assert signatures.of_definition(FOLD) == ([{"T": 2, "Nat": 1}, {"Tree": 1, "T": 1}], {"Pair": 1, "T": 1, "Nat": 1})
    assert signatures.of_definition("# about it\n@unsafe def run()  -> Nat:") == ([], {"Nat": 1})
    assert signatures.of_definition("def f(g: (a: Nat) -> Vec<Nat, 3>, d: Data)") == ([{"a": 1, "Nat": 2, "Vec": 1}], {})
    assert signatures.of_query("some words") is None and signatures.of_query("Map<A -> B, C>") is None and signatures.of_definition("type X") is None
    assert signatures.of_query("K -> Nat -> K, Tree<K> -> Pair<K, Nat>") == signatures.of_definition(FOLD)
    assert signatures.of_query("-> kit/box.Nat") == ([], {"kit": 1, "Nat": 1})


def test_likeness_takes_the_best_left_in_order(spark):
    rows = spark.createDataFrame([("K -> Nat -> K, Tree<K> -> Pair<K, Nat>", FOLD), ("Tree<Nat>, Tree<K> -> Nat", FOLD), ("-> Nat", "def go() -> Nat:"), ("Nat -> Nat", "type X"), ("words", FOLD), (None, None)], "q string, h string")
    like = signatures.likeness(F.col("w"), F.col("f"))
    got = [r[0] for r in rows.select(signatures.asked(F.col("q")).alias("w"), signatures.of_head(F.col("h")).alias("f")).select(like).collect()]
    # Tree<Nat> takes Tree<K> (1 of 3) over the step (1 of 4); Tree<K> then meets the step (1 of 4); the results share 1 of 3
    assert got == [1.0, pytest.approx(((1 / 3 + 1 / 4) / 2 + 1 / 3) / 2), 1.0, 0.0, 0.0, 0.0]


def test_multiset_overlap(spark):
    rows = spark.createDataFrame([({"a": 2, "b": 1}, {"a": 1, "c": 1}), ({}, {})], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in rows.select(signatures.multiset_overlap(F.col("x"), F.col("y"))).collect()] == [0.25, 1.0]


@pytest.mark.parametrize("word", ["ABab12", "aB1b2", "A1b", "ABC", "x__y", "U32le"])
def test_word_tokens_equal_a_plain_model(spark, word):
    part = re.compile(r"[A-Z]+[0-9]*(?![a-z])|[A-Z]?[a-z]+[0-9]*|[0-9]+")
    want = [word.lower()]
    for s in filter(None, re.split("[._-]", word)):
        parts = part.findall(s)
        want += [s.lower()] * (s.lower() != word.lower()) + [p.lower() for p in parts] * (len(parts) > 1)
    assert values(spark, T.word_tokens(F.col("t")), word) == [want]
