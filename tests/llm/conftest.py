import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["uid", "row", "size", "shard", "slot", "score", "lang_pred", "kept", "target", "times", "id", "base", "terms", "at", "class", "sequence_id", "offset", "length", "word", "n", "new", "bucket", "point"]


def sentence(i: int, n: int = 40) -> str:
    words = ["river", "stone", "light", "paper", "green", "house", "north", "water", "engine", "table", "cloud", "winter", "music", "garden", "silver", "market"]
    return " ".join(words[(i * 7 + k * (i + 3) + k * k) % len(words)] + str((i * 31 + k) % 97) for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows."""
    base = sentence(1)
    rows = [
        (1, base, "en", "a", 10),
        (1, base, "en", "a", 10),
        (2, base, "en", "b", 10),
        (3, base + " extra", "en", None, None),
        (4, None, "de", "a", None),
        (5, "", "de", "b", 0),
        (6, " \n\t ", None, "b", 4),
        (None, sentence(2), None, None, None),
        (None, None, None, None, None),
        (7, "word", "fr", "c", 4),
        (8, "x@y.example.com and +1 (555) 123-4567 met 10.0.0.1 4111 1111 1111 1111", "en", "c", 70),
        (9, " ".join(sentence(i) for i in range(300)), "en", "c", 1),
        (10, "1234 5678 !!! ###", "en", "a", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, SCHEMA)
    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
