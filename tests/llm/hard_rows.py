import pytest

#: Every operator must stand these: nulls, empty and very long texts, ties, repeated rows, names it might use itself.
LONG = " ".join(f"w{k % 7919}" for k in range(30_000))
HARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 66),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \n\t\x0b ", "en", "b", 5),
    (6, LONG, "en", "b", len(LONG)),
    (7, "Ärger über 漢字 🙂 idiot\nline two\nline two", None, "b", 40),
    (7, "Ärger über 漢字 🙂 idiot\nline two\nline two", None, "b", 40),
    (None, "no id at all but some words to read here today", "en", "a", 46),
    (9, "x", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size", "key", "before", "slot", "kept", "toxic", "terms", "score", "row", "words", "rep", "node", "shard", "old", "position", "target")


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with additional columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(HARD, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
