import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash with those used inside."""
    passage = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree and count every single step it takes"
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " + passage, "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\x0b ", "de", "b", 5),
        (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " + passage, "en", "a", 5),
        (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " + passage, "en", "a", 5),
        (None, "ünï 中文 text 😀 with a.b@c.de and 10.0.0.1", "de", None, 1),
        (7, "word " * 60_000 + "end", "fr", "b", 300_003),
        (8, (passage + "\n") * 4 + "A short line\n\n", "en", "b", 7),
        (9, passage.upper() + "\n  " + passage + " ", "es", "c", 7),
        (10, "x<|endoftext|>y don't we'll  \n\n z", "en", "", 7),
        (11, passage, "en", "c", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("mix", "ledger", "cid", "n", "key", "a", "b", "home", "place", "size", "keeper", "places", "shard", "target"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
