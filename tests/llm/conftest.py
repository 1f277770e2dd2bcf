import pytest

FOLDER = "/root/testdata/sf0.001"
LONG = "one long text with many words and é and " * 6000


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long, repeated and tied rows, with further columns of clashing names."""
    a = " ".join(f"word{i}" for i in range(60))
    rows = [
        (None, a, "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, LONG, "en"), (5, a, "en"), (5, a, "en"),
        (6, a + " tail", "en"), (7, "## $$ !!", "de"), (8, "— … 12 3", "de"), (9, "Ünï \x0b\x1c 🙂漢字", "de"), (10, "a b", "en"),
        (11, "A B", "en"),
    ]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr(
        "*", "'x' as id", "1 as n", "2 as runs", "3 as items", "4 as words", "5 as quality", "6 as lang_pred", "7 as score",
        "'s' as source", "8L as n_chars",
    )


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
