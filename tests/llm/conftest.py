import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, a clashing extra column."""
    long = "wörd of many " * 4000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\n ", "en", None, 5), (4, long, "en", "a", len(long)),
        (5, "one two three four five six", "en", "b", 27), (5, "one two three four five six", "en", "b", 27),
        (6, "one two three four five six", None, "c", 27), (None, "mail a@b.org now", "en", "b", 16), (7, "1234 !!", "de", "b", 7),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({"text_2": F.lit("x"), "spans": F.lit(1), "piece": F.lit(2), "host": F.lit("h"), "_pos": F.lit(3)})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
