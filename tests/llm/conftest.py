import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with clashing names."""
    long = "wort und satz " * 3000
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "12 34 !!", "en", None, 8), (4, long, "de", "b", len(long)), (4, long, "de", "b", len(long)), (None, "the cat and the dog", "en", "c", 5), (5, "the cat and the dog", "en", "c", 5)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("digest", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("part", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("chunk", F.lit(4))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
