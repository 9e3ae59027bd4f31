import pytest

from pyspark.sql import types as T

# Columns whose names clash with those that operators make.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("size", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("spans", T.StringType()),
])
LONG = "long word " * 30_000
TEXTS = [
    (1, "Plain words, nothing else."), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "same text here today"), (7, "same text here today"),
    (7, "same text here today"), (None, "a text without an id"), (9, "Ünïcödé 𝒳 mail ä.b@x-y.example.org!"), (10, " odd\x0bspaces\x00"),
]


def edge_rows():
    return [(i, t, "en", s, None, 0.5, "x", "y", "z") for (i, t), s in zip(TEXTS, ["a", "b", None] * 4)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
