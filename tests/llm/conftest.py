import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def small(spark):
    """The rows of the smallest documents table as {doc_id: text}."""
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of texts; columns that clash with the operators' own names come along."""

    def build(rows):
        rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCUMENT)
        for name in ("kept", "id", "fp", "score", "row", "line_key", "key", "words", "a", "b", "entity", "word"):
            df = df.withColumn(name, df["lang"])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    return [(None, None), (None, "one two three four"), (1, ""), (2, " \t\n "), (3, "same text here twice"),
            (4, "same text here twice"), (5, "same text here twice"), (5, "same text here twice"), (6, long),
            (7, "ÄÖ Straße é\x00 \U0001f600 tail"), (8, "a\n\nb\nA \n a")]
