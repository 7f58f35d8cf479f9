"""A corpus pipeline: quality, lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept;
its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.

Null ids, null or empty texts, repeated rows and further columns pass through
every stage: a null text counts as empty, a null id is an id of its own, and the
quality and line stages treat repeated rows alike; of near duplicates, repeated
rows included, the one with the smallest id stays. Empty tables stay empty.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm import line_runs, near_copies, nb_svm, spaced_seeds
from tickwatch.llm.common import id_key, table
from tickwatch.llm.queries import encode_digests
from tickwatch.session import ship_package, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_package(spark)
    model = nb_svm.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(nb_svm.score_column(model, docs["text"]) >= nb_svm.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from all of them; n_chars follows."""
    out = line_runs.dedup_lines(docs, keep=True)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length("kept").cast("long"))}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = stage(spaced_seeds.contamination(docs, table(spark, sf_dir, "benchmark")).select(
        id_key("doc_id").alias("contaminated")).distinct(), "contaminated")
    return docs.join(found, id_key(docs["doc_id"].cast("long")) == found["contaminated"], "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return encode_digests(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("tokens", tokens)]

# A trained classifier and a tokenizer are not SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
