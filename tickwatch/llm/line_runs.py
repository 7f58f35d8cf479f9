"""Line deduplication over levelled sorted runs of line keys.

A run is a Parquet table of (line_key, docs), bucketed and sorted by the key. A
batch of documents counts its own keys, merge-anti-joins the runs (keys that
already reached the limit need no further counting) and adds what is left as a
run of level 0. When a level holds `fanout` runs they are merged into one run of
the next level, so a store of n batches has about fanout * log(n) runs. With
`limit=1` a store keeps first occurrences: the anti-join then lets through only
lines no earlier batch had.

The number of buckets follows from the number of keys of the corpus and is the same
for all its runs. Runs that were merged are dropped with the next batch, all others when
the store is closed: neither tables nor files stay.

Keys are 128-bit hashes of a line stripped of ASCII white space with A-Z in
lower case. A row of the table is a document; repeated rows count each. Null and
empty texts are one empty line. A null doc_id is an id like any other. Long texts are
split whole; further columns are passed on or ignored; an empty table gives no rows.
"""

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm.common import SPACES, id_key, slices, texts
from tickwatch.session import delete_path, scratch_path, ship_package, stage

BATCHES = 4
FANOUT = 3
# At least so many buckets; more where one would hold more keys than this.
BUCKETS, BUCKET_KEYS = 16, 2_000_000
MIN_DOCS = 10
_SPACES = SPACES.encode()


def line_key(line: bytes) -> bytes:
    return xxhash.xxh128_digest(line.strip(_SPACES).lower())


def _distinct_keys(text: bytes, min_chars: int) -> list[bytes]:
    kept = set()
    for line in text.split(b"\n"):
        line = line.strip(_SPACES)
        if len(line) >= min_chars and (min_chars < 2 or len(line.decode("utf-8", "replace")) >= min_chars):
            kept.add(xxhash.xxh128_digest(line.lower()))
    return sorted(kept)


def document_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, line_key: every row's distinct keys of at least `min_chars` code points."""
    ship_package(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, doc_id = batch.column("text").cast(pa.binary()), batch.column("doc_id")
            for start, end in slices(text):
                found = [_distinct_keys(t.as_py(), min_chars) for t in text[start:end]]
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                ids = doc_id.take(pa.array(np.repeat(np.arange(start, end), sizes)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([k for keys in found for k in keys], pa.binary())], ["doc_id", "line_key"])

    return texts(docs).mapInArrow(extract, "doc_id long, line_key binary")


class Run(NamedTuple):
    """A bucketed table, its name and the folder of its files."""

    table: DataFrame
    name: str
    path: str


def bucket_count(keys: int) -> int:
    return max(BUCKETS, -(-keys // BUCKET_KEYS))


class LineRuns:
    """The runs of one corpus, level by level; a context that drops them at its end."""

    def __init__(self, spark: SparkSession, limit: int, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.limit, self.fanout, self.buckets = spark, limit, fanout, buckets
        self.levels: list[list[Run]] = []
        # Merged runs: plans that read them may still be in use until the next batch.
        self.merged: list[Run] = []

    def __enter__(self) -> "LineRuns":
        return self

    def __exit__(self, *error) -> None:
        self._drop([run for level in self.levels for run in level])
        self._drop(self.merged)
        self.levels, self.merged = [], []

    def _drop(self, runs: list[Run]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
            delete_path(self.spark, run.path)

    def _write(self, rows: DataFrame) -> Run:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        (rows.repartition(self.buckets, "line_key").write.format("parquet")
         .option("path", path)
         .bucketBy(self.buckets, "line_key").sortBy("line_key").saveAsTable(name))
        return Run(self.spark.table(name), name, path)

    def runs(self) -> list[DataFrame]:
        return [run.table for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Count a batch of keys (column line_key) and return the run it added, good until the next batch."""
        self._drop(self.merged)
        self.merged = []
        batch = keys.groupBy("line_key").agg(F.count(F.lit(1)).alias("docs"))
        for run in self.runs():
            full = run.filter(F.col("docs") >= self.limit).select("line_key")
            batch = batch.join(full.hint("merge"), "line_key", "left_anti")
        if not self.levels:
            self.levels.append([])
        run = self._write(batch)
        self.levels[0].append(run)
        self._compact()
        return run.table

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(self._total(level)))
            self.merged += level
            level.clear()

    def _total(self, runs: list[Run]) -> DataFrame:
        # Read as plain files: a union of bucketed tables claims their partitioning, but its columnar
        # form appends partitions instead of pairing them, and equal keys would not meet.
        rows = self.spark.read.schema("line_key binary, docs long").parquet(*[run.path for run in runs])
        return rows.groupBy("line_key").agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame:
        """line_key of the keys that reached the limit."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "line_key binary")
        return self._total(runs).filter(F.col("docs") >= self.limit).select("line_key")


def frequent_line_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1,
                       batches: int = BATCHES) -> DataFrame:
    """doc_id and the distinct keys, among its own, that at least `min_docs` documents have."""
    keys = stage(document_keys(docs, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64(id_key("doc_id")), F.lit(batches))), "line-keys")
    with LineRuns(docs.sparkSession, min_docs, buckets=bucket_count(keys.count())) as store:
        for i in range(batches):
            store.add(keys.filter(F.col("batch") == i).select("line_key"))
        # A key that a third of all documents have makes a large partition of the join below. It is split at run
        # time, which needs two plain exchanges below the join; so the frequent keys are written first.
        frequent = stage(store.frequent(), "frequent-lines")
    return (keys.join(frequent, "line_key")
            .groupBy(id_key("doc_id").alias("id")).agg(F.collect_set("line_key").alias("frequent")))


def _rewrite(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, frequent in batches:
        text = text.cast(pa.binary())
        for start, end in slices(text):
            sizes, kept = [], []
            for t, keys in zip(text[start:end], frequent[start:end]):
                lines, drop = t.as_py().split(b"\n"), set(keys.as_py() or ())
                left = [x for x in lines if line_key(x) not in drop] if drop else lines
                sizes.append((len(lines), len(lines) - len(left)))
                kept.append(b"\n".join(left))
            n_lines, n_dropped = zip(*sizes)
            yield pa.StructArray.from_arrays(
                [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())],
                ["n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES,
                keep: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without frequent lines); with `keep` also `row`, the input row.

    A line goes from every document when its key occurs in `min_docs` documents
    or more; lines with shorter keys stay. An empty table gives no rows.
    """
    rewrite = F.arrow_udf(_rewrite, "n_lines long, n_dropped long, kept string")
    frequent = frequent_line_keys(docs, min_docs, min_chars, batches)
    row = [F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")] if keep else []
    rows = docs.select(id_key(docs["doc_id"].cast("long")).alias("id"), docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"), *row)
    out = rows.join(frequent, "id", "left").withColumn("r", rewrite("text", "frequent"))
    return out.select("doc_id", "r.n_lines", "r.n_dropped", "r.kept", *(["row"] if keep else []))
