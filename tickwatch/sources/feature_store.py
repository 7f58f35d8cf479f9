"""The feature store: Parquet partitioned by symbol, and the same rows compacted.

A stream leaves a file per symbol and task with every micro-batch. `compact` copies
the files it has not copied yet into few larger ones, sorted by time, and writes a
manifest: the files that count now, each with its first and last window, and the
store's files that they replace. Manifests are numbered and never changed; the one
with the highest number holds. A reader takes one manifest and the store's files that
it does not name, so it sees the rows as they were before a compaction or after it.
"""

import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickwatch.schema import COMPAT, FEATURE, MANIFEST
from tickwatch.session import children, delete_path, is_missing, partition_numbers

# Rows of a compacted file, and how many files of a symbol may be smaller before they are merged.
FILE_ROWS = 5_000_000
FANOUT = 8
# Files of earlier manifests are kept for readers that still use them.
KEEP_MANIFESTS = 2


def write_features(features: DataFrame, path: str, mode: str = "append") -> None:
    features.write.mode(mode).partitionBy("symbol").parquet(path)


def feature_sink(features: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once append of finished windows; call .start() on the result."""
    return (
        features.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("symbol")
    )


def read_compat(spark: SparkSession, path: str) -> DataFrame:
    """A store of the seven model columns alone, with a `row_key` that identifies a row within its symbol.

    The key is the row's file and place in it, so it does not change when files are
    added. (Files of one write share their names across symbols.)
    """
    rows = spark.read.schema(COMPAT).parquet(path)
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return rows.select(*COMPAT.names, place.alias("row_key"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All feature files below `path`; zero-byte files are skipped, none at all is an error."""
    try:
        found = spark.read.schema(FEATURE).parquet(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        raise FileNotFoundError(f"no feature files in {path}") from error
    if found.isEmpty() and not found.inputFiles():
        raise FileNotFoundError(f"no feature files in {path}")
    return found.select(*FEATURE.names)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The store's files; a stream's own log decides which of them count."""
    try:
        return sorted(map(unquote, spark.read.schema(FEATURE).parquet(path).inputFiles()))
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return []


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows (MANIFEST) of the manifest that holds; None before the first compaction."""
    numbers = _whole_manifests(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}.manifests/number={numbers[-1]}") if numbers else None


def _whole_manifests(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}.manifests"
    return [n for n in partition_numbers(spark, folder, "number") if "_SUCCESS" in children(spark, f"{folder}/number={n}")]


def _read(spark: SparkSession, files: list[str], base: str) -> DataFrame:
    if not files:
        return spark.createDataFrame([], FEATURE)
    return spark.read.schema(FEATURE).option("basePath", base).parquet(*files).select(*FEATURE.names)


def _overlaps(since: datetime | None, until: datetime | None) -> Column:
    inside = F.lit(True)
    if since is not None:
        inside = inside & (F.col("last_window") >= F.lit(since))
    if until is not None:
        inside = inside & (F.col("first_window") < F.lit(until))
    return inside


def read_store(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """All rows whose window starts in [since, until), each once; compacted files of other times are not opened."""
    held = manifest(spark, path)
    covered: set[str] = set()
    chosen: list[str] = []
    if held is not None:
        covered = {r["file"] for r in held.where("kind = 'covered'").select("file").collect()}
        wanted = held.where((F.col("kind") == "compacted") & _overlaps(since, until))
        chosen = sorted(r["file"] for r in wanted.select("file").collect())
    fresh = [f for f in _files(spark, path) if f not in covered]
    if held is None and not fresh:
        raise FileNotFoundError(f"no feature files in {path}")
    rows = _read(spark, chosen, f"{path}.compacted").unionByName(_read(spark, fresh, path))
    if since is not None:
        rows = rows.where(F.col("window_start") >= F.lit(since))
    return rows.where(F.col("window_start") < F.lit(until)) if until is not None else rows


def compact(spark: SparkSession, path: str, file_rows: int = FILE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """Copy new files into larger ones and merge small ones; the new manifest's compacted files.

    New rows are sorted by symbol and time into files of about `file_rows` rows. A symbol's
    small files are merged once it has `fanout` of them, so a row is rewritten a
    number of times that grows with the logarithm of the table, and the number of files
    with its size alone. One compaction runs at a time.
    """
    held = manifest(spark, path)
    old = held.collect() if held is not None else []
    covered = {r["file"] for r in old if r["kind"] == "covered"}
    kept = [r for r in old if r["kind"] == "compacted"]
    fresh = [f for f in _files(spark, path) if f not in covered]
    small: dict[str, list] = {}
    for r in kept:
        if r["n_rows"] < file_rows // 2:
            small.setdefault(r["symbol"], []).append(r)
    merged = [r for rows in small.values() if len(rows) >= fanout for r in rows]
    rows = _read(spark, fresh, path).unionByName(_read(spark, [r["file"] for r in merged], f"{path}.compacted"))
    total = rows.count()
    if total:
        target = f"{path}.compacted/write={uuid.uuid4().hex}"
        parts = max(1, -(-total // file_rows))
        sorted_rows = rows.repartitionByRange(parts, "symbol", "window_start").sortWithinPartitions("symbol", "window_start")
        sorted_rows.write.partitionBy("symbol").parquet(target)
        made = spark.read.schema(FEATURE).parquet(target).groupBy("symbol", F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("window_start").alias("first_window"),
            F.max("window_start").alias("last_window")).collect()
    else:
        made = []
    gone = {r["file"] for r in merged}
    entries = [("compacted", r["symbol"], unquote(r["file"]), r["n_rows"], r["first_window"], r["last_window"])
               for r in [r for r in kept if r["file"] not in gone] + made]
    entries += [("covered", None, f, None, None, None) for f in sorted(covered | set(fresh))]
    numbers = _whole_manifests(spark, path)
    number = (numbers[-1] if numbers else 0) + 1
    new = spark.createDataFrame(entries, MANIFEST)
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}.manifests/number={number}")
    _forget(spark, path, numbers + [number])
    return manifest(spark, path).where("kind = 'compacted'")


def _forget(spark: SparkSession, path: str, numbers: list[int]) -> None:
    """Delete manifests but the last ones, and compacted files that none of these names."""
    old, new = numbers[:-KEEP_MANIFESTS], numbers[-KEEP_MANIFESTS:]
    if not old:
        return

    def names(which: list[int]) -> set[str]:
        tables = [spark.read.schema(MANIFEST).parquet(f"{path}.manifests/number={n}") for n in which]
        return {r["file"] for t in tables for r in t.where("kind = 'compacted'").select("file").collect()}

    for file in names(old) - names(new):
        delete_path(spark, file)
    for number in old:
        delete_path(spark, f"{path}.manifests/number={number}")
