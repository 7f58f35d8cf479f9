"""Versioned model tables: scaler, nodes and meta.

The three tables share the model_version partition. Meta is written last, so a
version is visible only once it is whole.
"""

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.operators.forest import NODES_AT_ONCE, ForestModel
from tickwatch.operators.split import SplitRule, row_hash
from tickwatch.schema import FEATURES, META, NODES, SCALER, SPLIT
from tickwatch.session import is_missing


def _write(df: DataFrame, version: str, path: str, whole: bool = True) -> None:
    marked = df.withColumn("model_version", F.lit(version))
    (
        (marked.coalesce(1) if whole else marked)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_version").parquet(path)
    )


def save_model(spark: SparkSession, model: ForestModel, path: str) -> None:
    """Write the model under its version; saving the same version again replaces it."""
    scaler = spark.createDataFrame(model.scaler_rows(), SCALER)
    large = isinstance(model.nodes, DataFrame)
    nodes = model.nodes.select(*NODES.names) if large else spark.createDataFrame(model.nodes[NODES.names], NODES)
    meta = spark.createDataFrame([model.meta_row()], META).drop("model_version")
    now = datetime.datetime.now(datetime.timezone.utc)
    _write(scaler, model.version, f"{path}/scaler")
    _write(nodes, model.version, f"{path}/nodes", not large)
    _write(meta.withColumn("saved_at", F.lit(now)), model.version, f"{path}/meta")


def _meta(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _table(spark, f"{path}/meta", META.fields + [T.StructField("saved_at", T.TimestampType())])
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return None


def _table(spark: SparkSession, path: str, fields: list[T.StructField]) -> DataFrame:
    """A model table with its version as text: as a number, 1.0 and 1.00 would be one version."""
    schema = T.StructType([f for f in fields if f.name != "model_version"] + [T.StructField("model_version", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def latest_version(spark: SparkSession, path: str) -> str | None:
    meta = _meta(spark, path)
    if meta is None:
        return None
    row = meta.agg(F.max_by("model_version", F.struct("saved_at", "model_version")).alias("v")).first()
    return row["v"]


def load_model(spark: SparkSession, path: str, version: str | None = None) -> ForestModel | None:
    """The given or latest version; None where there is no model yet."""
    version = version or latest_version(spark, path)
    if version is None:
        return None
    chosen = F.col("model_version") == version
    meta = _meta(spark, path).where(chosen).first()
    if meta is None:
        return None
    scaler = _table(spark, f"{path}/scaler", SCALER.fields).where(chosen).orderBy("position").collect()
    nodes = _table(spark, f"{path}/nodes", NODES.fields).where(chosen).select(*NODES.names)
    return ForestModel(
        nodes=nodes.toPandas() if nodes.count() <= NODES_AT_ONCE else nodes,
        means=[row["mean"] for row in scaler],
        scales=[row["scale"] for row in scaler],
        psi=meta["psi"], contamination=meta["contamination"], offset=meta["offset"],
        seed=meta["seed"], n_train=meta["n_train"], max_samples=meta["max_samples"],
        version=version,
    )


class LatestModel:
    """The newest model of a store, loaded again only when a newer version is there."""

    def __init__(self, path: str):
        self.path, self.model = path, None

    def get(self, spark: SparkSession) -> ForestModel:
        version = latest_version(spark, self.path)
        if version is None:
            raise RuntimeError(f"no model in {self.path}")
        if self.model is None or self.model.version != version:
            self.model = load_model(spark, self.path, version)
        return self.model


def save_split(spark: SparkSession, rule: SplitRule, version: str, path: str) -> None:
    """Keep with a model which rows it must not have seen: a cut-off hash per label value."""
    rows = [(version, str(value), cut, "\0".join(rule.key), rule.seed) for value, cut in rule.cuts.items()]
    _write(spark.createDataFrame(rows, SPLIT).drop("model_version"), version, f"{path}/split")


def load_split(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """The split table (label, cut, keys, seed) of a version; None where it was fitted on all rows."""
    try:
        split = _table(spark, f"{path}/split", SPLIT.fields).where(F.col("model_version") == version).drop("model_version")
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return None
    return None if split.isEmpty() else split


def held_out(rows: DataFrame, split: DataFrame, label: str) -> DataFrame:
    """The rows that a saved split keeps from training, of tables that have grown since as well.

    A row's side follows from its key alone. Label values that the split does not know are left out.
    """
    first = split.select("keys", "seed").first()
    cuts = split.select(F.col("label").alias("_label"), "cut")
    hashed = rows.withColumn("_hash", row_hash(tuple(first["keys"].split("\0")), first["seed"], rows))
    # One row per label value of a classifier's target.
    near = F.col(label).cast("string") == F.col("_label")
    return hashed.join(F.broadcast(cuts), near).where(F.col("_hash") <= F.col("cut")).select(*rows.columns)


def model_files(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One row: total size in KB and last change of a version's files."""
    parts = [
        _table(spark, f"{path}/{name}", fields).where(F.col("model_version") == version)
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        for name, fields in (("scaler", SCALER.fields), ("nodes", NODES.fields), ("meta", META.fields))
    ]
    files = parts[0].union(parts[1]).union(parts[2]).distinct()
    return files.agg(
        F.round(F.sum("file_size") / 1024, 2).alias("model_file_size_kb"),
        F.date_format(F.max("file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .alias("model_file_modified"),
    )


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """One row about the latest model; only loaded = false where there is none."""
    model = load_model(spark, path)
    if model is None:
        return spark.range(1).select(F.lit(False).alias("loaded"))
    files = model_files(spark, path, model.version)
    return files.select(
        F.lit(True).alias("loaded"),
        F.lit("IsolationForest").alias("model_type"),
        F.lit(model.n_estimators).alias("n_estimators"),
        F.lit(model.contamination).alias("contamination"),
        F.lit(model.max_samples).alias("max_samples"),
        F.array(*[F.lit(name) for name in FEATURES]).alias("feature_names"),
        F.array(*[F.round(F.lit(m), 6) for m in model.means]).alias("scaler_means"),
        F.array(*[F.round(F.lit(s), 6) for s in model.scales]).alias("scaler_stds"),
        "model_file_size_kb", "model_file_modified",
    )
