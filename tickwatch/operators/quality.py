"""Validation of feature vectors and removal of incomplete rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.columns import is_finite, json_columns
from tickwatch.schema import FEATURES, LABEL, REQUEST, STD_FEATURES, Z_FEATURES

Z_LIMIT = 100


def read_requests(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON scoring requests as a feature frame; what is not a number becomes null."""
    parsed = messages.select(*keep, json_columns(F.col("value").cast("string"), REQUEST))
    return parsed.select(*keep, "symbol", *[F.col(name).try_cast("double").alias(name) for name in FEATURES])


def _reason(name: str, broken: Column, text: str) -> Column:
    c = F.col(name)
    return (
        F.when(c.isNull(), f"{name}: missing")
        .when(~is_finite(c), f"{name}: not finite")
        .when(broken, f"{name}: {text}")
    )


def with_reject_reasons(features: DataFrame) -> DataFrame:
    """Add reject_reasons: one text per broken rule, an empty array for a valid row."""
    checks = [F.when(F.col("symbol").isNull(), "symbol: missing")]
    checks += [_reason(c, F.abs(F.col(c)) > Z_LIMIT, "out of range") for c in Z_FEATURES]
    checks += [_reason(c, F.col(c) < 0, "negative") for c in STD_FEATURES]
    return features.withColumn("reject_reasons", F.array_compact(F.array(*checks)))


def split_valid(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = with_reject_reasons(features)
    valid = checked.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    return valid, checked.where(F.size("reject_reasons") > 0)


def _required(df: DataFrame) -> list[str]:
    return FEATURES + ([LABEL] if LABEL in df.columns else [])


def drop_incomplete(features: DataFrame) -> DataFrame:
    """Keep rows with all five features, and a label where there is a label column."""
    return features.dropna(subset=_required(features))


def incomplete_report(features: DataFrame) -> DataFrame:
    """One row: rows in, rows kept, rows dropped and their share in percent."""
    complete = F.lit(True)
    for name in _required(features):
        c = F.col(name)
        ok = c.isNotNull() & ~F.isnan(c) if name in FEATURES else c.isNotNull()
        complete = complete & ok
    counts = features.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_kept"))
    dropped = F.col("n_rows") - F.col("n_kept")
    return counts.select(
        "n_rows", "n_kept", dropped.alias("n_dropped"),
        F.coalesce(F.try_divide(dropped * 100.0, F.col("n_rows")), F.lit(0.0)).alias("dropped_pct"),
    )


def design_matrix(features: DataFrame) -> DataFrame:
    """The five features in model order."""
    return features.select(*FEATURES)


def label_summary(features: DataFrame) -> DataFrame:
    """One row: rows, labelled anomalies, their ratio and the training mode."""
    if LABEL not in features.columns:
        counts = features.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_anomalies"))
    else:
        label = F.col(LABEL).cast("int")
        counts = features.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("n_anomalies"))
    return counts.select(
        "n_rows", "n_anomalies",
        F.try_divide(F.col("n_anomalies"), F.col("n_rows")).alias("anomaly_ratio"),
        F.when(F.col("n_anomalies") > 0, "labelled").otherwise("unsupervised").alias("mode"),
    )
