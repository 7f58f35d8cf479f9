"""Evaluation of predictions against labels, and score summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Two rows (label, pred_0, pred_1), zeros filled in, from one aggregation."""
    y, p = F.col(truth).cast("int"), F.col(predicted).cast("int")

    def cell(t: int, q: int) -> Column:
        return F.count_if((y == t) & (p == q))

    wide = df.agg(*[cell(t, q).alias(f"c{t}{q}") for t in (0, 1) for q in (0, 1)])
    rows = [
        F.struct(F.lit(t).alias("label"), F.col(f"c{t}0").alias("pred_0"), F.col(f"c{t}1").alias("pred_1"))
        for t in (0, 1)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _ratio(a: Column, b: Column) -> Column:
    # A ratio without cases counts as 0.
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg with precision, recall, f1 and support."""
    y, p = F.col(truth).cast("int"), F.col(predicted).cast("int")
    counts = df.agg(
        *[F.count_if((y == t) & (p == q)).cast("double").alias(f"c{t}{q}") for t in (0, 1) for q in (0, 1)])
    per_class = counts
    for t in (0, 1):
        hit, support = F.col(f"c{t}{t}"), F.col(f"c{t}0") + F.col(f"c{t}1")
        called = F.col(f"c0{t}") + F.col(f"c1{t}")
        per_class = per_class.withColumns({
            f"s{t}": support, f"p{t}": _ratio(hit, called), f"r{t}": _ratio(hit, support)})
        per_class = per_class.withColumn(
            f"f{t}", _ratio(2 * F.col(f"p{t}") * F.col(f"r{t}"), F.col(f"p{t}") + F.col(f"r{t}")))
    total = F.col("s0") + F.col("s1")
    accuracy = _ratio(F.col("c00") + F.col("c11"), total)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("bigint").alias("support"))

    def mean(c: str) -> Column:
        return (F.col(f"{c}0") + F.col(f"{c}1")) / 2

    def weighted(c: str) -> Column:
        return _ratio(F.col(f"{c}0") * F.col("s0") + F.col(f"{c}1") * F.col("s1"), total)

    none = F.lit(None).cast("double")
    rows = [row(str(t), F.col(f"p{t}"), F.col(f"r{t}"), F.col(f"f{t}"), F.col(f"s{t}")) for t in (0, 1)]
    rows.append(row("accuracy", none, none, accuracy, total))
    rows.append(row("macro avg", mean("p"), mean("r"), mean("f"), total))
    rows.append(row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total))
    return per_class.select(F.inline(F.array(*rows)))


def score_distribution(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """One row: mean, population deviation, min and max of the scores."""
    return df.agg(
        F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def detected_share(df: DataFrame, predicted: str = "is_anomaly") -> DataFrame:
    """One row: rows, rows called anomalous, and their share in percent."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(predicted)).alias("n_detected"))
    share = _ratio(F.col("n_detected") * 100.0, F.col("n_rows"))
    return counts.withColumn("detected_pct", share)
