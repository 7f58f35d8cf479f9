"""Statistics and chart series over predictions.

Every function takes a whole prediction table or the recent view. Those that
need an order or exact quantiles take `bounded=True` for inputs known to be
small (the view of at most 500 rows), where one plain window or one built-in
percentile is the better plan.
"""

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.functions.columns import alert_text, display_text, is_finite
from tickwatch.operators.ordered import scan_in_order, trailing_mean
from tickwatch.operators.quantiles import quantiles, quantiles_approx, quantiles_bounded
from tickwatch.schema import FEATURES

SCORE = "anomaly_score"
PERCENTILES = [25, 50, 75, 95, 99]
TREND_WIDTH = 20
HEATMAP_WIDTH = 10
HISTOGRAM_BINS = 30


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def totals(predictions: DataFrame) -> DataFrame:
    """One row: predictions, anomalies, rate in percent, mean score; zeros when empty."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.round(_rate(F.count_if("is_anomaly"), F.count(F.lit(1))), 2).alias("anomaly_rate"),
        F.round(F.coalesce(F.avg(SCORE), F.lit(0.0)), 6).alias("avg_score"),
    )


def per_symbol(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.round(_rate(F.count_if("is_anomaly"), F.count(F.lit(1))), 2).alias("anomaly_rate"),
        F.round(F.avg(SCORE), 6).alias("avg_score"),
    )


def per_symbol_long(predictions: DataFrame) -> DataFrame:
    """Rows (symbol, series, value) with the series Total and Anomalies."""
    return per_symbol(predictions).select(
        "symbol", F.col("count").alias("Total"), F.col("anomalies").alias("Anomalies")
    ).unpivot("symbol", ["Total", "Anomalies"], "series", "value")


def _quantiles(df, value, probs, by=None, method="exact", rows_per_range=None):
    if method == "bounded":
        return quantiles_bounded(df, value, probs, by)
    if method == "approx":
        return quantiles_approx(df, value, probs, by)
    return quantiles(df, value, probs, by, rows_per_range)


def score_percentiles(
    predictions: DataFrame, method: str = "exact", rows_per_range: int | None = None
) -> DataFrame:
    """One row p25, p50, p75, p95, p99. method: exact, bounded (small input) or approx."""
    rows = _quantiles(predictions, SCORE, [p / 100 for p in PERCENTILES], None, method, rows_per_range)
    return rows.agg(*[
        F.round(F.max(F.when(F.round(F.col("prob") * 100) == p, F.col("quantile"))), 6).alias(f"p{p}")
        for p in PERCENTILES
    ])


def _feature_rows(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    entries = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in names])
        for i, c in enumerate(FEATURES)
    ]
    return wide.select(F.inline(F.array(*entries)))


def feature_stats(predictions: DataFrame) -> DataFrame:
    """Rows (feature, mean, std, min, max) with the population deviation, from one pass."""
    wide = predictions.agg(*[
        F.round(f(c), 6).alias(f"{name}_{i}")
        for i, c in enumerate(FEATURES)
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ])
    return _feature_rows(wide, ("mean", "std", "min", "max"))


def stats(predictions: DataFrame) -> DataFrame:
    """The nested answer in one row: totals, per_symbol map, score_percentiles, feature_stats map.

    For the recent view: it keeps one buffer per percentile and one map entry per symbol.
    """
    by_symbol = per_symbol(predictions).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "symbol", F.struct("count", "anomalies", "anomaly_rate", "avg_score")))).alias("m"))
    by_feature = feature_stats(predictions).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "feature", F.struct("mean", "std", "min", "max")))).alias("m"))
    points = score_percentiles(predictions, method="bounded")
    percentiles = points.select(F.struct(*points.columns).alias("s"))
    filled = F.col("total_predictions") > 0
    return totals(predictions).select(
        "*",
        by_symbol.scalar().alias("per_symbol"),
        F.when(filled, percentiles.scalar()).alias("score_percentiles"),
        F.when(filled, by_feature.scalar()).alias("feature_stats"),
    )


def feature_correlation(predictions: DataFrame) -> DataFrame:
    """Rows (feature_x, feature_y, correlation) for all 25 pairs, from one pass.

    Written out of covariance and deviations, as the built-in corr fails on a
    constant column under ANSI rules; such a pair is null here.
    """
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    aggs = []
    for i, j in pairs:
        both = F.col(FEATURES[i]).isNotNull() & F.col(FEATURES[j]).isNotNull()
        x, y = F.when(both, F.col(FEATURES[i])), F.when(both, F.col(FEATURES[j]))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggs.append(F.try_divide(F.covar_pop(x, y), spread).alias(f"r{i}{j}"))
    wide = predictions.agg(*aggs)
    entries = [
        F.struct(
            F.lit(FEATURES[i]).alias("feature_x"), F.lit(FEATURES[j]).alias("feature_y"),
            F.col(f"r{min(i, j)}{max(i, j)}").alias("correlation"))
        for i, j in product(range(len(FEATURES)), repeat=2)
    ]
    return wide.select(F.inline(F.array(*entries)))


def score_histogram(predictions: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between the lowest and highest score; empty bins are listed too."""
    scores = predictions.select(SCORE).where(F.col(SCORE).isNotNull())
    edges = scores.agg(F.struct(F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi")).alias("e")).scalar()
    width = F.col("_e.hi") - F.col("_e.lo")
    place = F.floor(F.try_divide((F.col(SCORE) - F.col("_e.lo")) * bins, width))
    counted = (
        scores.withColumn("_e", edges)
        .select(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.coalesce(place, F.lit(0)))).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    )
    all_bins = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = all_bins.join(counted, "bin", "left").withColumn("_e", edges)
    return filled.select(
        "bin",
        (F.col("_e.lo") + width * F.col("bin") / bins).alias("bin_low"),
        (F.col("_e.lo") + width * (F.col("bin") + 1) / bins).alias("bin_high"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"),
    )


def feature_box_stats(
    predictions: DataFrame, method: str = "exact", rows_per_range: int | None = None
) -> DataFrame:
    """Per feature and class: quartiles, mean and whiskers (the last values within 1.5 IQR).

    Values that are null, NaN or infinite and rows without a class are left out of all of them.
    """
    long = predictions.select("is_anomaly", *FEATURES).unpivot("is_anomaly", FEATURES, "feature", "value")
    long = long.where(is_finite("value") & F.col("is_anomaly").isNotNull())
    by = ["feature", "is_anomaly"]
    rows = _quantiles(long, "value", [0.25, 0.5, 0.75], by, method, rows_per_range)

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("quantile")))

    box = rows.groupBy(*by).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col("value").between(low, high)
    # At most two classes times five features: the box table has ten rows.
    return long.join(F.broadcast(box), by).groupBy(*by, "q1", "median", "q3").agg(
        F.avg("value").alias("mean"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
    )


def class_breakdown(predictions: DataFrame) -> DataFrame:
    """Always two rows: Normal and Anomaly. Rows without a score are neither."""
    wide = predictions.where(F.col("is_anomaly").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("a"))
    rows = [
        F.struct(F.lit("Normal").alias("class"), (F.col("n") - F.col("a")).alias("n")),
        F.struct(F.lit("Anomaly").alias("class"), F.col("a").alias("n")),
    ]
    return wide.select(F.inline(F.array(*rows)))


def kpis(view: DataFrame) -> DataFrame:
    """One row of unrounded figures and their display texts."""
    row = view.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomalies"),
        _rate(F.count_if("is_anomaly"), F.count(F.lit(1))).alias("rate"),
        F.avg(SCORE).alias("avg_score"),
    )
    return row.select(
        "*",
        F.format_string("%,d", "total").alias("total_text"),
        F.format_string("%,d", "anomalies").alias("anomalies_text"),
        F.format_string("%.1f%%", "rate").alias("rate_text"),
        F.format_string("%.4f", "avg_score").alias("avg_score_text"),
    )


def _numbered(df: DataFrame, name: str, by: list[str], bounded: bool, rows_per_range: int) -> DataFrame:
    if bounded:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("seq")).cast("bigint") - 1)
    return scan_in_order(df, by, ["seq"], position=name, rows_per_range=rows_per_range)


def score_timeline(
    predictions: DataFrame, bounded: bool = False, rows_per_range: int | None = None
) -> DataFrame:
    """Rows (position, anomaly_score, anomaly_marker) in arrival order."""
    rows = _numbered(predictions.select("seq", SCORE, "is_anomaly"), "position", [], bounded, rows_per_range)
    return rows.select("position", SCORE, F.when(F.col("is_anomaly"), F.col(SCORE)).alias("anomaly_marker"))


def score_trend(
    predictions: DataFrame, width: int = TREND_WIDTH, bounded: bool = False,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows (position, anomaly_score, moving_avg) over the last `width` scores, from the first row on."""
    rows = _numbered(predictions.select("seq", SCORE), "position", [], bounded, rows_per_range)
    return trailing_mean(rows, SCORE, "position", "moving_avg", width, block_rows=rows_per_range).drop("seq")


def score_heatmap(
    predictions: DataFrame, width: int = HEATMAP_WIDTH, bounded: bool = False,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows (symbol, bin, avg_score): the mean of every `width` consecutive scores of a symbol."""
    rows = _numbered(predictions.select("symbol", "seq", SCORE), "position", ["symbol"], bounded, rows_per_range)
    return rows.groupBy("symbol", F.floor(F.col("position") / width).alias("bin")).agg(
        F.avg(SCORE).alias("avg_score"))


def heatmap_pivot(heatmap: DataFrame, n_bins: int) -> DataFrame:
    """The heatmap of a view as one column per bin (T0, T1, ...)."""
    named = heatmap.withColumn("bin", F.concat(F.lit("T"), F.col("bin")))
    return named.groupBy("symbol").pivot("bin", [f"T{i}" for i in range(n_bins)]).agg(F.first("avg_score"))


def alerts(view: DataFrame) -> DataFrame:
    return view.select("seq", alert_text(
        "symbol", SCORE, "z_score_price", "z_score_log_return", "z_score_volume").alias("alert"))


def display_table(view: DataFrame) -> DataFrame:
    """Every column as its display text."""
    return view.select(*[display_text(name, kind).alias(name) for name, kind in view.dtypes])
