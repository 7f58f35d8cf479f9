"""Windowed features: one definition for batch and stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.columns import arrival_key, z_score
from tickwatch.schema import FEATURES, LABEL

WINDOW = "1 minute"
# What a window describes by mean, deviation, last value and z-score; a further measure is one more entry.
MEASURES = ("price", "log_return", "volume")


def _std(c: str) -> Column:
    # A window of one row has no sample deviation; it counts as 0.
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def latest_key(events: DataFrame) -> Column:
    """The order that decides which event of a window is its last.

    (event_time, event_id), or without an id (event_time, hash of the measures): a
    tie then goes to the same values however rows are read, if not to the last arrival.
    """
    if "event_id" in events.columns:
        return arrival_key("event_time", "event_id")
    return arrival_key("event_time", F.shiftrightunsigned(F.xxhash64(*MEASURES), 1))


def rolling_stats(events: DataFrame, window: str = WINDOW, order_key: Column | None = None) -> DataFrame:
    """Mean, sample deviation and last value of every measure per symbol and tumbling window, and the label.

    The last value is the one of the latest event. `order_key` names that order
    (default `latest_key`). Where each symbol arrives on one ordered channel, its
    BIGINT offset is the cheapest key.
    Partial aggregation shrinks the data before the only shuffle, so a hot
    symbol or window costs no more than any other.
    """
    key = latest_key(events) if order_key is None else order_key
    facts = {}
    for name in MEASURES:
        facts[f"rolling_{name}_mean"] = F.avg(name)
        facts[f"rolling_{name}_std"] = _std(name)
        facts[name] = F.max_by(name, key)
    facts[LABEL] = F.max(F.col(LABEL).cast("int"))
    return events.groupBy("symbol", F.window("event_time", window)).agg(*[c.alias(name) for name, c in facts.items()])


def with_z_scores(stats: DataFrame) -> DataFrame:
    """Add z_score_<measure>: how far the last value lies from its window's mean, in deviations."""
    return stats.withColumns({
        f"z_score_{name}": z_score(name, f"rolling_{name}_mean", f"rolling_{name}_std") for name in MEASURES})


def feature_columns(stats: DataFrame) -> DataFrame:
    """The stored feature row; the window bounds stay so rows keep an identity and order."""
    return stats.select(
        "symbol",
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *FEATURES, LABEL,
    )


def model_view(features: DataFrame) -> DataFrame:
    """The seven columns without the window bounds."""
    return features.select("symbol", *FEATURES, LABEL)


def build_features(events: DataFrame, window: str = WINDOW, order_key: Column | None = None) -> DataFrame:
    return (
        events.transform(rolling_stats, window, order_key)
        .transform(with_z_scores)
        .transform(feature_columns)
    )
