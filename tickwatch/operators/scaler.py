"""Standard scaling with population deviations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.schema import FEATURES


def moments(features: DataFrame) -> DataFrame:
    """One row: n, the means m0.. and the population deviations s0.. of the features."""
    return features.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)],
    )


def fit_scaler(features: DataFrame) -> DataFrame:
    """Five rows (feature, position, mean, scale) from one aggregation; scale 0 becomes 1."""
    wide = moments(features)
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, c in enumerate(FEATURES)
    ]
    return wide.select(F.inline(F.array(*entries)))


def standardize(features: DataFrame, means: list[float], scales: list[float]) -> DataFrame:
    """Replace the features by (x - mean) / scale."""
    return features.withColumns({
        c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(FEATURES, means, scales)
    })
