"""Controlled anomalies in a tick table, for evaluating detection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.columns import log_return, uniform
from tickwatch.operators.ordered import scan_in_order

# The kinds and the size of their effects.
KINDS = ["PRICE_SPIKE", "VOLUME_SPIKE", "FLASH_CRASH"]
SPIKE_FACTOR = (1.05, 1.15)
CRASH_FACTOR = (0.85, 0.95)
VOLUME_FACTOR = 8
PROBABILITY = 0.01
# For long series: what is left of a price effect one tick later; half of it goes in about 700 ticks.
FADE = 0.999


def inject_anomalies(
    ticks: DataFrame,
    prob: float = PROBABILITY,
    seed: int = 42,
    persist: bool = True,
    fade: float = 1.0,
    order: tuple[str, ...] = ("event_time", "event_id"),
    key: str = "event_id",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Mark about `prob` of the ticks and distort them; log returns are computed anew.

    A price effect stays in the later prices of the symbol (persist) or only in its
    own tick. With `fade` below 1 a lasting effect fades: the logarithm of its factor is
    multiplied by `fade` with each tick, so that a series of any length keeps its level
    (`FADE` suits ticks by the second). Effects that never fade add up, and as crashes
    outweigh spikes, they bring the prices of millions of ticks to 0.
    Draws are hashes of the row key, so a run can be repeated.
    """
    if not 0 < fade <= 1:
        raise ValueError("fade must be above 0 and at most 1")
    hit = uniform(key, seed, 1) < prob
    kind = F.element_at(
        F.array(*[F.lit(k) for k in KINDS]), F.floor(uniform(key, seed, 2) * len(KINDS)).cast("int") + 1)
    u = uniform(key, seed, 3)
    spike = F.lit(SPIKE_FACTOR[0]) + u * (SPIKE_FACTOR[1] - SPIKE_FACTOR[0])
    crash = F.lit(CRASH_FACTOR[0]) + u * (CRASH_FACTOR[1] - CRASH_FACTOR[0])
    marked = ticks.drop("is_anomaly").withColumn("anomaly_type", F.when(hit, kind)).withColumns({
        "is_anomaly": F.col("anomaly_type").isNotNull(),
        "_ln": F.when(F.col("anomaly_type") == "PRICE_SPIKE", F.ln(spike))
        .when(F.col("anomaly_type") == "FLASH_CRASH", F.ln(crash)).otherwise(0.0),
        "volume": F.when(F.col("anomaly_type") == "VOLUME_SPIKE", F.col("volume") * VOLUME_FACTOR)
        .otherwise(F.col("volume")),
    })
    if persist and fade < 1:
        # level = fade * level before + ln(factor): the running product of the fading factors.
        run = scan_in_order(marked.withColumn("_fade", F.lit(float(fade))), ["symbol"], list(order), lag={"_raw": "price"},
                            affine={"_level": ("_fade", "_ln")}, rows_per_range=rows_per_range)
    elif persist:
        # A running sum of logarithms is the running product of the factors.
        run = scan_in_order(marked.withColumn("_fade", F.lit(1.0)), ["symbol"], list(order), lag={"_raw": "price"},
                            total={"_level": "_ln"}, rows_per_range=rows_per_range)
    if persist:
        moved = run.withColumns({
            "price": F.col("price") * F.exp("_level"),
            "_previous": F.col("_raw") * F.exp((F.col("_level") - F.col("_ln")) / F.col("_fade")),
        })
    else:
        shifted = marked.withColumn("price", F.col("price") * F.exp("_ln"))
        moved = scan_in_order(shifted, ["symbol"], list(order), lag={"_previous": "price"},
                              rows_per_range=rows_per_range)
    rounded = moved.withColumn("log_return", F.round(log_return("price", "_previous"), 6)).withColumns({
        "price": F.round("price", 2), "volume": F.round("volume", 6)})
    return rounded.drop("_ln", "_raw", "_level", "_previous", "_fade")
