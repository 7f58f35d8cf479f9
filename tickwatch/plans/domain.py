"""The provided tables as market data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.operators.features import build_features
from tickwatch.operators.returns import with_log_return

WINDOW = "6 hours"
WINDOW_SECONDS = 6 * 3600
LABEL_ABOVE = 230


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def market_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as ticks: the type is the symbol, the value the price, props.k the volume."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        (F.col("value") > LABEL_ABOVE).alias("is_anomaly"),
    )


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as a larger tick table for load tests.

    Its days are coarse and its line numbers repeat, so the tie-break is a hash
    of all four keys, which are unique together.
    """
    row = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint").alias("event_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_discount") >= 0.1).alias("is_anomaly"),
    )


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_log_return(market_ticks(spark, sf_dir))


def market_features(spark: SparkSession, sf_dir: str, window: str = WINDOW) -> DataFrame:
    return build_features(market_events(spark, sf_dir), window)
