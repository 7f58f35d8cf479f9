"""Raw exchange trades to market events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.functions.columns import floor_seconds, json_columns, to_symbol, valid_millis
from tickwatch.operators.returns import with_log_return
from tickwatch.schema import TRADE
from tickwatch.session import stage

_BAD = "_bad"


def parse_trades(messages: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Trade messages with typed columns and a reject_reason (null for a good one).

    A trade time that is no time in milliseconds of the years 1970 to 9999 has the
    reason "time". Other message kinds are dropped; what cannot be read is kept with its reason,
    so that one bad message neither stops the job nor disappears.
    """
    schema = T.StructType(TRADE.fields + [T.StructField(_BAD, T.StringType())])
    text = F.col("value").cast("string")
    fields = json_columns(text, schema, {"columnNameOfCorruptRecord": _BAD})
    typed = messages.select(*keep, text.alias("value"), fields).select(
        *keep, "value", _BAD,
        F.col("data.e").alias("_kind"),
        F.col("data.s").alias("exchange_symbol"),
        F.col("data.p").try_cast("double").alias("price"),
        F.col("data.q").try_cast("double").alias("volume"),
        valid_millis(F.col("data.T").try_cast("bigint")).alias("trade_ms"),
    )
    malformed = F.col("value").isNull() | F.col(_BAD).isNotNull()
    reason = (
        F.when(malformed, "malformed")
        .when(F.col("exchange_symbol").isNull(), "symbol")
        .when(F.col("price").isNull(), "price")
        .when(F.col("volume").isNull(), "quantity")
        .when(F.col("trade_ms").isNull(), "time")
    )
    return (
        typed.where(malformed | (F.col("_kind") == "trade"))
        .withColumn("reject_reason", reason)
        .drop(_BAD, "_kind")
    )


def good_trades(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def quarantine_counts(parsed: DataFrame) -> DataFrame:
    return quarantine(parsed).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def trade_ticks(trades: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Good trades as ticks with full-precision prices, ready for log returns."""
    return trades.select(
        *keep,
        F.timestamp_millis("trade_ms").alias("trade_time"),
        floor_seconds("trade_ms").alias("timestamp"),
        to_symbol("exchange_symbol").alias("symbol"),
        "price", "volume",
    )


def as_events(ticks: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Round as the event format asks; the source is unlabelled."""
    return ticks.select(
        *keep, "timestamp", "symbol",
        F.round("price", 2).alias("price"),
        F.round("volume", 6).alias("volume"),
        F.round("log_return", 6).alias("log_return"),
        F.lit(False).alias("is_anomaly"),
        F.lit(None).cast("string").alias("anomaly_type"),
        F.timestamp_seconds("timestamp").alias("event_time"),
    )


def normalize_trades(
    messages: DataFrame, rows_per_range: int | None = None, materialize: bool = True
) -> DataFrame:
    """Messages (value, event_id) to market events, log returns included.

    The ordered scan reads its input several times, so the text is parsed once
    into a columnar table first (materialize=False leaves that out).
    """
    ticks = messages.transform(parse_trades).transform(good_trades).transform(trade_ticks)
    if materialize:
        ticks = stage(ticks, "trades")
    returns = with_log_return(ticks, ("trade_time", "event_id"), rows_per_range=rows_per_range)
    return as_events(returns)
