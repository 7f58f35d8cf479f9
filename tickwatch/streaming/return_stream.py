"""Log returns of a tick stream: the last price of a symbol outlives a micro-batch.

Two forms. `start_return_stream` handles each micro-batch as a table, with the
balanced ordered scan of the batch operator, and keeps one row per symbol in a
state table; it holds for any key distribution and writes an event table that
the feature stream can read. `stateful_log_return` keeps the price in Spark's
keyed state, so that returns and windows fit in a single query; a symbol's ticks are
followed per time slice there, and only the first tick of each slice meets the
state of its symbol.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickwatch.functions.columns import arrival_key, log_return
from tickwatch.operators.ordered import scan_in_order
from tickwatch.schema import table
from tickwatch.session import is_missing, ship_package, staged, use_keyed_state

STATE = table("symbol string, price double, event_time timestamp, event_id bigint")
STORED_STATE = T.StructType(
    STATE.fields + [T.StructField("batch_id", T.LongType()), T.StructField("slot", T.LongType())])
# The state table holds this many states; a batch number picks its place.
SLOTS = 3


def state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """One row per symbol as it was before the batch.

    Only the first batch may find no state; a state that is gone later is an error,
    as all symbols would start again at a log return of 0.
    """
    try:
        stored = spark.read.schema(STORED_STATE).parquet(path)
    except AnalysisException as error:
        if batch_id > 0 or not is_missing(error):
            raise
        return spark.createDataFrame([], STATE)
    last = stored.where(F.col("batch_id") < batch_id).agg(F.max("batch_id").alias("b")).first()["b"]
    if last is None:
        return spark.createDataFrame([], STATE)
    return stored.where((F.col("slot") == last % SLOTS) & (F.col("batch_id") == last)).select(*STATE.names)


def _replace_partition(df: DataFrame, path: str, column: str, value: int) -> None:
    (
        df.withColumn(column, F.lit(value).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(column).parquet(path)
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a micro-batch; a repeated one replaces its own partition, so nothing doubles."""
    _replace_partition(df, path, "batch_id", batch_id)


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    """Keep the state after a batch in place of the one SLOTS batches ago."""
    marked = state.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    _replace_partition(marked, path, "slot", batch_id % SLOTS)


def _arrival(kept: bool) -> Column:
    """The order of a micro-batch's ticks as one number: a kept price, ticks without a time, the others."""
    first, second = (F.lit(f"-{'9' * 36}{digit}").cast("decimal(38,0)") for digit in "98")
    return first if kept else F.coalesce(arrival_key("event_time", "event_id"), second)


def returns_of_batch(ticks: DataFrame, state: DataFrame, rows_per_range: int | None = None) -> DataFrame:
    """Log returns of a micro-batch, continued from the kept last prices."""
    kept = state.select("symbol", "price").withColumn("_arrival", _arrival(True)).withColumn("_new", F.lit(False))
    both = ticks.withColumn("_arrival", _arrival(False)).withColumn("_new", F.lit(True)).unionByName(
        kept, allowMissingColumns=True)
    lagged = scan_in_order(both, ["symbol"], ["_arrival"], lag={"_previous": "price"}, rows_per_range=rows_per_range)
    return lagged.where("_new").withColumn("log_return", log_return("price", "_previous")).select(
        *ticks.columns, "log_return")


def state_after(ticks: DataFrame, state: DataFrame) -> DataFrame:
    """One row per symbol: its last tick of the micro-batch, or what was kept where it has none."""
    last = ticks.groupBy("symbol").agg(*[
        F.max_by(c, _arrival(False)).alias(c) for c in STATE.names[1:]])
    rows = last.withColumn("_new", F.lit(1)).unionByName(state.withColumn("_new", F.lit(0)))
    return rows.groupBy("symbol").agg(*[F.max_by(c, "_new").alias(c) for c in STATE.names[1:]])


def start_return_stream(
    ticks: DataFrame, path: str, state_path: str, checkpoint: str,
    available_now: bool = False, rows_per_range: int | None = None,
) -> StreamingQuery:
    """ticks (symbol, price, event_time, event_id, ...) -> event table with log_return."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Several passes follow; the source is read once, and the table goes with the micro-batch.
        with staged(batch, "ticks") as rows:
            state = state_before(batch.sparkSession, state_path, batch_id)
            write_batch(returns_of_batch(rows, state, rows_per_range), path, batch_id)
            write_state(state_after(rows, state), state_path, batch_id)

    writer = ticks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# Ticks of a symbol in one slice of time are one frame; a slice should hold several of them.
SLICE_SECONDS = 60


def _follow_slice(rows: pd.DataFrame) -> pd.DataFrame:
    """One symbol's ticks of a slice and a micro-batch: previous prices, and the last price beside the first tick."""
    rows = rows.sort_values(["event_time", "event_id"], kind="stable", ignore_index=True)
    rows["previous"] = rows["price"].shift(1)
    rows["_first"] = rows.index == 0
    rows["_last_price"] = rows["price"].iloc[-1]
    # First ticks meet in one group per symbol, all others stay apart.
    rows["_slice"] = rows["_slice"].where(~rows["_first"], 0)
    return rows


class LastPrice(StatefulProcessor):
    """Keeps a symbol's last price and gives it to the first tick of the next slice."""

    def __init__(self, given: list[str], columns: list[str]):
        # The step renames columns that are no Python names; their order stays.
        self.given, self.columns = given, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if not key[1]:
            for frame in rows:
                yield frame.set_axis(self.given, axis=1)[self.columns]
            return
        firsts = pd.concat([frame.set_axis(self.given, axis=1) for frame in rows], ignore_index=True)
        firsts = firsts.sort_values(["event_time", "event_id"], kind="stable", ignore_index=True)
        firsts["previous"] = firsts["_last_price"].shift(1)
        if self.last.exists():
            firsts.loc[0, "previous"] = self.last.get()[0]
        last = firsts["_last_price"].iloc[-1]
        self.last.update((None if pd.isna(last) else float(last),))
        yield firsts[self.columns]

    def close(self) -> None:
        pass


def stateful_log_return(ticks: DataFrame, watermark: str = "1 minute", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add log_return in a streaming query; the result can be windowed in the same query.

    Ticks are followed per symbol and slice of event time, one task for each. The
    first tick of a slice (one row per slice and micro-batch) goes on to the state
    of its symbol, which carries the last price from slice to slice and on to the
    next micro-batch. Event time leaves the step with a watermark of its own, set
    behind the state: a late tick still has a return and moves the last price, and
    only a window that is closed drops it. `slice_seconds` should span several ticks.
    The state needs the RocksDB store, which the session is given if it has the default one.
    """
    ship_package(ticks.sparkSession)
    use_keyed_state(ticks.sparkSession)
    sliced = ticks.withColumn("_slice", F.floor(F.unix_seconds("event_time") / slice_seconds))
    out = T.StructType([*ticks.schema.fields, T.StructField("previous", T.DoubleType())])
    between = T.StructType([*sliced.schema.fields, T.StructField("previous", T.DoubleType()),
                            T.StructField("_first", T.BooleanType()), T.StructField("_last_price", T.DoubleType())])
    followed = sliced.groupBy("symbol", "_slice").applyInPandas(_follow_slice, between)
    joined = followed.groupBy("symbol", "_first", "_slice").transformWithStateInPandas(
        LastPrice(between.names, out.names), out, "append", "None")
    return (
        joined.withColumn("log_return", log_return("price", "previous")).drop("previous")
        .withWatermark("event_time", watermark)
    )
