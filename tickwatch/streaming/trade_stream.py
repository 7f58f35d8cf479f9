"""Raw exchange trades to an event table, as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwatch.operators.trades import as_events, good_trades, parse_trades, quarantine, trade_ticks
from tickwatch.session import staged
from tickwatch.streaming.return_stream import (
    returns_of_batch,
    state_after,
    state_before,
    write_batch,
    write_state,
)


def start_trade_stream(
    messages: DataFrame, path: str, quarantine_path: str, state_path: str, checkpoint: str,
    available_now: bool = False, rows_per_range: int | None = None,
) -> StreamingQuery:
    """messages (value, event_id) -> events with log returns; unreadable ones go to quarantine."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Several passes follow; the text is parsed once, and the table goes with the micro-batch.
        with staged(parse_trades(batch), "trades") as parsed:
            ticks = trade_ticks(good_trades(parsed)).withColumn("event_time", F.col("trade_time"))
            state = state_before(batch.sparkSession, state_path, batch_id)
            write_batch(as_events(returns_of_batch(ticks, state, rows_per_range)), path, batch_id)
            write_batch(quarantine(parsed), quarantine_path, batch_id)
            write_state(state_after(ticks, state), state_path, batch_id)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
