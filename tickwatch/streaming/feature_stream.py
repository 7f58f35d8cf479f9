"""Event messages to windowed features, as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickwatch.operators.features import WINDOW, build_features
from tickwatch.sources.events import decode_events
from tickwatch.sources.feature_store import feature_sink
from tickwatch.streaming.progress import observed

WATERMARK = "1 minute"


def stream_features(events: DataFrame, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Features of finished windows: a window appears once the watermark passes its end."""
    return build_features(events.withWatermark("event_time", watermark), window)


def start_feature_stream(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    window: str = WINDOW,
    watermark: str = WATERMARK,
    keep: tuple[str, ...] | None = None,
    extra: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run messages -> features -> feature store; restarts continue from the checkpoint.

    Messages that come with an event_id keep it (`keep`), so that ties of event time
    have a last one. A `ProgressLog` around it keeps what its micro-batches report.
    """
    if keep is None:
        keep = tuple(c for c in ("event_id",) if c in messages.columns)
    events = observed(decode_events(messages, keep, extra))
    writer = feature_sink(stream_features(events, window, watermark), path, checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
