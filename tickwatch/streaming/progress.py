"""What a stream's micro-batches did, as a table: rows in, rows without a time, late windows, watermark."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickwatch.schema import PROGRESS

METRICS = "messages"
# Seconds to wait for the last report of a query that has ended.
PATIENCE = 60


def observed(events: DataFrame) -> DataFrame:
    """Counts that come with the progress of a micro-batch; they cost no pass of their own."""
    return events.observe(
        METRICS, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("event_time").isNull()).alias("n_without_time"),
        F.unix_seconds(F.max("event_time")).alias("last_second"))


class ProgressLog(StreamingQueryListener):
    """Appends one row per micro-batch (PROGRESS) to a table; use as a context around the query's run.

    late_windows counts what Spark's aggregation drops behind the watermark: rows are
    merged per symbol and window before, so it is windows, not single messages. Rows
    of a micro-batch that is repeated after a failure have the same batch_id: `read`
    keeps the newest report of each.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, {}
        self.failures: list[str] = []

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)
        if self.failures and not any(error):
            raise RuntimeError(f"progress was not kept: {self.failures[0]}")

    def _end(self, run_id) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def wait(self, query: StreamingQuery) -> None:
        """Wait for the query and for its last report."""
        query.awaitTermination()
        if not self._end(query.runId).wait(PATIENCE):
            raise TimeoutError("the last progress of the query did not arrive")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def onQueryProgress(self, event) -> None:
        try:
            p = event.progress
            seen = (p.observedMetrics or {}).get(METRICS)
            row = (str(p.id), p.batchId, p.timestamp, p.numInputRows, seen["n_without_time"] if seen else None,
                   sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                   sum(s.numRowsTotal for s in p.stateOperators), (p.eventTime or {}).get("watermark"))
            self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as error:
            # A listener's error reaches nobody; it is raised at the end of the block.
            self.failures.append(repr(error))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and micro-batch."""
    rows = spark.read.schema(PROGRESS).parquet(path)
    newest = F.max_by(F.struct(*PROGRESS.names), "reported_at").alias("r")
    return rows.groupBy("query_id", "batch_id").agg(newest).select("r.*")
