"""Scoring requests: JSON in, a score or the reasons of a refusal out, each exactly once.

A micro-batch is parsed, checked and scored once and written as one staged table; predictions
and rejects are copied from it to their own tables, each into the partition of the
batch, and a mark is written last. Readers take batches up to the last mark, so they
see a batch in both tables or in none, and a batch that is repeated after a failure
replaces what its first attempt left.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickwatch.operators.forest import score
from tickwatch.operators.ordered import scan_in_order
from tickwatch.operators.quality import read_requests, with_reject_reasons
from tickwatch.schema import FEATURES, PREDICTION
from tickwatch.session import partition_numbers, staged
from tickwatch.sources.model_store import LatestModel
from tickwatch.streaming.return_stream import write_batch
from tickwatch.streaming.score_stream import POSITION_BITS

REQUEST_ID = T.StructField("request_id", T.LongType())
ANSWERED = T.StructType([REQUEST_ID, *PREDICTION.fields])
REFUSED = T.StructType([REQUEST_ID, *[f for f in PREDICTION.fields if f.name in ("symbol", *FEATURES)],
                        T.StructField("reject_reasons", T.ArrayType(T.StringType()))])


def answer_batch(messages: DataFrame, model, path: str, batch_id: int) -> None:
    """Score the messages (request_id, value) of one micro-batch; calling it again changes nothing."""
    checked = with_reject_reasons(read_requests(messages, ("request_id",)))
    # Refused rows get no score: a null feature is no model input.
    valid = F.size("reject_reasons") == 0
    with staged(score(checked, model), "requests") as rows:
        placed = scan_in_order(rows.where(valid), [], ["request_id"], position="_position")
        answered = placed.withColumn("seq", F.lit(batch_id << POSITION_BITS) + F.col("_position"))
        write_batch(answered.select(*ANSWERED.names), f"{path}/predictions", batch_id)
        write_batch(rows.where(~valid).select(*REFUSED.names), f"{path}/rejects", batch_id)
        counts = rows.agg(F.count_if(valid).alias("n_answered"), F.count_if(~valid).alias("n_refused"))
        write_batch(counts.coalesce(1), f"{path}/marks", batch_id)


def start_request_stream(
    messages: DataFrame, model_path: str, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """messages (request_id, value) -> predictions, rejects and marks below `path`, with the newest model."""
    models = LatestModel(model_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        answer_batch(batch, models.get(batch.sparkSession), path, batch_id)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _marked(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    marks = partition_numbers(spark, f"{path}/marks", "batch_id")
    if not marks:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return stored.parquet(f"{path}/{name}").where(F.col("batch_id") <= marks[-1]).select(*schema.names)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """All answers of finished micro-batches."""
    return _marked(spark, path, "predictions", ANSWERED)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """All refusals of finished micro-batches, with their reasons."""
    return _marked(spark, path, "rejects", REFUSED)
