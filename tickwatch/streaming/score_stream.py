"""Online scoring: new feature rows are validated, scored and appended to the predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickwatch.operators.forest import ForestModel, score
from tickwatch.operators.ordered import scan_in_order
from tickwatch.operators.quality import split_valid
from tickwatch.schema import FEATURES, PREDICTION
from tickwatch.sources.model_store import LatestModel
from tickwatch.streaming.return_stream import write_batch

# seq = batch number and position in the batch in one BIGINT.
POSITION_BITS = 36


def predictions_of_batch(features: DataFrame, model: ForestModel | None, batch_id: int) -> DataFrame:
    scored = score(features, model)
    placed = scan_in_order(scored, [], ["window_start", "symbol"], position="_position")
    seq = F.lit(batch_id << POSITION_BITS) + F.col("_position")
    return placed.withColumn("seq", seq).select(*PREDICTION.names)


def start_score_stream(
    features: DataFrame, model_path: str, predictions_path: str, rejects_path: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Score each micro-batch with the newest model; without a model the query fails and can be restarted."""
    models = LatestModel(model_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        model = models.get(batch.sparkSession)
        valid, rejected = split_valid(batch)
        write_batch(predictions_of_batch(valid, model, batch_id), predictions_path, batch_id)
        write_batch(rejected.select("symbol", *FEATURES, "reject_reasons"), rejects_path, batch_id)

    writer = features.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
