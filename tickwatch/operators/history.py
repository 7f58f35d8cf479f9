"""The recent-prediction view: the newest 500 rows by seq, and selections from it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.schema import PREDICTION
from tickwatch.session import partition_numbers

HISTORY = 500
DEFAULT_LIMIT = 100
ALL = "All"


def history(predictions: DataFrame, size: int = HISTORY) -> DataFrame:
    """The newest rows; a top-k, so each task hands on at most `size` rows."""
    return predictions.orderBy(F.desc("seq")).limit(size)


def stored_view(spark: SparkSession, path: str, size: int = HISTORY) -> DataFrame:
    """The newest rows of a prediction table partitioned by batch_id, in which seq grows with the batch.

    Batches are taken from the newest back, twice as many at each look, until they
    hold `size` rows; older ones are pruned by their folder names and never opened.
    A table that is not there yet is an empty view.
    """
    batches = partition_numbers(spark, path, "batch_id")
    if not batches:
        return spark.createDataFrame([], PREDICTION)
    stored = spark.read.schema(T.StructType([*PREDICTION.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    taken = 1
    while True:
        newest = stored.where(F.col("batch_id") >= batches[-taken])
        if taken == len(batches) or newest.limit(size).count() >= size:
            return history(newest, size).select(*PREDICTION.names)
        taken = min(2 * taken, len(batches))


def latest_stored(spark: SparkSession, path: str, limit: int = DEFAULT_LIMIT, symbol: str | None = None) -> DataFrame:
    """`latest` of a stored prediction table: as many batches are read as the view needs."""
    return latest(stored_view(spark, path), limit, symbol)


def of_symbol(predictions: DataFrame, symbol: str | None = None) -> DataFrame:
    """Rows of one symbol; None or All keeps every row."""
    if symbol is None or symbol == ALL:
        return predictions
    return predictions.where(F.col("symbol") == symbol)


def latest(predictions: DataFrame, limit: int = DEFAULT_LIMIT, symbol: str | None = None) -> DataFrame:
    """The last `limit` rows of the view, oldest first; the symbol filter comes before the limit."""
    if not 1 <= limit <= HISTORY:
        raise ValueError(f"limit must be within 1..{HISTORY}")
    view = of_symbol(history(predictions), symbol)
    return view.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def anomalies_only(predictions: DataFrame) -> DataFrame:
    return predictions.where("is_anomaly")


def recent_anomalies(view: DataFrame, n: int = 5) -> DataFrame:
    """The last `n` anomalies of a view, oldest first."""
    return anomalies_only(view).orderBy(F.desc("seq")).limit(n).orderBy("seq")
