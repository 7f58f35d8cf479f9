"""CSV export of a prediction table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str) -> None:
    """Header and data columns only, written in parallel."""
    df.write.option("header", True).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
