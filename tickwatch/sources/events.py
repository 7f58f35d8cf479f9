"""Event sources: message topics or text files, batch or stream, decoded from JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.functions.columns import json_columns, valid_seconds
from tickwatch.schema import EVENT, table

# Bounds a micro-batch, and with it what one key can bring into one task.
MAX_OFFSETS_PER_TRIGGER = 20_000_000
MAX_FILES_PER_TRIGGER = 1_000


def kafka_options(servers: str, topic: str, starting: str = "latest",
                  max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "maxOffsetsPerTrigger": str(max_offsets),
    }


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                   max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> DataFrame:
    """Messages of a topic as a stream, with an event_id that no other message has (see `message_id`)."""
    options = kafka_options(servers, topic, starting, max_offsets)
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select("value", message_id("partition", "offset").alias("event_id"))


def message_id(partition, offset) -> Column:
    """Partition and offset in one BIGINT (15 and 48 bits): unique in a topic, and in order of arrival within a partition."""
    return F.shiftleft(F.col(partition).cast("bigint"), 48) + F.col(offset)


def text_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def text_message_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def decode_events(messages: DataFrame, keep: tuple[str, ...] = (), extra: str | None = None) -> DataFrame:
    """JSON messages to event columns plus event_time.

    A malformed message gives all nulls, a bad field a null in that field, and a
    timestamp outside the years 1970 to 9999 (another unit) no event_time. `keep`
    carries source columns along (an offset); `extra` ("name type, ...") adds JSON fields.
    """
    schema = T.StructType(EVENT.fields + (table(extra).fields if extra else []))
    parsed = messages.select(*keep, json_columns(F.col("value").cast("string"), schema))
    return parsed.withColumn("event_time", F.timestamp_seconds(valid_seconds("timestamp")))


def encode_events(events: DataFrame) -> DataFrame:
    """Event columns as one JSON `value`, the form a topic carries."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
