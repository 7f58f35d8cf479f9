import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tickwatch.session import ship_package, stage, staged


def shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(at, name)) for folder in folders for at, _, names in os.walk(folder.getPath())
               for name in names if name.startswith("shuffle_") and name.endswith(".data"))


def test_written_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_bytes(spark), spark.conf.get(name, "false")
    df = spark.range(300_000).withColumn("k", F.xxhash64("id")).repartition("k")
    out = stage(df.groupBy((F.col("k") % 1000).alias("g")).agg(F.max("id").alias("m")))
    with staged(df) as again:
        assert again.count() == 300_000
    for _ in range(50):
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_bytes(spark) <= before + 100_000
    assert out.agg(F.max("m")).first()[0] == 299_999 and df.count() == 300_000
    assert spark.conf.get(name, "false") == setting


def test_tasks_are_sent_few_bytes_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    def counted():
        ship_package(spark)
        return [r["n"] for r in texts.mapInArrow(count, "n long").collect()]

    try:
        spark.conf.unset(name)
        assert sum(counted()) == 60 and max(counted()) <= 10
        # Another limit than Spark's own is the user's.
        spark.conf.set(name, "20m")
        assert sum(counted()) == 60 and 10 < max(counted()) <= 22
    finally:
        spark.conf.set(name, before)
