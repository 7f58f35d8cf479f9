"""Session settings, shared scratch space and lineage cutting."""

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Executors may be lost at any time, so intermediate tables live in the shared
# folder the cluster names here, never on one machine.
CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_CONF = "spark.tickwatch.localDir"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
_STATE_STORES = "org.apache.spark.sql.execution.streaming.state."
STATE_STORE = f"{_STATE_STORES}RocksDBStateStoreProvider"


def build_session(app: str = "tickwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE_CONF: STATE_STORE,
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_keyed_state(spark: SparkSession) -> None:
    """Take the RocksDB state store in a session that has Spark's default one, which cannot hold keyed state.

    It counts for streams that start from now on; one with a checkpoint keeps the store it began with.
    Each partition of that store takes 4 MB of disk, also of a stream that has ended, until Spark's next upkeep.
    """
    if spark.conf.get(STATE_STORE_CONF) == f"{_STATE_STORES}HDFSBackedStateStoreProvider":
        spark.conf.set(STATE_STORE_CONF, STATE_STORE)
        spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of about 8 MB in a session that has Spark's default of 64 MB.

    Ten thousand texts of some KB are one batch else, which a task holds several times: in the JVM, where its buffers
    double as they grow, and in its Python worker.
    """
    if spark.conf.get(_BATCH_CONF) == f"{64 << 20}b":
        spark.conf.set(_BATCH_CONF, "8m")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and limit what they are sent at once.

    Executors have neither the driver's working directory nor its path.
    """
    limit_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tickwatch-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "tickwatch"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or a local one in local mode."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(_LOCAL_CONF, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    base = tempfile.mkdtemp(prefix="tickwatch-")
    spark.conf.set(_LOCAL_CONF, base)
    return base


_released_at_exit: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_dir(spark)}/tickwatch/{getattr(spark.sparkContext, 'applicationId', 'application')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder; every call gives another one."""
    folder = _own_dir(spark)
    if folder not in _released_at_exit and isinstance(spark, SparkSession):
        _released_at_exit.add(folder)
        atexit.register(release, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the application's intermediate tables; results that read them cannot be computed any more.

    Happens by itself when the driver ends with its session still running.
    """
    if spark.sparkContext._jsc is not None:
        delete_path(spark, folder or _own_dir(spark))


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path yet, not for another reason."""
    return error.getCondition() == "PATH_NOT_FOUND"


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def partition_numbers(spark: SparkSession, path: str, column: str) -> list[int]:
    """The values of an integer partition column, ascending, from the folder names alone."""
    start = f"{column}="
    return sorted(int(name[len(start):]) for name in children(spark, path)
                  if name.startswith(start) and name[len(start):].lstrip("-").isdigit())


def write_table(df: DataFrame, path: str, **options: str) -> None:
    """Write `df` as Parquet; the shuffle files of this write go when it ends, as nothing else reads them."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_FREE_SHUFFLES, before)


@contextlib.contextmanager
def staged(df: DataFrame, name: str = "stage"):
    """A staged table that is deleted at the end of the block, also after an error."""
    path = scratch_path(df.sparkSession, name)
    try:
        write_table(df, path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Used where a result is needed by three or more passes. Columnar files are
    smaller than checkpoint() blocks and later passes read only their columns.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
