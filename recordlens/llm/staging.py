"""Intermediate tables in the folder that driver and executors share."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Unset, it becomes a temporary folder, but only where all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recordlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows to a file of a staged table whose size is bounded by one that is known.
FILE_ROWS = 250_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``most`` bounds its rows and those of its last exchange, if known: small tables go to few files.

    Cuts the lineage: lost executors cost only tasks that read the files, and several readers of
    one result do not compute it again. The reread table carries no partitioning, so a join on it
    gets exchanges on both sides and AQE can split its skewed partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordlens/{name}-{uuid.uuid4().hex}"
    # What was shuffled for the table is not needed once it is written.
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df if most is None else df.coalesce(most // FILE_ROWS + 1)).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        at = df.__dict__.pop("_staged_at", None)
        if at:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch where the session does not say: texts may be long.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_ROWS`` rows, unless the session has chosen another number than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within: Arrow batches of at most ``most`` rows, for stages whose rows are large. What is staged within runs so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give memory that this worker has freed back to the machine: an idle worker keeps it else, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean(run: Callable) -> Callable:
    """A function of batches whose worker gives memory back before it begins and when it is done."""

    def trimmed(batches):
        trim()
        yield from run(batches)
        trim()

    return trimmed


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns``, and the whole row as one struct ``row``: other columns then clash with nothing."""
    return df.select(*columns, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
