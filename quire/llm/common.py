"""What the operators of this package share: inputs, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: A worker holds one Arrow batch at a time; long rows make short batches.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20
#: Bytes of a group after which its worker's memory is handed back.
LARGE_GROUP = 1 << 20
#: Rows of ids in a file of a small table.
ROWS_PER_FILE = 250_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark only, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, on one machine only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that all of them share")
        conf = f"file://{tempfile.gettempdir()}/quire-shared"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path that this process has written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df into the shared folder and read it again. Lost executors take nothing with them.

    rows: a bound on its rows where one is known; small tables then go into few files.
    """
    path = fresh_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python workers, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow in bounded batches, by workers that give their memory back after each task."""
    small_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def grouped_arrow(fn: Callable) -> Callable:
    """A function for applyInArrow whose worker gives its memory back after large groups."""

    def one(table):
        out = fn(table)
        if table.nbytes > LARGE_GROUP:
            release_memory()
        return out

    def two(left, right):
        out = fn(left, right)
        if left.nbytes + right.nbytes > LARGE_GROUP:
            release_memory()
        return out

    return two if fn.__code__.co_argcount == 2 else one


def release_memory() -> None:
    """Hand freed memory back to the system: workers live on, idle, beside those of the next stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library; it has its own way
