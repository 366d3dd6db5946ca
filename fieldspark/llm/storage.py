"""Tables and folders that all executors share, and what clears them away.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that are sent to every executor at most, some 50 MB; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="fieldspark-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, what: str = "table") -> str:
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator call; ``clear`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def table(self, df: DataFrame, what: str = "table") -> DataFrame:
        """Writes df and reads it back."""
        path = new_path(self.spark, what)
        self.paths.append(path)
        return write_and_read(df, path)

    def bucketed(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """Writes df as a warehouse table bucketed by key, so that later work by key moves nothing."""
        name = f"llm_{uuid.uuid4().hex}"
        shared_dir(self.spark)  # a cluster names its shared folders; its warehouse is one of them
        self.tables.append(name)
        df.write.option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, what: str) -> None:
        """Deletes the tables of a name that nothing reads any more."""
        gone = [p for p in self.paths if f"/llm-{what}-" in p]
        for path in gone:
            delete_path(self.spark, path)
        self.paths = [p for p in self.paths if p not in gone]

    def clear(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.paths, self.tables = [], []
        release_shuffles(self.spark)


def scratched(operator: Callable) -> Callable:
    """operator(scratch, table, ...) as operator(table, ...): its scratch is cleared however it ends."""

    @wraps(operator)
    def run(table: DataFrame, *args, **named):
        scratch = Scratch(table.sparkSession)
        try:
            return operator(scratch, table, *args, **named)
        finally:
            scratch.clear()

    return run


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small_side(table: DataFrame) -> DataFrame:
    """A written table of a few longs, marked for broadcast only where its rows have been counted and are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced.

    The cleaner follows the driver's garbage collector, which has little to do
    while executors work: a large shuffle would stay on their disks until it runs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns to the system what this worker process has freed: it lives on, and keeps what earlier stages needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
