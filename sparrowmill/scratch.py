"""Shared scratch space: tables that cut lineage and survive lost executors.

Everything is written below ``spark.checkpoint.dir``, the one folder that a cluster names as
shared between the driver and the executors.  Only where that setting is unset (tests, a local
session) does this module choose a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Heaps of executors up to this are small beside their Python workers.
SMALL_HEAP_MB = 4096


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sparrowmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/sparrowmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`written` made and that nothing will read again."""
    for df in tables:
        if df is not None:
            delete_path(df.sparkSession, df.scratch_path)


def _at(spark: SparkSession, path: str):
    """A path and its file system, of any kind that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def delete_path(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a task at most, about, where each row costs much more to work on than to send.
ROWS_A_TASK, LEAST_ROWS_A_TASK = 50_000, 500


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over tasks for work that costs much a row.

    Files hold rows in few and large groups, and short rows lie together in few files, so that a scan
    gives a core or two all of the work.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // ROWS_A_TASK), min(4 * cores, rows // LEAST_ROWS_A_TASK)), key)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when their handles,
    in Python and then in the driver's JVM, are collected as garbage.

    Executors with a small heap give back what the plans have left there, too: beside them live
    Python workers that need the memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(spark.conf.get("spark.executor.memory", "1g")) <= SMALL_HEAP_MB:
        tasks = spark.sparkContext.defaultParallelism
        spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).collect()
