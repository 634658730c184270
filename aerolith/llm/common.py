"""What the training-data operators share: the work folder, cut lineage, salted lookups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of whole texts: long texts then stay within a worker's memory.
TEXT_BATCH_ROWS = 128
SALTS = 64


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="aerolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a written table, read again: cuts lineage, survives lost executors, and
    gives the planner a real size to choose a join by. Returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Small Arrow batches for the Python stages that take whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def salted_lookup(left: DataFrame, key: str, salt: Column, right: DataFrame, how: str = "left", salts: int = SALTS) -> DataFrame:
    """`left` joined to `right`, which has one row per `key`, when a few keys may hold
    most rows of `left`. Only the (key, salt) pairs in use are copied, so no task gets
    more than a `salts`-th of a key's rows and nothing is broadcast or collected."""
    l = left.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    need = l.select(key, "__salt").distinct()
    r = need.join(right, key)
    return l.join(r, [key, "__salt"], how).drop("__salt")


def rows_of(batches, n_bytes: int, column: str = "text"):
    """Arrow batches gathered into tables of about `n_bytes` of text each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= n_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lean(run):
    """`run` over Arrow batches, after which the worker, which is used again, gives back
    the memory it no longer needs."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return wrapped
