"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000  # of ids, hashes and the like
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session makes a temporary folder once; on a
    cluster, whose executors would not see it, this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage and keeps a result that several later steps read, in a
    place that outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free_driver(spark)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_path = path
    return found


def discard(*settled: DataFrame) -> None:
    """Delete tables of ``settle`` that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_heap(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and give back the heap that is free then.

    A JVM keeps the heap it has once grown to, which the Python workers of a
    later stage then lack; between the stages of a long job little is alive. One
    short task for each core; best effort, nothing depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def free_driver(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, if its heap has grown past half of its limit, and give back what is free.

    The many small plans of an iterative job leave little alive, but the JVM
    lets its heap grow to the limit before it looks.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() / 2:
        spark._jvm.System.gc()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python tasks batches of ``BATCH_BYTES`` at most, unless it has a limit of its own."""
    if df.sparkSession.conf.get(BATCH_LIMIT, None) is None:
        df.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df


def small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are at most ``BROADCAST_ROWS``, else as they are for a shuffled join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of whole rows, each with at most ``limit`` bytes in ``column`` or with one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
