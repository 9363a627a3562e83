"""What the operators share: text constants, shared scratch tables, table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.shared import shared_dir

#: The white space of all contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch: both the JVM, off its heap, and a Python worker hold a batch several times over.
BATCH_BYTES = 4 << 20
#: A table that took so many seconds has shuffle files that should not wait for the driver's next collection, which
#: reaches them when listeners have seen the plan's end and Python's releases have come to the JVM.
LARGE_S, RELEASE_S = 5, 1.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z folded and nothing else."""
    return F.translate(c, UPPER, LOWER)


def one_thread(spark: SparkSession) -> None:
    """Python workers started from here on compute with one thread: tasks already fill the cores. A setting of the session's own stands."""
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches planned from here on have about BATCH_BYTES, however long their rows are. A setting of the session's own stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def hand_back() -> None:
    """Gives memory that a Python worker has freed to the system: the worker stays beside what runs next, and Arrow and the C library keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends in files that survive executors.

    Shuffle files go when the driver's JVM has collected the plan that wrote them; after a large table it is told to.
    """
    spark, began = df.sparkSession, time.monotonic()
    path = f"{shared_dir(spark)}/scholia-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if time.monotonic() - began > LARGE_S:
        gc.collect()
        for _ in range(2):
            time.sleep(RELEASE_S)
            spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes scratch tables from which nothing that is still to run reads."""
    for t in tables:
        sc, files = t.sparkSession.sparkContext, t.inputFiles()
        if files:
            path = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `number`, from 0, along a total order: ranges are sorted each for itself, and numbers start after the rows of the ranges before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    # a row for each partition
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias("number"))


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; call it when their results have been written."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scholia-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
