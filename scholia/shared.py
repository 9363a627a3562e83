"""The folder that driver and executors share, and tables kept there under the content they were derived from."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of kept tables; another number makes them anew.
FORMAT = 2
_KEYS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is configured: a folder of our own in local mode, an error on a cluster."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scholia-"))
        configured = sc.getCheckpointDir()
    return configured


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, *paths: str) -> str:
    """Of the files below paths: a hash of their names, sizes and times of change; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    r = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return hashlib.sha256(f"{sorted(paths)} {tuple(r)}".encode()).hexdigest()[:32]


def content_key(spark: SparkSession, sources: dict[str, DataFrame]) -> str:
    """Checksum of the rows of sources (path: its rows), in any order. Scanned once for each listing of the files, so a file that is only touched makes no table anew."""
    seen = listing(spark, *sources)
    known = (spark.sparkContext.applicationId, seen)
    if known not in _KEYS:
        alias = f"{store_dir(spark)}/listings/{seen}"
        if exists(spark, f"{alias}/_SUCCESS"):
            _KEYS[known] = spark.read.text(alias).first()["value"]
        else:
            sums = []
            for path in sorted(sources):
                h = F.xxhash64(*sources[path].columns)
                sums.append(tuple(sources[path].agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()))
            _KEYS[known] = hashlib.sha256(f"{FORMAT} {sums}".encode()).hexdigest()[:32]
            spark.createDataFrame([(_KEYS[known],)], "value string").coalesce(1).write.mode("overwrite").text(alias)
    return _KEYS[known]


def store_dir(spark: SparkSession) -> str:
    """spark.scholia.store, else a folder in the shared one."""
    return spark.conf.get("spark.scholia.store", None) or f"{shared_dir(spark)}/scholia-store"


def kept(spark: SparkSession, key: str, name: str, build: Callable[[], DataFrame], order: list[str]) -> DataFrame:
    """The table `name` derived from the content `key`: read if it is stored whole, else built, sorted by its lookup columns and stored."""
    path = f"{store_dir(spark)}/{name}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        part = f"{store_dir(spark)}/{name}/part-{uuid.uuid4().hex}"
        build().repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(part)
        p, fs = _fs(spark, part)
        to = _fs(spark, path)[0]
        if not fs.exists(to):
            fs.rename(p, to)
        else:
            fs.delete(p, True)
    return spark.read.parquet(path)
