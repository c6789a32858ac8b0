"""Session helpers: recommended settings, the shared scratch folder, size checks."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime SQL settings the plans rely on; none of them fixes a partition count.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # joins whose measured build side is this small per task need no sort
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # tasks stay as small where the feed grows: many partitions to begin with, joined up to this size, and short splits
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # a zstd file's rows take about ten times its bytes in memory: planned by its size alone, far too large sides are sent through the driver
    "spark.sql.sources.fileCompressionFactor": "8",
    # half the bytes of staged frames for about the same time
    "spark.sql.parquet.compression.codec": "zstd",
    # what a finished query shuffled is read by none after it; else it stays until the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # the JVM only ever interprets methods beyond this size; the plan without them is compiled in small ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose data with the executor that wrote it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "millrace-shared")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches need the same expensive frame: the files survive
    the loss of executors and cut the lineage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_bytes: int) -> bool:
    """Whether all rows of ``df``, as text, have at most ``max_bytes``: one aggregation measures them."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= max_bytes


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove files or folders of finished work; one that is gone already is fine."""
    for path in paths:
        system, where = _file_system(spark, path)
        system.delete(where, True)


def unstage(*frames: DataFrame) -> None:
    """Remove what ``stage`` wrote for frames that are no longer read."""
    for df in frames:
        remove(df.sparkSession, *{os.path.dirname(f) for f in df.inputFiles()})
