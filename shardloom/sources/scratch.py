"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from shardloom.errors import InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, as in tests, gets a temporary folder where that is unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shardloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder; the file system deletes it when the driver ends."""
    own = f"{shared_dir(spark)}/shardloom/{spark.sparkContext.applicationId}"
    path, fs = _path(spark, own)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that weren't written elsewhere can't be read afterwards."""
    path, fs = _path(spark, f"{shared_dir(spark)}/shardloom/{spark.sparkContext.applicationId}")
    fs.delete(path, True)


#: Spark's own setting by which a query's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once as a Parquet table into the shared folder and read it back.

    Unlike a checkpoint it computes df once, survives the loss of executors, and the reader knows its size, so
    that Catalyst decides about broadcasts by measured bytes. An empty df gives an empty table of the same schema.
    The shuffle files of the write are deleted after it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a materialized table that no plan reads any more."""
    path, fs = _path(table.sparkSession, table._scratch)
    fs.delete(path, True)
