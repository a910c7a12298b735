"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What local runs set; a cluster brings its own settings.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("shardloom")
    builder = builder.config(map=LOCAL_CONF).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
