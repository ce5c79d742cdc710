"""A session with the settings that the queries of this library are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable; AQE coalesces, splits skewed joins and re-plans at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "weftline", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session on `cores` cores; on a cluster, spark-submit's settings win over these."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "6g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; checkpoints go there. Only a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting itself cannot be changed in a running session; the context's folder can.
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftline-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")
