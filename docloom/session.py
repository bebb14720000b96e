"""Session settings every plan of the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "docloom", cpus: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session; under spark-submit the submitter's master and memory hold, and only the engine's settings are added."""
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # not started by spark-submit
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
