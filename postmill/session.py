"""Session settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Relative dates, md5 keys and run windows are only reproducible in one fixed zone.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "postmill", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **REQUIRED,
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the results depend on, leaving the caller's resources and paths alone."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
