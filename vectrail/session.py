"""SparkSession with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "vectrail", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster, use the session that the cluster gives and only ``configure`` it."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VECTRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """The settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
