"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it; every scan prunes columns and pushes filters from here."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL text."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
