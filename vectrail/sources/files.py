"""Import and export of documents and log entries, backups, databases and object stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "jsonl", "csv", "text", "orc")


def read_documents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON file that holds an array of documents; a schema avoids a pass over the file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """Rows of a database; with a column and bounds, read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()
    return reader.option("query", query).load()


def export(rows: DataFrame, path: str, kind: str = "parquet", codec: str | None = None, text_columns: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write rows; ``json`` and ``jsonl`` are lines of JSON, ``text`` joins the columns by blanks."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind == "text":
        rows = rows.select(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in text_columns or rows.columns)).alias("value"))
    writer = rows.write.mode(mode)
    if codec:
        writer = writer.option("compression", codec)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format("json" if kind == "jsonl" else kind).save(path)


def savings(plain_bytes: int, packed_bytes: int) -> dict[str, float]:
    """Ratio and saved percentage of a codec."""
    return {"ratio": plain_bytes / packed_bytes if packed_bytes else 0.0, "savings_percent": 100 * (1 - packed_bytes / plain_bytes) if plain_bytes else 0.0}


def backup(rows: DataFrame, folder: str, name: str, since=None, changed: str | None = None) -> str:
    """A full copy, or with ``since`` and a column of change times an incremental one."""
    if since is not None:
        rows = rows.where(F.col(changed) > F.lit(since))
    path = f"{folder.rstrip('/')}/{name}"
    rows.write.parquet(path)
    return path


def restore(spark: SparkSession, full: str, increments: list[str], id_col: str, order_col: str) -> DataFrame:
    """The newest row of every id over a full copy and its increments."""
    from ..operators.changes import latest_version

    rows = spark.read.parquet(full, *increments)
    return latest_version(rows, id_col, order_col)
