"""Windowed aggregates that run alike on a table and on a stream, and streaming operators.

On a stream, a watermark bounds state and rows that come later than it are dropped; on a table it has no effect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import online_step

LATE = "10 minutes"


def _timed(rows: DataFrame) -> DataFrame:
    """Event time as a timestamp where a watermark needs one."""
    if not rows.isStreaming:
        return rows
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def _plain(column: str, rows: DataFrame):
    return F.col(column).cast("timestamp_ntz")


def tumbling_counts(rows: DataFrame) -> DataFrame:
    """Entries per minute and type."""
    out = _timed(rows).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(_plain("w.start", rows).alias("start"), "event_type", "n")


def sliding_latency(rows: DataFrame) -> DataFrame:
    """Number and mean of values in windows of ten minutes, every five."""
    out = _timed(rows).groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(_plain("w.start", rows).alias("start"), _plain("w.end", rows).alias("stop"), "n", "mean")


def session_counts(rows: DataFrame) -> DataFrame:
    """Sessions of each user, ended by half an hour without entries."""
    out = _timed(rows).groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", _plain("w.start", rows).alias("start"), _plain("w.end", rows).alias("stop"), "n")


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over what is there, writing Parquet; exactly once by its checkpoint."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


class OnlineKMeans:
    """Streaming k-means by ``foreachBatch``; centroids and weights are on the driver (k is small). A batch that is
    repeated after a failure is applied once, by its number."""

    def __init__(self, centroids: list[tuple[int, list[float]]], decay: float = 0.0, vector: str = "embedding", most_rows: int = 1000) -> None:
        self.model = {k: (list(c), 1.0) for k, c in centroids}
        self.decay, self.vector, self.most_rows, self.seen = decay, vector, most_rows, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen:
            return
        # rows come to the driver piece by piece, most_rows at a time
        part: list = []
        for row in batch.where(F.col(self.vector).isNotNull()).select(self.vector).toLocalIterator():
            part.append(row[0])
            if len(part) == self.most_rows:
                self.update(np.array(part, np.float64))
                part = []
        if part:
            self.update(np.array(part, np.float64))
        self.model = {k: (c, w * (1 - self.decay)) for k, (c, w) in self.model.items()}
        self.seen = number

    def update(self, points: np.ndarray) -> None:
        self.model = online_step(self.model, points)

    def centroids(self) -> list[tuple[int, list[float]]]:
        return [(k, c) for k, (c, _) in sorted(self.model.items())]


class ChangeSink:
    """Applies change batches to a versioned Parquet folder by ``foreachBatch``: deletes, then updates, then inserts.

    Version ``v<n>`` belongs to batch n, so a repeated batch overwrites its own version and changes nothing else."""

    def __init__(self, folder: str, id_col: str = "id") -> None:
        self.folder, self.id_col = folder, id_col

    def version(self, number: int) -> str:
        return f"{self.folder}/v{number}"

    def __call__(self, changes: DataFrame, number: int) -> None:
        from ..operators.changes import apply_changes

        spark = changes.sparkSession
        rows = changes.drop("op", "at").limit(0) if number == 0 else spark.read.parquet(self.version(number - 1))
        apply_changes(rows, changes, self.id_col).write.mode("overwrite").parquet(self.version(number))


#: Share of a buffer that is filled, from which its state is named so.
BUFFER_LEVELS = ((0.95, "critical"), (0.8, "warning"), (0.0, "healthy"))


def buffer_health(filled: int, size: int) -> str:
    share = filled / size if size else 0.0
    return next(name for least, name in BUFFER_LEVELS if share >= least)
