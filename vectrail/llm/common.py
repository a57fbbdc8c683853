"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Used where a session on one machine names no shared folder, as in tests.
OWN_SHARED = "/tmp/checkpoints/vectrail"
#: Spark's switch that removes the shuffle files of a query when it ends, instead of when the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at once while a frame is staged: whole texts of 10,000 rows take some 40 MB on each side.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or OWN_SHARED).rstrip("/")


#: Paths of staged frames with a weak reference to the file index that every plan on them holds; of this driver.
_STAGED: dict[str, object] = {}


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def sweep(spark: SparkSession) -> None:
    """Delete staged frames that no plan can read any more."""
    for path, index in list(_STAGED.items()):
        if index.get() is None:
            _STAGED.pop(path, None)
            _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Delete staged frames whose last reader is done; frames derived from them can't be read afterwards."""
    for frame in frames:
        if _STAGED.pop(frame.staged_at, None) is not None:
            _delete(frame.sparkSession, frame.staged_at)


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    before = {x: spark.conf.get(x, None) for x in (TIDY, BATCH)}
    spark.conf.set(TIDY, "true")
    spark.conf.set(BATCH, min(int(before[BATCH] or BATCH_ROWS), BATCH_ROWS) if int(before[BATCH] or 1) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        for x, value in before.items():
            spark.conf.unset(x) if value is None else spark.conf.set(x, value)


def staged(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends in files that outlive executors.

    The files go by ``release``, or when no plan refers to them any more, or with the application.
    """
    spark = df.sparkSession
    sweep(spark)
    root = f"{shared_dir(spark)}/vectrail-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _STAGED[path] = spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns of the frame as one struct, whatever their names hold."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Rows of a key that may be broadcast: some tens of MB. Beyond it, callers go another way to the same result.
MOST_BROADCAST = 500_000


def few(keys: DataFrame) -> DataFrame | None:
    """The distinct keys, marked for broadcast, if there are at most MOST_BROADCAST; keys should be staged."""
    keys = keys.distinct()
    return F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else None


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
