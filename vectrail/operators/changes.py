"""Upserts, partial updates, change feeds, versions and point-in-time selection, on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _once(changes: DataFrame, id_col: str, order_col: str | None, newest: bool = True) -> DataFrame:
    """One change per id, by ``order_col`` or else by its place in the batch; null ids stay as they are."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    placed = changes.withColumn("_at", order)
    window = Window.partitionBy(id_col).orderBy(F.col("_at").desc() if newest else F.col("_at"))
    return placed.withColumn("_n", F.row_number().over(window)).where((F.col("_n") == 1) | F.col(id_col).isNull()).drop("_n", "_at")


def upsert(rows: DataFrame, changes: DataFrame, id_col: str, mode: str = "upsert", order_col: str | None = None) -> DataFrame:
    """``insert`` keeps rows that exist, ``update`` only replaces them, ``upsert`` does both. Of several changes of one id
    the newest counts (for ``insert`` the first), by ``order_col`` or by their place in the batch."""
    if mode not in ("insert", "update", "upsert"):
        raise ValueError(f"unknown mode {mode}")
    changes = _once(changes, id_col, order_col, newest=mode != "insert").select(rows.columns)
    if mode == "insert":
        return rows.unionByName(changes.join(rows.select(id_col), id_col, "left_anti").select(rows.columns))
    kept = rows.join(changes.select(id_col), id_col, "left_anti").select(rows.columns)
    if mode == "update":
        changes = changes.join(rows.select(id_col), id_col, "left_semi")
    return kept.unionByName(changes.select(rows.columns))


def partial_update(rows: DataFrame, patches: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """Fields that a patch holds (not null) replace those of its row; of several patches the newest that holds the field."""
    fields = [c for c in patches.columns if c not in (id_col, order_col)]
    placed = patches.withColumn("_at", F.col(order_col) if order_col else F.monotonically_increasing_id())
    merged = placed.groupBy(id_col).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fields))
    joined = rows.alias("r").join(merged.alias("p"), F.col(f"r.{id_col}") == F.col(f"p.{id_col}"), "left")
    return joined.select(*(F.coalesce(f"p.{c}", f"r.{c}").alias(c) if c in fields else F.col(f"r.{c}").alias(c) for c in rows.columns))


def delete_by_id(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return rows.join(ids.select(id_col), id_col, "left_anti").select(rows.columns)


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return rows.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null keeps a row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def apply_changes(rows: DataFrame, changes: DataFrame, id_col: str, op_col: str = "op", order_col: str = "at") -> DataFrame:
    """A feed of ``insert``, ``update`` and ``delete`` (also ``purge``) on a table: the newest change of an id counts."""
    latest = latest_version(changes, id_col, order_col)
    gone = latest.where(F.col(op_col).isin("delete", "purge"))
    new = latest.where(F.col(op_col).isin("insert", "update"))
    return delete_by_id(rows, gone.unionByName(new), id_col).unionByName(new.select(rows.columns))


def latest_version(rows: DataFrame, key: str, order_col: str, *ties: str) -> DataFrame:
    """The newest row of every key. The window keeps one row per key and task before rows are dealt."""
    newest = Window.partitionBy(key).orderBy(F.col(order_col).desc(), *(F.col(t).desc() for t in ties))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def snapshot(versions: DataFrame, key: str, version: str, tombstone: Column, at, *ties: str) -> DataFrame:
    """What a reader at ``at`` sees: each key's newest version up to it, unless that is a tombstone."""
    return latest_version(versions.where(F.col(version) <= at).withColumn("_gone", tombstone), key, version, *ties).where(~F.col("_gone")).drop("_gone")


def kept_versions(versions: DataFrame, key: str, version: str, most: int = 10) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.col(version).desc())
    return versions.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def point_in_time(backups: DataFrame, target, at: str = "at", kind: str = "kind") -> DataFrame:
    """The newest backup up to the target and all incremental ones after it, up to the target."""
    target = F.lit(target).cast("timestamp_ntz") if isinstance(target, str) else target
    before = backups.where(F.col(at) <= target)
    base = before.where(F.col(kind) != "incremental").agg(F.max(at).alias("_base"))
    return before.join(F.broadcast(base)).where((F.col(at) == F.col("_base")) & (F.col(kind) != "incremental") | (F.col(at) > F.col("_base")) & (F.col(kind) == "incremental")).drop("_base")


def compaction_policy(writes: Column, reads: Column) -> Column:
    """By the ratio of writes to reads."""
    ratio = writes / F.greatest(reads, F.lit(1))
    return F.when(ratio > 5, "universal").when(ratio < 0.2, "level").when((ratio > 2) | (ratio < 0.5), "fifo").otherwise("adaptive")
