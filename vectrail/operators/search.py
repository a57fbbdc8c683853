"""Exact vector search: top k, threshold, paging, filters, and k nearest for a set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

DIGITS = 6
BLOCK = 2048
MOST_SLOTS = 4096


def ranked(rows: DataFrame, order: list[Column], limit: int | None = 10, offset: int = 0, name: str = "rank") -> DataFrame:
    """A page of the order, numbered from 1. The page is cut first, so the numbering sees no more than its rows."""
    page = rows.orderBy(*order)
    if offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def placed(rows: DataFrame, lead: list[Column], order: list[Column], steps: list[str], name: str = "place") -> DataFrame:
    """All rows with their place in the order ``lead`` and then ``order``. ``steps`` are the columns that ``lead`` sorts by, in
    coarse steps: rows are counted per step, and numbered within a step only, so no task sees them all."""
    counts = rows.groupBy(*steps).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(F.col(c).alias(f"_s_{c}") for c in steps), "_before")
    same = None
    for c in steps:
        one = rows[c].eqNullSafe(F.col(f"_s_{c}"))
        same = one if same is None else same & one
    within = F.row_number().over(Window.partitionBy(*steps).orderBy(*order))
    return rows.join(starts, same).withColumn(name, (F.col("_before") + within).cast("long")).select(*rows.columns, name)


def scored(rows: DataFrame, query, vector="embedding", metric="cosine", digits: int = DIGITS) -> DataFrame:
    """``rows`` with ``score``, a distance; rounded, so that equal distances tie and the id decides."""
    return rows.withColumn("score", F.round(V.distance(V.as_column(vector), query, metric), digits))


def top_k(rows: DataFrame, query, k: int = 10, vector="embedding", id_col="vec_id", metric="cosine", threshold: float | None = None, offset: int = 0, where: Column | None = None) -> DataFrame:
    """Nearest rows first, with ``score`` and ``rank``. A filter is applied before the distance is computed; the
    threshold keeps scores up to it, which in ascending order is the same before and after the cut."""
    if where is not None:
        rows = rows.where(where)
    rows = scored(rows, query, vector, metric)
    if threshold is not None:
        rows = rows.where(F.col("score") <= threshold)
    return ranked(rows, [F.col("score").asc(), F.col(id_col).asc()], k, offset)


def query_vector(rows: DataFrame, which: Column, vector="embedding") -> list[float]:
    """One vector, as a literal for a search."""
    return [float(x) for x in rows.where(which).select(vector).first()[0]]


def _blocks(rows: DataFrame, prefix: str, id_col: str, vector: str) -> DataFrame:
    """Rows of up to BLOCK vectors each: ids and numbers as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                data = np.array(part.column("v").to_pylist(), np.float64)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([data.shape[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], names=["dim", f"{prefix}_ids", f"{prefix}_data"])
    picked = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return picked.mapInArrow(pack, f"dim int, {prefix}_ids binary, {prefix}_data binary")


def knn_join(queries: DataFrame, rows: DataFrame, k: int, id_col="vec_id", vector="embedding", metric="cosine", skip_same=True) -> DataFrame:
    """``query_id, rank, neighbor_id, score``: the k nearest rows of every query.

    Queries and rows travel as blocks of BLOCK vectors; a block of queries meets a block of rows in one matrix product,
    which keeps k candidates per query, and candidates are merged by a window that keeps k per task before they are
    dealt. All vectors must have one dimension.
    """
    kind = V.METRICS[metric]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, qi, qd, ri, rd = (batch.column(c)[i].as_py() for c in ("dim", "q_ids", "q_data", "r_ids", "r_data"))
                q_ids, r_ids = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                q, r = np.frombuffer(qd).reshape(-1, dim), np.frombuffer(rd).reshape(-1, dim)
                if kind == "manhattan":
                    gap = np.stack([np.abs(r - x).sum(1) for x in q])
                elif kind == "euclidean":
                    gap = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * q @ r.T, 0))
                else:
                    gap = -(q @ r.T)
                    if kind == "cosine":
                        length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((r * r).sum(1))[None, :]
                        gap = np.where(length == 0, 0.0, 1 + gap / np.where(length == 0, 1, length))
                gap = np.round(gap, DIGITS) + 0.0
                if skip_same:
                    gap = np.where(q_ids[:, None] == r_ids[None, :], np.inf, gap)
                by = np.lexsort((np.broadcast_to(r_ids, gap.shape), gap), axis=1)[:, :k]
                best = np.take_along_axis(gap, by, 1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep.sum(1))), pa.array(r_ids[by][keep]), pa.array(best[keep])], names=["query_id", "neighbor_id", "score"])
    left, right = _blocks(queries, "q", id_col, vector), _blocks(rows, "r", id_col, vector)
    # every block of queries goes through every block of rows: blocks of rows are dealt to slots, and queries to all slots
    slots = max(1, min(MOST_SLOTS, rows.count() // BLOCK))
    right = right.withColumn("slot", F.pmod(F.xxhash64("r_ids"), F.lit(slots)))
    left = left.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    pairs = left.join(right, ["dim", "slot"])
    found = pairs.mapInArrow(run, "query_id long, neighbor_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "score")
