"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length 1, where a larger cosine is a smaller Euclidean distance, and projected to PROJECTED
dimensions by a fixed matrix of normal numbers. The squared projected distance over the squared distance then
follows a chi-square law, whatever the vectors. Rows are dealt into shards, and each shard keeps its projections in
a kd-tree. A query takes the leaves of the tree in the order of their projected distance and verifies their vectors
with the true distance, until the chi-square test holds: a vector that is nearer than the k-th found so far would,
with probability STOP, have been met already. Shards' results are merged by rank.

Equal vectors are one entry of the index with their k + 1 smallest distinct ids, so no group of copies is searched, or
gathered, more than once; a query asks for as many more entries as hold its own id. The index holds every row; queries come in blocks that are joined with shards by number, and
each pair of block and shard is handled on its own in bounded memory.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id; a query meets only vectors of its own dimension; rows of the query's id are not its candidates; equal
rows count once; with fewer than k candidates all are returned; ties go to the smaller id; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

PROJECTED = 8  # even, for the closed form of the chi-square law
LEAF = 256
STOP = 0.95
SEED = 7
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
EVERY = 50
K = 5


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTED))


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function for PROJECTED degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(PROJECTED // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree as its leaves: order of the points, first point of each leaf and the end, lower and upper corners."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        part = points[order[a:b]]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
        todo += [(a + middle, b), (a, a + middle)]
    starts = np.array(sorted(starts))
    placed = points[order]
    return order, np.append(starts, len(points)), np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)


class Index:
    """The vectors of a shard, one entry per distinct vector."""

    def __init__(self, vectors: np.ndarray, ids: list) -> None:
        self.vectors = vectors.astype(np.float64)
        self.ids = ids
        self.unit = self.vectors / np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))[:, None]
        self.matrix = projection(vectors.shape[1])
        order, self.starts, self.low, self.high = build(self.unit @ self.matrix)
        self.order = order
        self.unit = self.unit[order]
        self.least = np.array([i[0] for i in ids])[order]

    def nearest(self, queries: np.ndarray, k: int, stop: float = STOP) -> np.ndarray:
        """For each query the k nearest entries found (their numbers, -1 where there are fewer)."""
        unit = queries / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        low = unit @ self.matrix
        apart = np.zeros((len(low), len(self.low)))
        for j in range(PROJECTED):
            apart += np.maximum(np.maximum(self.low[None, :, j] - low[:, None, j], low[:, None, j] - self.high[None, :, j]), 0) ** 2
        turn = np.argsort(apart, axis=1, kind="stable")
        apart = np.take_along_axis(apart, turn, 1)
        best = np.full((len(unit), k), -1)
        gap = np.full((len(unit), k), np.inf)
        first = np.full((len(unit), k), np.iinfo(np.int64).max)
        active = np.arange(len(unit))
        for t in range(len(self.low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                done = chi_square(np.where(np.isinf(gap[active, -1]), 0, apart[active, t] / np.maximum(gap[active, -1], 1e-12))) >= stop
            active = active[~done]
            if not len(active):
                break
            leaves = turn[active, t]
            for leaf in np.unique(leaves):
                rows = active[leaves == leaf]
                at = np.arange(self.starts[leaf], self.starts[leaf + 1])
                new = np.round(2 - 2 * (unit[rows] @ self.unit[at].T), 12)
                better = new.min(1) <= gap[rows, -1]
                if not better.any():
                    continue
                rows, new = rows[better], new[better]
                if len(at) > k:
                    close = np.partition(new, k - 1, axis=1)[:, k - 1 : k]
                    some = np.flatnonzero((new <= close).any(0))
                    at, new = at[some], new[:, some]
                gaps = np.hstack([gap[rows], new])
                numbers = np.hstack([best[rows], np.broadcast_to(at, new.shape)])
                least = np.hstack([first[rows], np.broadcast_to(self.least[at], new.shape)])
                pick = np.lexsort((least, gaps), axis=1)[:, :k]
                gap[rows], best[rows], first[rows] = (np.take_along_axis(x, pick, 1) for x in (gaps, numbers, least))
        return np.where(best >= 0, self.order[best], -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of ``a`` with the same rows of ``b``, in double precision."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def usable(vector: Column) -> Column:
    """No null, no component null or not finite, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, stop: float = STOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows of ``vec_id, vector`` (array of double)."""
    ranked = Window.partitionBy("vector").orderBy("vec_id")
    some = vectors.select("vec_id", "vector").distinct().withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    entries = staged(some.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector")))
    counts = entries.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / SHARD_ROWS).cast("int")
    entries = entries.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), shards).cast("int"))
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate([np.asarray(x, dtype=np.float64) for x in rows["vector"]])
        ids = [np.asarray(x, dtype=np.int64) for x in rows["ids"]]
        return pd.DataFrame({"dim": [rows["dim"].iat[0]], "shard": [rows["shard"].iat[0]], "flat": [flat.tobytes()], "ids": [np.concatenate(ids).tobytes()], "sizes": [np.array([len(x) for x in ids]).tobytes()]})
    index = staged(entries.select("dim", "shard", "vector", "ids").groupBy("dim", "shard").applyInPandas(pack, "dim int, shard int, flat binary, ids binary, sizes binary"))
    asked = queries.distinct().withColumn("dim", F.size("vector"))
    blocks = asked.groupBy("dim").agg(F.count("*").alias("q"))
    asked = asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("q") / BLOCK_ROWS)).cast("int"))
    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [rows["dim"].iat[0]], "q_flat": [np.concatenate([np.asarray(x, dtype=np.float64) for x in rows["vector"]]).tobytes()], "q_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()]})
    asked = asked.select("dim", "block", "vec_id", "vector").groupBy("dim", "block").applyInPandas(gather, "dim int, q_flat binary, q_ids binary")
    asked = asked.join(counts, "dim").select("dim", "q_flat", "q_ids", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                sizes = np.frombuffer(row["sizes"], np.int64)
                ids = np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(sizes)[:-1])
                whole = Index(np.frombuffer(row["flat"]).reshape(-1, row["dim"]), ids)
                asked_ids, vectors = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_flat"]).reshape(-1, row["dim"])
                held, times_held = np.unique(np.concatenate(ids), return_counts=True)
                place = np.minimum(np.searchsorted(held, asked_ids), len(held) - 1)
                own = np.where(held[place] == asked_ids, times_held[place], 1)  # entries that may be the query's own id alone
                parts = []
                for extra in np.unique(own):
                    some = np.flatnonzero(own == extra)
                    found = whole.nearest(vectors[some], int(min(k + extra, len(ids))), stop)
                    at, nth = np.nonzero(found >= 0)
                    parts.append((some[at], found[at, nth]))
                q, entry = (np.concatenate(x) for x in zip(*parts, strict=True))
                score = cosine(vectors[q], whole.vectors[entry])
                times = sizes[entry]
                owner, other = np.repeat(asked_ids[q], times), np.concatenate([ids[e] for e in entry]) if len(entry) else np.zeros(0, np.int64)
                keep = owner != other
                yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(np.repeat(q, times)[keep]), pa.array(other[keep]), pa.array(np.repeat(score, times)[keep])], names=["query_id", "row", "vec_id", "score"])
    hits = asked.join(index, ["dim", "shard"]).select("dim", "q_flat", "q_ids", "flat", "ids", "sizes").mapInArrow(run, "query_id long, row long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op4_neighbours": op4_neighbours}
SQL: dict[str, str] = {}
