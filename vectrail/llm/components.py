"""Connected components of an edge table, by large and small stars.

Every round sends each node's neighbours to the smallest of them (first the larger neighbours, then the others), so
long paths halve; it ends when no edge changes. Only minima are gathered per node, so a node with any number of
neighbours costs no task more than its share, and every round ends in files in the shared folder. Up to FEW_EDGES edges
are joined by the driver instead, with the same result, which saves the rounds' jobs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Edges that the driver may join: some 2 MB.
FEW_EDGES = 100_000


def _joined(a: list[int], b: list[int]) -> dict[int, int]:
    """The smallest node of its component for every node of the edges."""
    up: dict[int, int] = {}
    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top
    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of each component) for every node of the edges ``a, b`` (long), staged."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= FEW_EDGES:
        few = edges.toArrow()
        found = _joined(few["a"].to_pylist(), few["b"].to_pylist())
        both = pa.table({"node": pa.array(found.keys(), pa.int64()), "component": pa.array(found.values(), pa.int64())})
        out = staged(edges.sparkSession.createDataFrame(both, "node long, component long"))
        release(edges)
        return out
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = staged(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # b < a throughout
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        old, edges = edges, staged(small.where("a <> b").distinct())
        release(old, large)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = staged(own.union(own.select(F.col("component").alias("node"), "component").distinct()))
    release(edges)
    return out
