"""Mixing sources to target weights by systematic sampling [native].

Each document of a source is expected ``target / source size`` times. Documents stand in one order within
their source (size, then the MD5 of the id), their expected copies are summed up along it, one random offset
is added, and a copy is emitted for each integer crossed. Ordering by size keeps the words taken close to the
target: whatever stretch of the order is looked at, the number of copies is off by less than one.

The running sum needs no task that sees a whole source: every document of a source is expected equally often,
so the sum is a rank times a constant, and the rank comes from counts of (source, size), counts of
(source, size, leading digits of the MD5) and a row number inside the latter. The number of digits follows the
number of rows, so that a source, or one size within it, that holds most rows is split into small groups.

Defined results: null text has size 0; null sources form one source, the last; a source without words gets
target 0 and no copies; equal rows are told apart arbitrarily, which changes no result; a null id sorts as ''.
An empty table gives an empty result. Extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, staged, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 20240607
#: Rows that a group of equal source, size and digits holds on average at most, if one pair had all rows.
GROUP_ROWS = 4096


def offset(seed: int = SEED) -> float:
    """The random offset in [0, 1)."""
    return round(random.Random(seed).random(), 9)


def digits_for(rows: int) -> int:
    """Hexadecimal digits that split ``rows`` rows into groups of about GROUP_ROWS."""
    return min(8, max(1, math.ceil(math.log(max(rows, 1) / GROUP_ROWS, 16)))) if rows > GROUP_ROWS else 1


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: ``source, rank, source_size, target`` from rows of ``source, size``.

    Weights repeat along the sources in code point order, null last. A target stops at ``cap`` times the size of
    its source and the excess goes to the others by weight. Filled to a common level per weight, sources reach
    their cap in the order of size over weight, so the level follows from running sums; there is no loop.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("rank").asc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    filled = (
        totals.withColumn("rank", F.row_number().over(by_rank)).withColumn("w", w)
        .withColumn("caps", F.sum(F.col("source_size") * cap).over(by_fill))
        .withColumn("rest", F.sum("w").over(everything) - F.sum("w").over(by_fill))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.col("caps") * F.col("w") + F.col("source_size") * cap * F.col("rest") <= F.lit(share) * F.col("total") * F.col("w"))
        .withColumn("used", F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything))
    )
    level = F.col("w") * (F.lit(share) * F.col("total") - F.col("used")) / F.col("open")
    return filled.select("source", "rank", "source_size", F.when(F.col("full"), F.lit(float(cap)) * F.col("source_size")).otherwise(level).alias("target"))


def systematic_mix(docs: DataFrame, keep=("doc_id",), id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """Per row of ``docs``: struct ``kept`` of the columns in ``keep``, ``size, source_size, target, copies``."""
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*map(quoted, keep)).alias("kept"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    small = staged(rows.select("source", "size", F.substring("key", 1, 8).alias("key")))
    prefix = F.substring("key", 1, digits_for(small.count())).alias("h")
    per_source = staged(targets(small, weights, share, cap))
    cells = small.select("source", "size", prefix).groupBy("source", "size", "h").agg(F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    wide = cells.groupBy("source", "size").agg(F.sum("n").alias("m"))
    wide = wide.select("source", "size", F.coalesce(F.sum("m").over(before("source", "size")), F.lit(0)).alias("lower"))
    cells = cells.select("source", "size", "h", F.coalesce(F.sum("n").over(before("source", "size", "h")), F.lit(0)).alias("inner"))
    a, b, c = cells.alias("a"), wide.alias("b"), per_source.alias("c")
    join_on = lambda l, r, *names: F.expr(" and ".join(f"{l}.{x} <=> {r}.{x}" for x in names))
    starts = a.join(b, join_on("a", "b", "source", "size")).join(c, join_on("a", "c", "source"))
    starts = starts.select("a.source", "a.size", "a.h", (F.col("lower") + F.col("inner")).alias("start"), "source_size", "target")
    own = Window.partitionBy("source", "size", "h").orderBy("key")
    ranked = rows.withColumn("h", prefix).withColumn("n", F.row_number().over(own))
    full = ranked.alias("d").join(starts.alias("s"), join_on("d", "s", "source", "size", "h"))
    upto = lambda rank: F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * rank + F.lit(offset(seed)))
    rank = F.col("start") + F.col("n")
    return full.select("kept", F.col("d.size").alias("size"), "source_size", "target", (upto(rank) - upto(rank - 1)).cast("long").alias("copies"))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    mixed = systematic_mix(docs, keep=docs.columns, **how).where("copies > 0")
    return mixed.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("kept.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = systematic_mix(table(spark, sf_dir, "documents"))
    return mixed.select("kept.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = {
    "op8_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((rank - 1) % {len(WEIGHTS)})::INT + 1]::BIGINT AS w FROM s),
f AS (SELECT *, sum(source_size * {CAP}) OVER fill AS caps, sum(w) OVER () - sum(w) OVER fill AS rest, sum(source_size) OVER () AS total
      FROM w WINDOW fill AS (ORDER BY source_size::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (caps * w + source_size * {CAP} * rest)::DOUBLE <= {SHARE}::DOUBLE * total::DOUBLE * w::DOUBLE AS at_cap FROM f),
h AS (SELECT *, sum(CASE WHEN at_cap THEN source_size * {CAP} ELSE 0 END) OVER () AS used, sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () AS open FROM g),
t AS (SELECT source, source_size, CASE WHEN at_cap THEN {CAP}::DOUBLE * source_size::DOUBLE
             ELSE w::DOUBLE * ({SHARE}::DOUBLE * total::DOUBLE - used::DOUBLE) / open::DOUBLE END AS target FROM h),
r AS (SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, key) AS n,
             CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(c * n + {offset()}::DOUBLE) - floor(c * (n - 1) + {offset()}::DOUBLE))::BIGINT * size)::BIGINT AS taken
FROM r""",
}
QUERIES = {"op8_mixing": op8_mixing}
