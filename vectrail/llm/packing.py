"""Packing documents into training sequences by variable-capacity best fit.

Several sequence lengths are permitted. Items are placed by decreasing length into the open bin that they fill
best; where none has room a new bin is opened, of the size that costs least for each place it would hold: every
permitted size is filled in thought with the longest items left that fit, downsized, and its cost (places plus
OVERHEAD) divided by what it holds. At the end each bin is downsized to the smallest permitted length that holds its
contents. As no rule of opening is best for all items, a shard is also packed with each single opening size, and the
packing of least total cost stays.

Documents longer than the longest sequence are cut into pieces of that length and a rest; nothing is dropped.

Best fit looks at all open bins, so rows are dealt into shards of about SHARD_ITEMS items by a hash, and each shard
is packed on its own in bounded memory; a shard of that many items leaves about one bin part empty. The number of
shards follows the number of items. Equal rows are counted and numbered before they are dealt, so that copies of
one document spread over all shards. The result depends on the rows only, not on their order or partitions.

Defined results: a document without words (also null text) has one row of length 0 without a bin; a null id is a
value like any other; equal rows are numbered by ``copy``; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, word_count

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD_ITEMS = 4096


def best_fit(lengths: list[int], capacities=CAPACITIES, opening: int | None = None, overhead: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each length, and each bin's size after downsizing. ``lengths`` must not rise. ``opening``: the size
    that new bins have (None: the smallest that holds the item). With ``overhead``, each new bin has the size of least cost
    for each place filled, and ``opening`` says nothing."""
    sizes = sorted(capacities)
    left = Counter(lengths)
    lying = sum(1 << n for n in left)  # bit n: an item of length n is left
    def cost(n: int, c: int) -> float:
        room, taken, some = c - n, Counter(), lying
        while some := some & ((1 << (room + 1)) - 1):
            most = some.bit_length() - 1
            count = min(left[most] - taken[most], room // most)
            taken[most] += count
            room -= count * most
            some &= ~(1 << most)
        return (next(x for x in sizes if x >= c - room) + overhead) / (c - room)
    room: dict[int, list[int]] = {}
    there = 0  # bit r: some bin has room r
    where, used, size = [], [], []
    for n in lengths:
        left[n] -= 1
        if not left[n]:
            lying &= ~(1 << n)
        fitting = there >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there &= ~(1 << r)
        else:
            least = next(c for c in sizes if c >= n)
            b, r = len(used), max(least, opening or 0) if overhead is None else min((c for c in sizes if c >= n), key=lambda c: (cost(n, c), c))
            used.append(0)
            size.append(r)
        used[b] += n
        r -= n
        room.setdefault(r, []).append(b)
        there |= 1 << r
        where.append(b)
    return where, [next(c for c in sizes if c >= u) for u in used]


def cheapest(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """The packing of least cost: each bin opened at its own size, or all at one."""
    tried = [best_fit(lengths, capacities, overhead=overhead)] + [best_fit(lengths, capacities, opening) for opening in (None, *sorted(capacities))]
    return min(tried, key=lambda x: sum(x[1]) + overhead * len(x[1]))


def packed(docs: DataFrame, id_col="doc_id", text_col="text", capacities=CAPACITIES, overhead=OVERHEAD, shard_items=SHARD_ITEMS) -> DataFrame:
    """One row per piece: ``doc_id, copy, start, length`` (in words) and ``bin, capacity, filled, offset``."""
    most = max(capacities)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    counted = staged(sized.groupBy("doc_id", "size").agg(F.count("*").alias("n")))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / most), F.lit(1)) - 1))
    pieces = counted.select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("doc_id", "size", "copy", piece.alias("piece"))
    pieces = pieces.select("doc_id", "copy", (F.col("piece") * most).alias("start"), F.least(F.col("size") - F.col("piece") * most, F.lit(most)).alias("length"))
    total = counted.agg(F.sum(F.col("n") * F.greatest(F.ceil(F.col("size") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_items))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "copy", "start"), F.lit(shards)).alias("shard")
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "copy", "start"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        where, sizes = cheapest(rows["length"].tolist(), capacities, overhead)
        rows["bin"] = [f"{rows['shard'].iat[0]}-{b}" for b in where]
        by = rows["length"].groupby(pd.Series(where))
        rows["filled"], rows["offset"] = by.transform("sum"), by.cumsum() - rows["length"]
        rows["capacity"] = [sizes[b] for b in where]
        return rows[["doc_id", "copy", "start", "length", "bin", "capacity", "filled", "offset"]]
    schema = "doc_id long, copy long, start long, length long, bin string, capacity long, filled long, offset long"
    full = pieces.where("length > 0").withColumn("shard", shard).groupBy("shard").applyInPandas(pack, schema)
    none = F.lit(None)
    empty = pieces.where("length = 0").select("doc_id", "copy", "start", "length", none.cast("string").alias("bin"), *(none.cast("long").alias(c) for c in ("capacity", "filled", "offset")))
    return full.unionByName(empty)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
