"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each of REGISTERS registers keeps the smallest of exponentially
distributed hashes of the set, on an exponentially spaced scale of base B, truncated to 16 bits. Registers of a union
are the larger of both, and two sets agree in a register about as often as their Jaccard similarity. Bands of ROWS
registers are hashed; documents that share a band are candidates. From the registers of a pair and the known set
sizes the similarity is estimated jointly by likelihood; pairs that are far below the threshold beyond doubt
(ratio of likelihoods, DOUBT) are dropped, and all others are verified on the full sets.

Rows of equal sets are one node, so copies never meet each other. Links are wanted for their components, which
leaves out most pairs of a large group:

1. in every bucket, all are compared with one member, the one that meets most others over all its bands;
2. where that leaves several components in a bucket, its members are compared with the LEADS least edited of them;
3. in buckets that are still open, pairs of different components are verified that three bounds allow to be linked.

The bounds are exact: the sizes; with ``s`` shingles that occur in another node, a pair shares at most the smaller
``s``; and sets differ in at least as many elements as cells of a fixed number hold an odd number of elements of just
one of them. A copy with edits of its own has hardly a pair left, so a large group of such copies yields few. No bucket
is capped.
A link is missed only if no band agrees, at similarity 0.85 with probability 4e-7 and at 0.8 with 3e-5.

Defined results: null, empty or blank texts have no shingles, no links, and are kept; a null id is not reachable as
the smallest id, and is one's own component where all ids are null; rows of one id and different texts are different
documents; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored unless named
in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, few, release, row_of, staged, table
from .components import components
from .shingles import chunks, mix, shingle_sets

REGISTERS, ROWS = 80, 4
B, RATE, TOP = 1.001, 20.0, 65535
DOUBT = 25.0
#: Members that an open bucket is compared with before its pairs are gone through.
LEADS = 3
SEED = 11
PARITIES = 1024
#: Finds the first character of a word, which costs less than a count of the words.
NOT_BLANK = WORD.removesuffix("+")
_SALT = np.random.default_rng(SEED).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Set elements that are hashed at once.
PART = 1 << 16


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that have an element each."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    sizes = np.array([len(s) for s in sets])
    a = 0
    while a < len(sets):
        b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), PART, "right")) + a)
        x = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum(sizes[a : b - 1])])
        for i in range(REGISTERS):
            y = (x ^ _SALT[0, i]) * _SALT[1, i]
            out[a:b, i] = np.minimum.reduceat(y, starts)
        a = b
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(B)), 0, TOP).astype(np.uint16)


def bands(found: np.ndarray) -> np.ndarray:
    """A key per band: all of its registers, with the band's number mixed in."""
    packed = np.ascontiguousarray(found).view("<u8")
    return mix(packed ^ mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64))[None, :]).astype(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Per set, which of PARITIES cells hold an odd number of its elements, as longs of 64 bits."""
    out = []
    for a in range(0, len(sets), 1024):
        part = sets[a : a + 1024]
        cell = (np.concatenate(part) >> np.uint64(20)).astype(np.int64) % PARITIES
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        odd = np.bincount(owner * PARITIES + cell, minlength=len(part) * PARITIES) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(len(part), PARITIES), axis=1).view("<i8"))
    return np.concatenate(out) if out else np.zeros((0, PARITIES // 64), np.int64)


def _apart(x: str, y: str):
    """At least so many elements are in only one of two sets: the cells whose parities differ."""
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(PARITIES // 64)))


def estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of pairs of registers and set sizes, and its log likelihood over that at the threshold."""
    more, less = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - more - less
    share = nu / (nu + nv)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(share[:, None] - (1 - share[:, None]) * j), p((1 - share[:, None]) - share[:, None] * j)
        c = np.maximum(1 - a - b, 1e-12)
        return more[:, None] * np.log(np.maximum(a, 1e-12)) + less[:, None] * np.log(np.maximum(b, 1e-12)) + same[:, None] * np.log(c)
    most = np.minimum(nu, nv) / np.maximum(nu, nv)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    values = likelihood(grid)
    best = values.argmax(1)
    at = np.minimum(threshold, most)[:, None]
    return np.take_along_axis(grid, best[:, None], 1)[:, 0], values.max(1) - likelihood(at)[:, 0]


def sketched(docs: DataFrame, k: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, th, n, fp, bands, registers, odd`` per row; ``fp`` stands for the set, ``th`` for the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, begin in chunks(batch.column("text")):
                sets = shingle_sets(data, begin, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                some = registers([sets[i] for i in full]) if full else np.zeros((0, REGISTERS), np.uint16)
                keys: list = [None] * (b - a)
                regs: list = [None] * (b - a)
                odds: list = [None] * (b - a)
                odd = parities([sets[i] for i in full])
                prints: list = [None] * (b - a)
                for i, row, key, cells in zip(full, some, bands(some) if full else [], odd, strict=True):
                    odds[i], keys[i], regs[i], prints[i] = cells, key, row.tobytes(), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary()), pa.array(odds, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n", "fp", "bands", "registers", "odd"],
                )
    return rows.mapInArrow(run, "doc_id long, th long, n long, fp binary, bands array<long>, registers binary, odd array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``node, n, items`` (sorted set as bytes) for rows of ``node, doc_id, th, fp``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    known = few(wanted.select("th"))
    if known is not None:  # only their texts need to be dealt
        rows = rows.join(known, "th", "left_semi")
    rows = rows.alias("d").join(wanted.alias("w"), F.expr("d.th = w.th and d.doc_id <=> w.doc_id")).select("node", "fp", "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, begin in chunks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(data, begin, k)]
                fits = [hashlib.blake2b(s, digest_size=16).digest() == p for s, p in zip(sets, batch.column("fp").slice(a, b - a).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(fits), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["node", "fits", "n", "items"])
    found = rows.mapInArrow(run, "node long, fits boolean, n long, items binary").where("fits").drop("fits")
    return found.dropDuplicates(["node"])


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that their sizes and registers do not rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"), F.col("odd").alias(f"o{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    rows = rows.where((100 + percent) * _apart("oa", "ob") <= (100 - percent) * (F.col("na") + F.col("nb")))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in ("ra", "rb"))
                nu, nv = (batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in ("na", "nb"))
                j, gap = estimate(u, v, nu, nv, percent / 100)
                keep = pa.array((j >= percent / 100) | (gap < DOUBT))
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("a", "b")], names=["a", "b"])
    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"s{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, th, n, component, component_id`` per row of ``docs``; ``percent`` is the least similarity in hundredths."""
    sketches = staged(sketched(docs, k, id_col, text_col))
    rows = staged(sketches.select("doc_id", "th", "n", "fp"))
    first = sketches.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("from"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.first("odd").alias("odd"))
    every = staged(first.select(F.monotonically_increasing_id().alias("node"), "fp", "least", "from.doc_id", "from.th", "n", "bands", "registers", "odd"))
    release(sketches)
    banded = every.select("node", F.explode("bands").alias("key"))
    met = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = staged(banded.join(met, "key"))
    weights = met.groupBy("node").agg(F.sum("c").alias("w"))
    first = met.join(weights, "node").groupBy("key").agg(F.max(F.struct("w", F.col("node").alias("lead"))).alias("x")).select("key", "x.lead")
    pairs = met.join(first, "key").where("node <> lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()
    nodes = staged(met.select("node").distinct().join(every, "node"))  # most meet no other; what follows is about the rest
    sets = staged(full_sets(docs, nodes.select("node", "doc_id", "th", "fp"), k, id_col, text_col))
    tested = staged(likely(pairs, nodes, percent))
    first_links = staged(verified(tested, sets, percent))
    found = components(first_links)
    able = _open(met, found, sets, nodes, percent)
    release(met, found)
    fresh = staged(_against_leads(able, tested, nodes, percent))
    links = staged(first_links.union(verified(fresh, sets, percent)))
    found = components(links)
    rest = _rest(able, found, tested.union(fresh), nodes, percent)
    last_links = staged(links.union(verified(rest, sets, percent)))
    release(sets, tested, fresh, rest, able, first_links, links, found, nodes)
    found = components(last_links)
    release(last_links)
    of_node = every.select("node", "fp", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = staged(of_node.join(least, "component").select("fp", "component", "component_id"))
    release(every, found)
    out = rows.join(of_set, "fp", "left")
    return out.select("doc_id", "th", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _open(met: DataFrame, found: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that hold several components: ``key, node, component, n, s, odd``, where ``s`` of the node's ``n``
    shingles occur in another such node; without nodes whose ``s`` is too small for any link."""
    now = _labelled(met.select("key", "node"), found)
    still = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    now = staged(now.join(still, "key"))
    concerned = now.select("node").distinct()
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, x in zip(batch.column("node").to_pylist(), batch.column("items"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x)], names=["node", "item"])
    each = sets.join(concerned, "node").select("node", "items").mapInArrow(items, "node long, item long")
    alone = each.groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    shared = nodes.select("node", "n").join(concerned, "node").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))
    able = staged(now.join(shared.where(100 * F.col("s") >= percent * F.col("n")), "node").join(nodes.select("node", "odd"), "node"))
    release(now)
    return able


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _possible(percent: int):
    """Whether sizes, shared shingles and parities of members ``x`` and ``y`` allow a link."""
    most, both = F.expr("least(x.s, y.s, x.n, y.n)"), F.expr("x.n + y.n")
    near = (100 + percent) * _apart("x.odd", "y.odd") <= (100 - percent) * both
    return F.expr("x.key = y.key and x.component <> y.component") & (100 * most >= percent * (both - most)) & near


def _against_leads(able: DataFrame, tested: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of the members of each open bucket with its LEADS members that have the fewest shingles of their own,
    which in a family of edited copies are the least edited; without those tested before."""
    order = Window.partitionBy("key").orderBy((F.col("s") / F.col("n")).desc(), F.col("n").desc(), "node")
    leads = able.withColumn("i", F.row_number().over(order)).where(F.col("i") <= LEADS)
    pairs = able.alias("x").join(leads.alias("y"), _possible(percent))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return likely(pairs.join(tested, ["a", "b"], "left_anti"), nodes, percent)


def _rest(able: DataFrame, found: DataFrame, tested: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of open buckets that are still worth a test, as ``a, b``; each only in the first band that it shares."""
    labelled = staged(_labelled(able.drop("component"), found))
    still = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rows = labelled.join(still, "key").join(nodes.select("node", "bands"), "node")
    first = F.get(F.filter("x.bands", lambda b, i: b == F.get("y.bands", i)), F.lit(0)) == F.col("x.key")
    pairs = rows.alias("x").join(rows.alias("y"), _possible(percent) & F.expr("x.node > y.node") & first)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    out = staged(likely(pairs.join(tested, ["a", "b"], "left_anti"), nodes, percent))
    release(labelled)
    return out


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one of least id (then text hash); rows without words all stay."""
    rows = staged(near_duplicates(docs, k, percent, id_col, text_col).where("n > 0").select("component", "doc_id", "th"))
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.count("*").alias("c")).where("c > 1")  # most are alone
    best = best.select("component", F.col("x.doc_id").alias("first_id"), F.col("x.th").alias("first_th"))
    judged = rows.join(best, "component").withColumn("stays", F.expr("doc_id <=> first_id and th = first_th"))
    judged = judged.groupBy("component", "doc_id", "th", "stays").agg(F.count("*").alias("n"))
    touched = staged(judged.where("not stays or n > 1").select("doc_id", "th", "stays"))  # members of groups of several rows
    release(rows)
    whole = docs.select(row_of(docs).alias("kept"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col).rlike(NOT_BLANK), F.lit(False)).alias("worded"))
    worded, alone = whole.where("worded"), whole.where("not worded")
    known = few(touched.select("th"))
    if known is not None:  # only rows of groups need to be dealt; the others pass in one scan
        met = known.withColumnRenamed("th", "of")
        alone = whole.join(met, F.col("worded") & (F.col("th") == F.col("of")), "left_anti")
        worded = worded.join(met, F.col("th") == F.col("of"), "left_semi")
    met = worded.alias("d").join(touched.alias("w"), F.expr("d.th = w.th and d.doc_id <=> w.doc_id"), "left").where("coalesce(stays, true)").select("kept", "d.doc_id", "d.th")
    one = met.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.lit(0)))).where("i = 1")
    return one.select("kept.*").union(alone.select("kept.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
SQL = {
    "op6_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 85 * (a.n + b.n - c)),
l AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
r AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS least FROM r GROUP BY i)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least, w.doc_id)) AS component_id, w.doc_id <= coalesce(least, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.i = w.doc_id""",
}
