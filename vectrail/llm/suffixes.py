"""Removal of repeated byte passages by suffix arrays.

A byte goes where it is covered by a string of LENGTH bytes that also starts in a document of smaller id.

1. Documents are gathered into chunks. In every chunk each string of LENGTH bytes is assigned to one anchor: the
   leftmost least hash of its strings of ANCHOR bytes. Equal strings have equal anchors, so a string whose anchor
   occurs in one document only can't be repeated; each chunk sends its distinct anchors, dealt by hash, and learns which
   of them occur elsewhere.
2. Around those anchors, the strings of one anchor form a snippet. Each chunk sends its distinct snippets with the
   smallest and largest id that hold them, dealt by anchor: the shards. All occurrences of a string are in one shard.
3. A shard sorts all suffixes of its distinct snippets (Larsson-Sadakane refinement: ranks by 8 bytes, then groups that
   are not yet single are refined by the ranks 8, 16 and 18 bytes on, up to LENGTH) and takes common prefixes by Kasai's
   rule, run in parallel lanes. Neighbours with a common prefix of LENGTH are one string, with one smallest id. A shard of
   more than SHARD_BYTES is sorted in several arrays, and their strings are merged by binary search in one another.
4. Chunks get the smallest ids of their strings back, in runs, and cut the bytes.

A string that a third of all documents share is sent once per chunk, and no two documents ever meet. All intermediate
results are written to the shared folder.

Defined results: null text is empty; a row without an id neither loses bytes nor causes a loss; rows of equal id do not
affect each other; texts under LENGTH bytes are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table
from .shingles import BASE, mix

LENGTH = 50
ANCHOR = 16
SPAN = LENGTH - ANCHOR + 1
CHUNK_BYTES = 1 << 20
SEGMENT = 1 << 18
BUCKET_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _DOWN = None


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first and last start, and the anchor's hash. ``ends``: of documents."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(SEGMENT + 2 * LENGTH, BASE), _powers(SEGMENT + 2 * LENGTH, pow(BASE, -1, 1 << 64))
    valid = np.ones(len(data), bool)
    begin = 0
    for end in ends.tolist():
        valid[max(begin, end - LENGTH + 1) : end] = False
        begin = end
    out: list[tuple] = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        starts = np.flatnonzero(valid[at : min(at + SEGMENT, len(data) - LENGTH + 1)])
        if not len(starts):
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], dtype=np.uint64)])
        n = len(part) - ANCHOR + 1
        hashes = mix((sums[ANCHOR:] - sums[:n]) * _DOWN[:n])
        least = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        chosen = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        out.append((starts[fresh] + at, starts[np.append(fresh[1:], len(starts)) - 1] + at, hashes[chosen[fresh]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all positions by their next LENGTH bytes (zeros follow the end), and the 8 bytes from each as a number."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * LENGTH, np.uint8)])
    words = np.zeros(n + LENGTH, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + n + LENGTH]
    order = np.argsort(words[:n])
    rank = np.zeros(n + LENGTH, np.uint64)
    def ranked(index: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give the positions at ``index`` the first index of their group; returns where groups of several are."""
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, len(keys)))
        rank[order[index]] = np.repeat(index[first], sizes).astype(np.uint64) + np.uint64(1)
        return index[np.repeat(sizes > 1, sizes)]
    unsorted = ranked(np.arange(n), words[order]) if n else np.zeros(0, np.int64)
    for step in (8, 16, LENGTH - 32):
        if not len(unsorted):
            break
        at = order[unsorted]
        keys = (rank[at] << np.uint64(32)) | rank[at + step]
        by = np.argsort(keys)
        order[unsorted] = at[by]
        unsorted = ranked(unsorted, keys[by])
    return order, words


def common_prefixes(text: np.ndarray, order: np.ndarray, words: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes (LENGTH at most) that each start in the order shares with the one before it, by Kasai's rule: from one start
    to the next the common prefix falls by one at most. The starts of each snippet (``counts`` from ``begin`` on) are a
    lane, and all lanes take a step at a time. The rule says nothing after a full match, as starts that agree in LENGTH
    bytes stand in any order, nor where the other snippet ends; then the comparison starts anew."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    inside = np.zeros(n + 1, bool)
    inside[order] = True
    found = np.zeros(n, np.int8)
    padded = np.concatenate([text, np.zeros(2 * LENGTH, np.uint8)])
    lanes, carried = np.argsort(-counts, kind="stable"), np.zeros(len(counts), np.int64)
    for t in range(int(counts.max(initial=0))):
        lanes = lanes[: int(np.searchsorted(-counts[lanes], -t))]
        i = begin[lanes] + t
        j = before[i]
        g = carried[: len(lanes)]
        if t:
            last = before[i - 1]
            g = np.where((last >= 0) & inside[last + 1] & (g < LENGTH), np.maximum(g - 1, 0), 0)
        g = np.where(j < 0, 0, g)
        todo = np.flatnonzero((j >= 0) & (g <= LENGTH - 8))
        while len(todo):
            todo = todo[words[i[todo] + g[todo]] == words[j[todo] + g[todo]]]
            g[todo] += 8
            todo = todo[g[todo] <= LENGTH - 8]
        todo = np.flatnonzero((j >= 0) & (g < LENGTH))
        while len(todo):
            todo = todo[padded[i[todo] + g[todo]] == padded[j[todo] + g[todo]]]
            g[todo] += 1
            todo = todo[g[todo] < LENGTH]
        found[i] = g
        carried = g
    return found[order]


class Shard:
    """Distinct snippets with the smallest id of each, their suffix array, and the smallest id per string."""

    def __init__(self, snippets: list[bytes], least: np.ndarray) -> None:
        self.text = np.frombuffer(b"".join(snippets), np.uint8)
        sizes = np.array([len(s) for s in snippets], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.counts = sizes - LENGTH + 1
        valid = np.zeros(len(self.text), bool)
        owner = np.repeat(np.arange(len(sizes)), self.counts)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts) + self.begin[owner]
        valid[starts] = True
        order, self.words = suffix_array(self.text)
        self.order = order[valid[order]]
        group = np.cumsum(common_prefixes(self.text, self.order, self.words, self.begin, self.counts) < LENGTH)
        at = np.zeros(len(self.text), np.int64)
        at[starts] = owner
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.least = np.minimum.reduceat(least[at[self.order]], self.first) if len(group) else np.zeros(0, np.int64)
        self.starts = starts
        self.owner = owner

    def key(self, at: np.ndarray) -> list[np.ndarray]:
        """The strings that start there without their first 8 bytes, as numbers that compare alike."""
        return [self.words[at + i] for i in (8, 16, 24, 32, 40, LENGTH - 8)]

    def merge(self, other: Shard) -> None:
        """Binary search for each own string among the other's; both take the smaller id. The first 8 bytes are searched
        for in order, so the other's array is passed over once; the rest only in the stretch that they leave."""
        mine, theirs = self.order[self.first], other.order[other.first]
        front = other.words[theirs]
        low, high = (np.searchsorted(front, self.words[mine], side) for side in ("left", "right"))
        asked = np.flatnonzero(low < high)
        low, high = low[asked], high[asked]
        last = high - 1
        own = self.key(mine[asked])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less = np.zeros(len(open_), bool)
            same = np.ones(len(open_), bool)
            for a, b in zip(other.key(theirs[middle]), own, strict=True):
                less |= same & (a < b[open_])
                same &= a == b[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        at = np.flatnonzero(low <= last)
        same = np.ones(len(at), bool)
        for a, b in zip(other.key(theirs[low[at]]), own, strict=True):
            same &= a == b[at]
        at, there = asked[at[same]], low[at[same]]
        least = np.minimum(self.least[at], other.least[there])
        self.least[at] = least
        other.least[there] = least

    def per_start(self) -> np.ndarray:
        """The smallest id of the string at each start, in the order of the snippets."""
        out = np.zeros(len(self.text), np.int64)
        out[self.order] = np.repeat(self.least, np.diff(np.append(self.first, len(self.order))))
        return out[self.starts]


def smallest_ids(snippets: list[bytes], least: np.ndarray, shard_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For distinct snippets: number of starts, and the smallest id at every start, one after another."""
    shards, a, size = [], 0, 0
    for b, s in enumerate(snippets):
        size += len(s)
        if size >= (shard_bytes or SHARD_BYTES) or b == len(snippets) - 1:
            shards.append(Shard(snippets[a : b + 1], least[a : b + 1]))
            a, size = b + 1, 0
    for _ in range(2 if len(shards) > 2 else 1):  # the second round spreads what later pairs have found
        for i, x in enumerate(shards):
            for y in shards[:i]:
                x.merge(y)
    return np.concatenate([s.counts for s in shards]), np.concatenate([s.per_start() for s in shards])


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of many documents: ``ids, known, ends`` (arrays as bytes) and ``data``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0
        def row() -> pa.RecordBatch:
            known = np.array([i is not None for i in ids])
            numbers = np.array([i or 0 for i in ids], np.int64)
            columns = [pa.array([x], pa.binary()) for x in (numbers.tobytes(), known.tobytes(), np.cumsum([len(t) for t in texts]).astype(np.int64).tobytes(), _packed(b"".join(texts)))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([size], pa.int64())], names=["ids", "known", "ends", "data", "size"])
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = (t or "").encode()
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "ids binary, known binary, ends binary, data binary, size long").withColumn("chunk", F.monotonically_increasing_id()))


def _packed(data: bytes) -> bytes:
    """Compressed, as texts are moved several times."""
    return _codec()[0].compress(data)


def _whole(data: bytes) -> bytes:
    return _codec()[1].decompress(data)


@functools.cache
def _codec() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["ends"], np.int64), np.frombuffer(_whole(row["data"]), np.uint8)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _record(schema: str, values: list[list]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, types[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def repeated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``spans`` (starts and ends of removed bytes) per row."""
    chunks = _chunked(docs, id_col, text_col)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, ends, data = _unpack(row)
            starts, _, hashes = anchors(data, ends)
            doc = np.searchsorted(ends, starts, "right")
            by = np.argsort(hashes, kind="stable")
            hashes, doc = hashes[by], doc[by]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            many = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
            found = (hashes[first] & ~np.uint64(1)) | many  # the last bit: in several documents of this chunk
            to = (found >> np.uint64(1)) % np.uint64(buckets)
            by = np.argsort(to, kind="stable")
            parts = np.split(found[by], np.searchsorted(to[by], np.arange(1, buckets, dtype=np.uint64)))
            kept = [(b, p) for b, p in enumerate(parts) if len(p)]
            yield _record("bucket long, chunk long, anchors binary", [[b for b, _ in kept], [row["chunk"]] * len(kept), [p.tobytes() for _, p in kept]])

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in rows["anchors"]]
        plain = [p & ~np.uint64(1) for p in parts]
        names, counts = np.unique(np.concatenate(plain), return_counts=True)
        names = np.union1d(names[counts > 1], np.concatenate([q[(p & np.uint64(1)) > 0] for p, q in zip(parts, plain, strict=True)]))
        names = np.append(names, ~np.uint64(0))  # found by no anchor, as those are even
        back = [q[names[np.searchsorted(names[:-1], q)] == q] for q in plain]
        return pd.DataFrame({"chunk": rows["chunk"], "shared": [x.tobytes() for x in back]})

    sent = chunks.select("chunk", "ids", "known", "ends", "data").mapInArrow(send, "bucket long, chunk long, anchors binary")
    known = staged(sent.groupBy("bucket").applyInPandas(shared, "chunk long, shared binary").where(F.length("shared") > 0))  # a chunk's own anchors at most

    cut_schema = "bucket long, chunk long, numbers binary, sizes binary, least binary, most binary, texts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, known_ids, ends, data = _unpack(row)
            names = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in row["shared"]]))
            first, last, hashes = anchors(data, ends)
            hashes = hashes & ~np.uint64(1)
            at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
            hit = np.flatnonzero(names[at] == hashes)
            first, last, hashes = first[hit], last[hit], hashes[hit]
            doc = np.searchsorted(ends, first, "right")
            raw, seen, number, where = data.tobytes(), {}, np.empty(len(first), np.int64), []
            for i, (a, b) in enumerate(zip(first.tolist(), (last + LENGTH).tolist(), strict=True)):
                n = number[i] = seen.setdefault(raw[a:b], len(seen))
                if n == len(where):
                    where.append(i)
            least, most = np.full(len(seen), NEVER), np.full(len(seen), ALWAYS)
            np.minimum.at(least, number, np.where(known_ids, ids, NEVER)[doc])
            np.maximum.at(most, number, np.where(known_ids, ids, ALWAYS)[doc])
            texts = list(seen)
            to = ((hashes[where] >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            out = [[-1], [row["chunk"]], [_packed(number.astype(np.int32).tobytes())], [_packed(first.tobytes())], [_packed(doc.astype(np.int32).tobytes())], [b""], [b""]]
            for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
                own = [texts[i] for i in part]
                for column, value in zip(out, (int(to[part[0]]), row["chunk"], *map(_packed, (part.astype(np.int32).tobytes(), np.array([len(x) for x in own], np.int64).tobytes(), least[part].tobytes(), most[part].tobytes(), b"".join(own)))), strict=True):
                    column.append(value)
            yield _record(cut_schema, out)

    pieces = staged(chunks.join(known.groupBy("chunk").agg(F.collect_list("shared").alias("shared")), "chunk").select("chunk", "ids", "known", "ends", "data", "shared").mapInArrow(cut, cut_schema))

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        uses = []
        for sizes, least, texts in zip(rows["sizes"], rows["least"], rows["texts"], strict=True):
            at, use, texts = 0, [], _whole(texts)
            for n, i in zip(np.frombuffer(_whole(sizes), np.int64).tolist(), np.frombuffer(_whole(least), np.int64).tolist(), strict=True):
                k = seen.setdefault(texts[at : at + n], len(ids))
                if k == len(ids):
                    ids.append(i)
                elif i < ids[k]:
                    ids[k] = i
                use.append(k)
                at += n
            uses.append(np.array(use))
        counts, smallest = smallest_ids(list(seen), np.array(ids, np.int64))
        starts = np.cumsum(counts) - counts
        fresh = np.ones(len(smallest), bool)
        fresh[1:] = smallest[1:] != smallest[:-1]
        fresh[starts] = True
        run = np.flatnonzero(fresh)
        run_end = np.append(run[1:], len(smallest))
        of = np.searchsorted(starts, run, "right") - 1
        first_run = np.searchsorted(run, starts)
        runs = np.diff(np.append(first_run, len(run)))
        out: dict[str, list] = {"chunk": [], "number": [], "begin": [], "end": [], "id": []}
        for chunk, numbers, most, use in zip(rows["chunk"], rows["numbers"], rows["most"], uses, strict=True):
            times = runs[use]
            pick = np.repeat(first_run[use] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            number = np.repeat(np.frombuffer(_whole(numbers), np.int32), times)
            useful = smallest[run[pick]] < np.repeat(np.frombuffer(_whole(most), np.int64), times)
            pick, number = pick[useful], number[useful]
            if len(pick):
                base = starts[of[pick]]
                for name, value in (("number", number), ("begin", (run[pick] - base).astype(np.int32)), ("end", (run_end[pick] - base).astype(np.int32)), ("id", smallest[run[pick]])):
                    out[name].append(_packed(value.tobytes()))
                out["chunk"].append(chunk)
        return pd.DataFrame(out)

    schema = "chunk long, number binary, begin binary, end binary, id binary"
    release(known)
    answers = staged(pieces.where("bucket >= 0").groupBy("bucket").applyInPandas(judge, schema))
    # only where strings of a chunk lie is still needed; at most one row per bucket for each chunk
    uses = staged(pieces.where("bucket = -1").select("chunk", F.col("numbers").alias("u_number"), F.col("sizes").alias("u_first"), F.col("least").alias("u_doc")))
    release(pieces)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("number", "begin", "end", "id")).alias("answers"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, known_ids, ends, data = _unpack(row)
            marks = np.zeros(len(data) + 1, np.int32)
            if row["answers"]:
                read = lambda name, kind: np.concatenate([np.frombuffer(_whole(x[name]), kind) for x in row["answers"]])
                number, begin, end, smallest = read("number", np.int32), read("begin", np.int32), read("end", np.int32), read("id", np.int64)
                by = np.argsort(number, kind="stable")
                number, begin, end, smallest = number[by], begin[by], end[by], smallest[by]
                used, first, doc = np.frombuffer(_whole(row["u_number"]), np.int32), np.frombuffer(_whole(row["u_first"]), np.int64), np.frombuffer(_whole(row["u_doc"]), np.int32)
                low = np.searchsorted(number, used)
                times = np.searchsorted(number, used, "right") - low
                pick = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                owner = np.where(known_ids, ids, ALWAYS)[np.repeat(doc, times)]
                start = np.repeat(first, times)
                good = smallest[pick] < owner
                np.add.at(marks, (start + begin[pick])[good], 1)
                np.add.at(marks, (start + end[pick] + LENGTH - 1)[good], -1)
            gone = np.cumsum(marks[:-1]) > 0
            out: list[list] = [[] for _ in range(6)]
            a = 0
            for i, known_id, b in zip(ids.tolist(), known_ids.tolist(), ends.tolist(), strict=True):
                mask = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                kept = data[a:b] if not len(edges) else data[a:b][~mask]
                for column, value in zip(out, (i if known_id else None, b - a, int(mask.sum()), len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edges.astype(np.int64).tobytes()), strict=True):
                    column.append(value)
                a = b
            yield _record(result, out)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"
    return chunks.join(uses, "chunk", "left").join(answers, "chunk", "left").select("ids", "known", "ends", "data", "u_number", "u_first", "u_doc", "answers").mapInArrow(remove, result)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_suffixes": op5_suffixes}
SQL = {
    "op5_suffixes": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, o, substr(h, (2 * o + 1)::BIGINT, {2 * (512 + LENGTH - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 512)) AS o FROM d)),
w AS (SELECT doc_id, o + p AS p, substr(h, (2 * p + 1)::BIGINT, {2 * LENGTH}) AS s FROM (SELECT doc_id, o, h, unnest(range(0, least(512, len(h) // 2 - {LENGTH - 1}))) AS p FROM b)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r)),
i AS (SELECT doc_id, span, min(p) AS a, max(p) + {LENGTH} AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM i),
t AS (SELECT d.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
}
