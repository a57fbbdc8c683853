"""Fuzzy line deduplication.

A line is its sequence of words, A-Z lower-cased; lines without a word are left alone. Equal lines are counted by a
128-bit hash; those of fewer than four words are linked only if equal, which is what the similarity below comes to. Two lines are linked if their edit similarity over words (1 - distance / longer length) is
0.8 or more. Of each connected group the first occurrence stays, by id and line number, and all others are removed from
their texts.

Candidates only propose links and miss none. A line of n words shows its rarest pairs of neighbouring words, some
0.4 n + 2 of them, in one order for all lines (by the commonness of the words in all documents, then by hash). An edit
destroys two pairs at most, so lines that are similar have two of the shown ones in common, at places that differ by no
more than the edits. Lines that share one key of many lines, or two others, are candidates. Each line also has a 64-bit
SimHash of its words, and two of the lines that agree in one of BLOCKS blocks of it are proposed too, which joins
many copies early. SimHash alone can't propose all: at a similarity of 0.8 it differs in 13 of 64 bits on average, more than
blocks that tell lines apart allow.

Only groups are wanted, so of the lines of a key of many lines each meets a few others that the bounds below allow to be
similar; where there are more, those that are then still in different groups meet all, and leave one link for each two
groups that they join: pairs never leave the task that verifies them. Only
pairs are verified that exact bounds allow to be similar: the lengths, and the cells of a fixed number that hold an odd
number of words of just one line. A replaced word changes two of them at most, an added or a dropped one a single cell, so
these cells and the difference of the lengths come to no more than twice the edits. No bucket is capped.

Defined results: null text has no lines and stays null; lines are parted by a line feed, and a text keeps the order and
the form of the lines that stay; a null id sorts first; of rows with equal id and text one has its lines and the others
lose all that could be removed; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, WORD, few, let, quoted, release, row_of, staged, table
from .components import components
from .shingles import BASE, chunks, mix, words_of

MIN_WORDS = 1
PERCENT = 80
CELLS = 256
WORD_CELLS = 1 << 16
#: Lines of fewer words are similar only if equal: a line of four and one of five words may differ by the fifth.
LEAST_FUZZY = PERCENT // (100 - PERCENT)
ODD = [f"odd{i}" for i in range(CELLS // 64)]
#: Blocks of the SimHash.
BLOCKS = 2
#: Entries of a bucket, entries that a task holds before it sends them, lines of a key that meet each other there and then.
BUCKET_ENTRIES, MOST_HELD, FEW = 1 << 18, 1 << 18, 64
#: Bits of the codes of a length and of a position in a key; codes of a position that says nothing and of a key that is sent
#: in part; steps of the length's scale.
CODE_BITS, ANYWHERE, FREQUENT, SCALE = 8, 255, 255, 24
#: Words that a count of one byte holds; words of the lines whose edits are counted by arrays, pairs at once, and cells for
#: the words that two of them share.
MOST_COUNTED, MOST_WORDS, AT_ONCE, COMMON_CELLS = 255, 512, 1 << 12, 1 << 8
#: Of longer lines, pairs at once and cells for the words that two of them share.
LONG_AT_ONCE, LONG_CELLS = 1 << 8, 1 << 12
#: Bytes of texts whose words are held at once.
MOST_BYTES = 1 << 23
#: Line hashes that a task remembers, so that copies aren't sent again.
MOST_MET = 1 << 20
#: Entries of frequent keys that a task compares at least; lines of a key that are compared in one piece; lines that meet all
#: others of a key at once; others of a key that a line meets before groups are known.
MOST_DEALT, MOST_CELL, AT_LENGTH, MOST_FIRST = 1 << 17, 1 << 13, 64, 16
#: Words of the lines of a room, lines of its cells, and pairs without a link that it remembers, so that other cells don't
#: verify them again.
ROOM_WORDS, ROOM_LINES, MOST_TESTED = 1 << 20, 1 << 18, 1 << 20


def simhash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the words from ``first`` to ``last`` (exclusive) of each line: the majority of every bit, ties 0.

    Eight bits, one of each byte, are counted at once; lines are cut into pieces short enough for counts of a byte.
    """
    size = last - first
    pieces = -(-size // MOST_COUNTED)
    line = np.repeat(np.arange(len(first)), pieces)
    piece = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[line] + piece * MOST_COUNTED
    end = np.minimum(begin + MOST_COUNTED, last[line])
    ends = np.cumsum(pieces)
    out = np.zeros(len(first), np.uint64)
    sums, upto = np.zeros(len(hashes) + 1, np.uint64), np.zeros((len(line) + 1, 8), np.int32)
    for bit in range(8):
        np.cumsum((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), out=sums[1:])
        counts = (sums[end] - sums[begin]).view(np.uint8).reshape(-1, 8)
        if (pieces != 1).any():
            np.cumsum(counts, axis=0, out=upto[1:])
            counts = upto[ends] - upto[ends - pieces]
        more = 2 * counts.astype(np.int32) > size[:, None]
        out |= more.view("<u8").ravel() << np.uint64(bit)
    return out


def parities(hashes: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """Per line, which of CELLS cells hold an odd number of its words, as longs of 64 bits."""
    odd = np.bincount(line * CELLS + (hashes >> np.uint64(20)).astype(np.int64) % CELLS, minlength=lines * CELLS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(lines, CELLS), axis=1).view("<i8")


_BASES = (BASE, 0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the zeroth to the n-th at least; those of usual buffers are kept."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) <= n:
        known = []
        for x in (base, pow(base, -1, 1 << 64)):
            power = np.full(max(n + 1, 1 << 18), x, np.uint64)
            power[0] = 1
            known.append(np.multiply.accumulate(power))
        known = known[0], known[1]
        if n < 1 << 20:
            _POWERS[base] = known
    return known


def line_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, of: int = 2) -> list[np.ndarray]:
    """``of`` 64-bit hashes of each line's sequence of words, two at most."""
    found = []
    for base in _BASES[:of]:
        up, down = _powers(base, len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(base)) * up[: len(hashes)], dtype=np.uint64)])
        found.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
    return found


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``doc_id, th, text``: the id, a hash of the text, and the text; ``k, none``: the id without null, and whether it is."""
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(i.alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"), F.coalesce(i, F.lit(0)).alias("k"), i.isNull().alias("none"), *more)


def occurrences(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, th, line, at, bytes, lead, h1, h2, sim, n`` and ODD for every line of MIN_WORDS words or more; lines count from 0,
    ``at`` and ``bytes`` are the line's first byte in the text and its size, and
    ``lead`` marks the first such line of each row. Each task adds one row that has only ``words``: how many words fall in each of WORD_CELLS cells, as bytes."""
    rows = _keyed(docs, id_col, text_col).select("doc_id", "th", "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_CELLS, np.int64)
        for batch in batches:
            for a, b, data, begin in chunks(batch.column("text"), 1 << 17):
                starts, hashes = words_of(data)
                total += np.bincount((hashes & np.uint64(WORD_CELLS - 1)).astype(np.int64), minlength=WORD_CELLS)
                ends = np.flatnonzero(data == 10)
                first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
                last = np.searchsorted(starts, ends)
                opening = np.concatenate([[0], ends[:-1] + 1])
                doc = every = np.searchsorted(begin, opening, "right") - 1
                number = np.arange(len(ends)) - np.searchsorted(opening, begin)[doc]
                long = np.flatnonzero(last - first >= MIN_WORDS)
                first, last, doc, number = first[long], last[long], doc[long], number[long]
                if not len(long):
                    continue
                h1, h2 = line_hashes(hashes, first, last)
                size = last - first
                line = np.repeat(np.arange(len(long)), size)
                own = hashes[np.arange(len(line)) + np.repeat(first - (np.cumsum(size) - size), size)]
                odd = parities(own, line, len(long))
                sim = simhash(hashes, first, last)
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(number, pa.int64()), *(pa.array(x[long], pa.int32()) for x in (opening - begin[every], ends - opening)), pa.array(np.diff(doc, prepend=-1) != 0), *(pa.array(x.view(np.int64)) for x in (h1, h2, sim)), pa.array(size, pa.int32()), *(pa.array(x) for x in np.ascontiguousarray(odd.T)), pa.nulls(len(size), pa.binary())],
                    names=schema.names,
                )
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in schema.types[:-1]), pa.array([total.tobytes()], pa.binary())], names=schema.names)
    schema = pa.schema([*((x, pa.int64()) for x in ("doc_id", "th", "line")), *((x, pa.int32()) for x in ("at", "bytes")), ("lead", pa.bool_()), *((x, pa.int64()) for x in ("h1", "h2", "sim")), ("n", pa.int32()), *((x, pa.int64()) for x in ODD), ("words", pa.binary())])
    return rows.mapInArrow(run, f"doc_id long, th long, line long, at int, bytes int, lead boolean, h1 long, h2 long, sim long, n int, {' long, '.join(ODD)} long, words binary")


def commonness(every: DataFrame) -> np.ndarray:
    """How often words fall in each of WORD_CELLS cells, summed over the counts that ``occurrences`` left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_CELLS, np.int64)
        for batch in batches:
            for x in batch.column("words").to_pylist():
                total += np.frombuffer(x, np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])
    out = np.ones(WORD_CELLS)
    rows = every.where(F.col("words").isNotNull()).select("words")
    cells = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # WORD_CELLS rows at most
    out[cells["cell"].to_numpy(np.int64)] += cells["n"].to_numpy(np.float64)
    return out


def needed(n: np.ndarray) -> np.ndarray:
    """How many of its rarest word pairs a line of ``n`` words must show to meet every similar line.

    Lines of n and m >= n words with d = m * (100 - PERCENT) // 100 edits share m - 1 - 2 d of their word pairs at least,
    so n - 1 - (m - 1 - 2 d) + 1 of the shorter one's suffice, and as many of the longer one's for m = n.
    """
    step = 100 // (100 - PERCENT)
    up = -(-n // step) * step  # of the longer lines, the least for which d grows
    return np.maximum(2 * (n // step) + 1, np.where(PERCENT * up <= 100 * n, n - up + 2 * (up // step) + 1, 0))


def length_code(n: np.ndarray) -> np.ndarray:
    """The length on a scale of SCALE steps for each doubling, under FREQUENT."""
    return np.minimum(np.log2(n) * SCALE, FREQUENT - 1).astype(np.uint64)


#: The least and the greatest length of each code.
SHORTEST = np.floor(np.exp2(np.arange(FREQUENT + 1) / SCALE)).astype(np.int64)
LONGEST = np.append(np.ceil(np.exp2(np.arange(1, FREQUENT) / SCALE)).astype(np.int64), [1 << 40, 1 << 40])


def _rarest(data: np.ndarray, weight: np.ndarray, met: set) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word pairs that the lines of a buffer show, and the hash of the line of each; lines in ``met`` are left
    out, and new ones are added to it. ``weight``: the logarithm of the commonness of the words of each cell. A pair that a line repeats has a key each time. A key is 48 bits of hash, 8 of the
    line's length and 8 of the pair's position."""
    starts, hashes = words_of(data)
    ends = np.flatnonzero(data == 10)
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
    last = np.searchsorted(starts, ends)
    long = np.flatnonzero(last - first >= LEAST_FUZZY)
    (h1,) = line_hashes(hashes, first[long], last[long], 1)
    if len(met) > MOST_MET:
        met.clear()
    fresh = np.array([not (h in met or met.add(h)) for h in h1.tolist()], bool)
    first, last, h1 = first[long][fresh], last[long][fresh], h1[fresh]
    count = last - first - 1
    line = np.repeat(np.arange(len(h1)), count)
    begin = np.cumsum(count) - count
    at = np.arange(len(line)) + np.repeat(first - begin, count)
    pair = mix(hashes[at] * np.uint64(BASE) + hashes[at + 1])
    own = weight[(hashes & np.uint64(WORD_CELLS - 1)).astype(np.int64)]
    rank = np.minimum(own[at] + own[at + 1], 63).astype(np.uint64)
    if len(h1) < 1 << 20:
        by = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(38)) | (pair >> np.uint64(26)))
    else:
        by = np.lexsort((pair >> np.uint64(26), rank, line))
    pair, spot = pair[by], np.minimum((at - first[line])[by], ANYWHERE)
    place = np.arange(len(pair))
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (line[1:] != line[:-1])
    same = place - np.maximum.accumulate(np.where(new, place, 0))
    again = same > 0
    again[:-1] |= again[1:]
    spot[again] = ANYWHERE
    take = place - begin[line] < needed(count + 1)[line] + 1
    key, line, spot = pair[take] + same[take].astype(np.uint64) * np.uint64(BASE), line[take], spot[take]
    return mix(key) & ~np.uint64((1 << 2 * CODE_BITS) - 1) | length_code(count + 1)[line] << np.uint64(CODE_BITS) | spot.astype(np.uint64), h1[line]


def _bundled(keys: np.ndarray, lines: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries by bucket, packed. A key of more than FEW lines sends two of them, marked as frequent; all of its entries go
    apart, with the two as ``lo`` and ``hi``, so that no bucket gathers a frequent key."""
    by = np.argsort(keys)
    keys, lines = keys[by], lines[by]
    plain = keys >> np.uint64(2 * CODE_BITS)
    first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    often = np.repeat(size > FEW, size)
    end = np.zeros(len(keys), bool)
    end[first] = end[first + size - 1] = True
    sent_keys, sent_lines = np.where(often, keys | np.uint64(FREQUENT << CODE_BITS), keys)[~often | end], lines[~often | end]
    to = ((sent_keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # grows with the key
    begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    rows = [(int(to[a]), sent_keys[a:b].tobytes(), sent_lines[a:b].tobytes(), None, None) for a, b in zip(begin, [*begin[1:], len(to)], strict=True)]
    if often.any():
        lo, hi = (np.repeat(lines[x], size)[often].tobytes() for x in (first, first + size - 1))
        rows.append((-1 - int(keys[0] >> np.uint64(34)), keys[often].tobytes(), lines[often].tobytes(), lo, hi))
    types = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "keys", "lines", "lo", "hi"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines with the keys ``x`` and ``y`` can be similar: what stands before the pair of words and what stands
    behind it must differ in length by as much as the edits, together, at most."""
    part = lambda k: (k & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
    n, m, i, j = part(x >> np.uint64(CODE_BITS)), part(y >> np.uint64(CODE_BITS)), part(x), part(y)
    least, most = SHORTEST[n] - LONGEST[m], LONGEST[n] - SHORTEST[m]  # of the difference of the lengths
    shift = np.where((i == ANYWHERE) | (j == ANYWHERE), np.clip(0, least, most), i - j)
    edits = np.abs(shift) + np.maximum(0, np.maximum(least - shift, shift - most))
    return 100 * edits <= (100 - PERCENT) * LONGEST[np.maximum(n, m)]


def _met(rows: pa.Table) -> pa.Table:
    """Of a bucket's entries: pairs of lines ``lo, hi`` that a key of at most FEW lines brings together and that length and
    position allow to be similar; and ``key, h1, lo, hi`` of other keys, along whose ``lo`` and ``hi`` their lines connect."""
    read = lambda name: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint64)
    def frequent_rows(*columns: np.ndarray) -> pa.Table:
        return pa.table([pa.array(x.view(np.int64)) for x in columns], names=["key", "h1", "lo", "hi"])
    keys, lines = read("keys"), read("lines")
    low = np.uint64(2 * CODE_BITS)
    if rows.column("bucket")[0].as_py() < 0:
        return frequent_rows(keys >> low, lines, read("lo"), read("hi"))
    by = np.argsort(keys >> low << low | lines >> np.uint64(64 - 2 * CODE_BITS))
    keys, lines = keys[by], lines[by]
    plain = keys >> low
    once = np.ones(len(keys), bool)
    once[1:] = (plain[1:] != plain[:-1]) | (lines[1:] != lines[:-1])
    marked = (keys >> np.uint64(CODE_BITS)) & np.uint64(FREQUENT) == np.uint64(FREQUENT)
    frequent = np.unique(plain[marked])
    keys, lines, plain = keys[once], lines[once], plain[once]
    first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    large = (size > FEW) | np.isin(plain[first], frequent)
    some = np.repeat(large, size)
    out = [frequent_rows(plain[some], lines[some], np.repeat(lines[first], size)[some], np.repeat(lines[first + size - 1], size)[some])]
    left = np.repeat(np.where(large, 0, first + size), size)  # end of the entry's group
    at = np.arange(len(keys))
    for step in range(1, FEW):
        at = at[at + step < left[at]]
        if not len(at):
            break
        near = at[_near(keys[at], keys[at + step])]
        x, y = lines[near], lines[near + step]
        x, y = x[x != y], y[x != y]
        none = pa.nulls(len(x), pa.int64())
        out.append(pa.table([none, none, *(pa.array(z.view(np.int64)) for z in (np.minimum(x, y), np.maximum(x, y)))], names=["key", "h1", "lo", "hi"]))
    return pa.concat_tables(out)


def _packed(met: pa.Table, buckets: int) -> pa.Table:
    """The rows of ``_met`` with a key, and its pairs packed by the bucket ``at`` in which equal ones meet."""
    plain = pc.is_null(met.column("key"))
    out = met.filter(pc.invert(plain))
    pairs = met.filter(plain)
    out = [out.append_column("at", pa.nulls(len(out), pa.int64())).append_column("pairs", pa.nulls(len(out), pa.binary()))]
    if len(pairs):
        pairs = np.stack([pairs.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")], axis=1)
        to = _pair_hashes(pairs) % np.uint64(buckets)
        by = np.argsort(to)
        pairs, to = pairs[by], to[by].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        packed = pa.array([pairs[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(to)], strict=True)], pa.binary())
        out.append(pa.table([*[pa.nulls(len(begin), pa.int64())] * 4, pa.array(to[begin]), packed], names=out[0].column_names))
    return pa.concat_tables(out)


def _pair_hashes(pairs: np.ndarray) -> np.ndarray:
    return mix(pairs[:, 0] ^ mix(pairs[:, 1]))


def _twice(rows: pa.Table) -> pa.Table:
    """The pairs ``a, b`` that come up more than once in a bucket."""
    pairs = np.frombuffer(b"".join(rows.column("pairs").to_pylist()), np.uint64).reshape(-1, 2)
    hashes = _pair_hashes(pairs)
    by = np.argsort(hashes)
    hashes = hashes[by]
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    run = same.copy()
    run[:-1] |= same[1:]
    pairs, same = pairs[by[run]], same[run]
    new = ~same
    new[1:] |= (pairs[1:] != pairs[:-1]).any(axis=1)  # other pairs of the same hash
    return pa.table({c: pa.array(np.ascontiguousarray(pairs[new, i]).view(np.int64)) for i, c in enumerate("ab")})


def rare_pairs(docs: DataFrame, often: np.ndarray, entries: int, text_col="text") -> DataFrame:
    """What ``_packed`` leaves of what ``_met`` finds for the rarest pairs of neighbouring words of each line. ``entries``: how many there are."""
    buckets = max(8, -(-entries // BUCKET_ENTRIES))
    meet = max(8, buckets // 2)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        weight = np.log2(often)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, data, _ in chunks(batch.column("text"), 1 << 17):
                held.append(_rarest(data, weight, met))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    yield _bundled(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size = [], 0
        if size:
            yield _bundled(*map(np.concatenate, zip(*held, strict=True)), buckets)
    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, keys binary, lines binary, lo binary, hi binary")
    return sent.groupBy("bucket").applyInArrow(lambda rows: _packed(_met(rows), meet), "key long, h1 long, lo long, hi long, at long, pairs binary")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit vectors."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    top, plus, minus, distance = 1 << (len(a) - 1), full, 0, len(a)
    for x in b:
        equal = where.get(x, 0)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        right = minus | (full & ~(zero | plus))
        left = plus & zero
        distance += bool(right & top) - bool(left & top)
        right = (right << 1 | 1) & full
        left = (left << 1) & full
        plus = left | (full & ~(zero | right))
        minus = right & zero
    return distance


def similar(a: list, b: list, percent: int = PERCENT) -> bool:
    most = max(len(a), len(b))
    if 100 * min(len(a), len(b)) < percent * most:
        return False
    return 100 * (most - edit_distance(a, b)) >= percent * most


def distances(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """``edit_distance`` of the first ``na`` codes of each row of ``a`` and ``nb`` of ``b``, one or more each, by bit
    vectors of all rows at once, in blocks of 64. Codes behind a row's own must differ between ``a`` and ``b``."""
    by = np.argsort(-nb, kind="stable")
    a, b, na, nb = a[by], b[by], na[by], nb[by]
    one, blocks = np.uint64(1), -(-a.shape[1] // 64)
    last, top = (na - 1) // 64, ((na - 1) % 64).astype(np.uint64)
    plus, minus, distance = np.full((blocks, len(a)), ~np.uint64(0)), np.zeros((blocks, len(a)), np.uint64), na.astype(np.int64)
    bits = np.zeros((len(a), blocks * 8), np.uint8)
    for j in range(int(nb[0])):
        now = int(np.searchsorted(-nb, -j))  # rows that have a word there
        found = np.packbits(a[:now] == b[:now, j : j + 1], axis=1, bitorder="little")
        bits[:now, : found.shape[1]] = found
        equals = bits[:now].view("<u8")
        up, down = np.ones(now, np.uint64), np.zeros(now, np.uint64)  # what the block above passes on
        for k in range(blocks):
            equal, p, m = equals[:, k], plus[k, :now], minus[k, :now]
            cover = equal | m
            equal = equal | down
            zero = (((equal & p) + p) ^ p) | equal
            right, left = m | ~(zero | p), p & zero
            own = last[:now] == k
            distance[:now] += np.where(own, ((right >> top[:now]) & one).astype(np.int64) - ((left >> top[:now]) & one).astype(np.int64), 0)
            over, under = right >> np.uint64(63), left >> np.uint64(63)
            right, left = right << one | up, left << one | down
            plus[k, :now], minus[k, :now] = left | ~(cover | right), right & cover
            up, down = over, under
    out = np.empty(len(a), np.int64)
    out[by] = distance
    return out


def in_common(words: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray, cells: int | None = None) -> np.ndarray:
    """At most how many words the texts ``x`` and ``y`` (numbers, pair by pair) share: the sum of the smaller counts in
    each of ``cells`` cells (COMMON_CELLS). ``words`` holds the texts' codes one after the other from ``begin``."""
    cells = cells or COMMON_CELLS
    some, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    size = np.diff(begin)[some]
    at = np.arange(size.sum()) + np.repeat(begin[some] - (np.cumsum(size) - size), size)
    cell = np.repeat(np.arange(len(some)), size) * cells + words[at] % cells
    counts = np.bincount(cell, minlength=len(some) * cells).astype(np.uint16 if cells == COMMON_CELLS else np.int32).reshape(-1, cells)
    return np.minimum(counts[where[: len(x)]], counts[where[len(x) :]]).sum(axis=1, dtype=np.int64)


def _ends(words: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts ``x`` and ``y`` (as in ``in_common``): how many words begin both, how many others end both, and the edits of ``at_most``."""
    n, m = (np.diff(begin)[i] for i in (x, y))
    least = np.minimum(n, m)
    width = max(int(least.max(initial=0)), 1)
    blank = np.zeros(width, words.dtype)
    run = np.lib.stride_tricks.sliding_window_view(np.concatenate([blank, words, blank]), width)
    inside = np.arange(width) < least[:, None]
    differ = inside & (run[begin[x] + width] != run[begin[y] + width])
    behind = inside & (run[begin[x + 1]] != run[begin[y + 1]])[:, ::-1]
    start, end = (np.where(d.any(axis=1), d.argmax(axis=1), least) for d in (differ, behind))
    end = np.minimum(end, least - start)
    far = np.maximum(n, m) - start - end
    return start, end, np.where(n == m, np.minimum(far, differ.sum(axis=1)), far)


def at_most(words: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edits that turn the texts ``x`` into ``y`` (as in ``in_common``), maybe more than needed: what stands between equal
    beginnings and ends is replaced, or, of equal lengths, each word that differs."""
    return _ends(words, begin, x, y)[2]


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of the texts, A-Z lower-cased, one after the other, and where each text begins (and the last ends)."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int32)  # equal words, equal codes
    return words, split.offsets.to_numpy().astype(np.int64)


def similar_rows(a: pa.Array, b: pa.Array, percent: int = PERCENT) -> np.ndarray:
    """``similar`` for each pair of lines, by their words with A-Z lower-cased."""
    texts = pa.concat_arrays([x.cast(pa.large_string()) for x in (a, b)]).dictionary_encode()
    words, begin = _coded(texts.dictionary)
    which = texts.indices.to_numpy().astype(np.int64)
    return _similar(words, begin, which[: len(a)], which[len(a) :], percent)


def _similar(words: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """``similar`` for each pair of the texts ``x`` and ``y`` (as in ``in_common``)."""
    size = np.diff(begin)
    most = np.maximum(size[x], size[y])
    out = 100 * np.minimum(size[x], size[y]) >= percent * most
    some = np.flatnonzero(out & (most <= MOST_WORDS))
    some = some[np.argsort(most[some], kind="stable")]
    longest, at = most[some], 0
    inner = []  # what stands between equal beginnings and ends
    while at < len(some):
        until = min(at + AT_ONCE, int(np.searchsorted(longest, 2 * longest[at], "right")))
        part, at = some[at:until], until
        start, end, edits = _ends(words, begin, x[part], y[part])
        out[part] = 100 * edits <= (100 - percent) * most[part]
        left = ~out[part] & (np.minimum(size[x[part]], size[y[part]]) > start + end)  # else these edits are the distance
        left[left] = 100 * in_common(words, begin, x[part[left]], y[part[left]]) >= percent * most[part[left]]
        inner.append(np.stack([part[left], start[left], *(size[i[part[left]]] - start[left] - end[left] for i in (x, y))]))
    inner = np.concatenate(inner, axis=1) if inner else np.zeros((4, 0), np.int64)
    wide = np.maximum(*inner[2:])
    by = np.argsort(wide, kind="stable")
    inner, wide, at = inner[:, by], wide[by], 0
    while at < len(wide):
        until = min(at + AT_ONCE, int(np.searchsorted(wide, max(64, 2 * wide[at]), "right")))
        (own, start, *sizes), place, at = inner[:, at:until], np.arange(int(wide[until - 1])), until
        grid = lambda i, k, none: np.where(place < sizes[k][:, None], words[np.minimum((begin[i[own]] + start)[:, None] + place, len(words) - 1)], np.int32(none))  # noqa: B023, E731
        out[own] = 100 * (most[own] - distances(grid(x, 0, -1), grid(y, 1, -2), *sizes)) >= percent * most[own]
    long = np.flatnonzero(out & (most > MOST_WORDS))
    for at in range(0, len(long), LONG_AT_ONCE):
        part = long[at : at + LONG_AT_ONCE]
        out[part] = 100 * in_common(words, begin, x[part], y[part], LONG_CELLS) >= percent * most[part]
    for i in long[out[long]].tolist():
        out[i] = similar(*(words[begin[t] : begin[t + 1]].tolist() for t in (x[i], y[i])), percent)
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda x: texts.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def checked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            keep = pa.array(similar_rows(*(part.column(c).combine_chunks() for c in ("wa", "wb"))))
            return pa.RecordBatch.from_arrays([part.column(c).filter(keep).combine_chunks() for c in ("a", "b")], names=["a", "b"])
        held, full = [], 0
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column("wa")), pc.binary_length(batch.column("wb"))).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(size):
                before = int(size[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(size, before + MOST_BYTES - full, "right")))
                held.append(batch.slice(at, end - at))
                full += int(size[end - 1]) - before
                at = end
                if full >= MOST_BYTES or at < len(size):
                    yield checked(held)
                    held, full = [], 0
        if held:
            yield checked(held)
    return rows.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _groups(lines: DataFrame, often: np.ndarray, docs: DataFrame, copied: bool, id_col: str, text_col: str) -> DataFrame:
    """``id, component`` of the distinct lines ``id, h1, sim, words, doc_id, th, at, bytes`` and ODD that are similar to another.
    ``copied``: whether rows share id and text."""
    entries = lines.agg(F.sum(F.ceil(F.col("words") * 2 * (100 - PERCENT) / 100) + 2)).first()[0] or 0
    met = staged(rare_pairs(docs, often, entries, text_col))
    shown = met.where(F.col("key").isNotNull()).select("key", "h1")
    direct = met.where(F.col("key").isNull()).select("at", "pairs").groupBy("at").applyInArrow(_twice, "a long, b long")
    direct = direct.select(*(x(F.col("a"), F.col("b")).alias(c) for x, c in ((F.least, "ha"), (F.greatest, "hb"))))
    width = 64 // BLOCKS
    block = lambda i: lines.select("h1", F.shiftrightunsigned("sim", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("bits"))
    alike = [block(i).groupBy("bits").agg(F.min("h1").alias("h1"), F.max("h1").alias("end")).where("h1 <> end") for i in range(BLOCKS)]
    alike = functools.reduce(DataFrame.union, alike).select(F.least("h1", "end").alias("ha"), F.greatest("h1", "end").alias("hb"))
    side = lambda x: lines.select(F.col("h1").alias(f"h{x}"), F.col("id").alias(x), F.col("words").alias(f"n{x}"), *(F.col(o).alias(f"{o}{x}") for o in ODD))
    apart = " + ".join(f"bit_count({o}a ^ {o}b)" for o in ODD)
    bound = F.expr(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb) and 100 * ({apart} + abs(na - nb)) <= {2 * (100 - PERCENT)} * greatest(na, nb)")
    bounded = direct.union(alike).distinct().join(side("a"), "ha").join(side("b"), "hb").where(bound).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = staged(lines.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "th", "at", "bytes"))
        out = staged(_texts(wanted, docs, copied, id_col, text_col))
        release(wanted)
        return out
    sizes = staged(shown.groupBy("key").count())
    meeting = staged(_meeting(shown, sizes, lines, None))
    pairs = staged(bounded.union(meeting.where("key is null").select("a", "b")).distinct())
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    links = staged(_verified(pairs, texts))
    release(texts)
    found = components(links)
    dense = meeting.where("key is not null")
    if dense.take(1):  # lines of these keys that are still in different groups
        if found.count() <= MOST_BROADCAST:
            known, rooms = [], _apart(dense.select("cell"), found, True)
        else:
            known = [staged(dense.select("key").distinct())]
            known.append(staged(shown.join(known[0], "key", "left_semi")))
            own = few(known[1].select("h1"))
            rooms = _meeting(known[1], sizes, lines if own is None else lines.join(own, "h1", "left_semi"), found, True)
        rooms = staged(rooms)
        texts = texts_of(rooms.select(F.explode("ids").alias("id")))
        more = staged(_linked(rooms, texts))
        before, found = found, _joined(found, more)
        release(before, *known, rooms, texts, more)
    release(met, sizes, meeting, pairs, links)
    return found.select(F.col("node").alias("id"), "component")


def _meeting(shown: DataFrame, sizes: DataFrame, lines: DataFrame, found: DataFrame | None, roomed: bool = False) -> DataFrame:
    """Pairs ``a, b`` of ids of the lines of a key in ``shown`` (``key, h1``) that the bound allows to be similar. Without
    ``found`` each line meets MOST_FIRST shorter or equal ones of a key at most, and rows without a pair name the ``key`` where
    there are more, with its lines packed in ``cell``; with ``found`` every two of different groups meet. ``sizes``: how many rows a key has. Lines of a key of more than
    MOST_CELL are dealt into parts, any two of which meet apart. ``roomed``: the lines of these pairs as ``_rooms`` packs them, with ``found``."""
    own = lines.select("id", "h1", "words", *ODD)
    if found is not None:
        own = own.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    buckets = max(8, -(-(total or 0) // MOST_DEALT))
    place = [F.lit(0).alias(c) for c in "ijp"]
    if (most or 0) > MOST_CELL:
        parts = F.broadcast(sizes.where(F.col("count") > MOST_CELL).select("key", F.ceil(F.col("count") / (MOST_CELL // 2)).cast("int").alias("parts")))
        rows = shown.join(parts, "key", "left").withColumn("p", F.pmod(F.xxhash64("h1"), F.coalesce("parts", F.lit(1))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        rows = rows.select("key", "h1", "p", other.alias("o")).select("key", "h1", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p")
    else:
        rows = shown.select("key", "h1", *place)
    rows = rows.join(own, "h1").drop("h1").withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
    if roomed:
        return rows.groupBy("bucket").applyInArrow(lambda x: pa.Table.from_batches(_rooms(cell for _, cell in _cells(x)), ROOM), "room string, ids array<long>, cells binary")
    limit = MOST_FIRST if found is None else None
    return rows.groupBy("bucket").applyInArrow(lambda x: _met_lines(x, limit), "a long, b long, key long, cell binary")


def _apart(cells: DataFrame, found: DataFrame, roomed: bool = False) -> DataFrame:
    """``_meeting`` with ``found``, of at most MOST_BROADCAST nodes, for the packed lines that ``_meeting`` left without it."""
    groups = found.select("node", "component").toArrow()
    node, component = (groups.column(c).to_numpy() for c in ("node", "component"))
    by = np.argsort(node)
    node, component = node[by], component[by]
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for cell in batch.column("cell"):
                ids, n, part, *odd = np.frombuffer(cell.as_buffer(), np.int64).reshape(3 + len(ODD), -1)
                at = np.minimum(np.searchsorted(node, ids), max(len(node) - 1, 0))
                group = np.where(node[at] == ids, component[at], ids) if len(node) else ids
                yield ids, n, [o.view(np.uint64) for o in odd], group, part
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches):
            for pairs in _cell_pairs(*cell, None)[0]:
                x, y = np.ascontiguousarray(pairs.T)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    lines = cells.agg(F.sum(F.octet_length("cell"))).first()[0] // (8 * (3 + len(ODD)))
    cells = cells.repartition(max(8, -(-lines // MOST_DEALT)))
    if roomed:
        return cells.mapInArrow(lambda batches: _rooms(grouped(batches)), "room string, ids array<long>, cells binary")
    return cells.mapInArrow(run, "a long, b long")


ROOM = pa.schema([("room", pa.string()), ("ids", pa.list_(pa.int64())), ("cells", pa.binary())])


def _rooms(cells: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``room, ids, cells``: of the cells (arguments of ``_allowed``) the lines that have a pair, for as many cells together as
    ROOM_WORDS and ROOM_LINES allow, and their distinct ids."""
    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([uuid.uuid4().hex], [list(known)], [np.concatenate(held, axis=1).tobytes()]), ROOM.types, strict=True)], schema=ROOM)
    held, known, size = [], {}, 0
    for ids, n, odd, group, part in cells:
        some = np.zeros(len(ids), bool)
        for x, y in _allowed(ids, n, odd, group, part):
            some[x] = some[y] = True
        if not some.any():
            continue
        held.append(np.stack([np.full(some.sum(), len(held)), *(c[some].view(np.int64) for c in (ids, n, group, part, *odd))]))
        known.update(zip(ids[some].tolist(), n[some].tolist(), strict=True))
        size += int(some.sum())
        if size > ROOM_LINES or sum(known.values()) > ROOM_WORDS:
            yield packed()
            held, known, size = [], {}, 0
    if held:
        yield packed()


def _linked(rooms: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the groups of the lines of each room, one for each two groups that meet."""
    wanted = rooms.select("room", F.explode("ids").alias("id")).join(texts, "id").select("room", F.lit(None).cast("binary").alias("cells"), "id", "words")
    rows = rooms.select("room", "cells", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("words")).union(wanted)
    return rows.groupBy("room").applyInArrow(_room_links, "a long, b long")


def _room_links(rows: pa.Table) -> pa.Table:
    """What ``_linked`` finds in a room."""
    packed = rows.filter(pc.is_valid(rows.column("cells"))).column("cells")[0].as_py()
    number, ids, n, group, part, *odd = np.frombuffer(packed, np.int64).reshape(5 + len(ODD), -1)
    texts = rows.filter(pc.is_valid(rows.column("id"))).combine_chunks().sort_by("id")
    every = texts.column("id").to_numpy()
    words, begin = _coded(pc.cast(texts.column("words"), pa.large_string()).combine_chunks())
    row, (_, own) = np.searchsorted(every, ids), np.unique(group, return_inverse=True)
    group_of = np.zeros(len(every), np.int64)
    group_of[row] = own
    top = np.arange(own.max() + 1)  # of each group
    tested, links = np.zeros(0, np.int64), []
    def test(pairs: np.ndarray) -> None:
        nonlocal tested, top
        pairs = np.setdiff1d(pairs, tested)
        x, y = pairs // len(every), pairs % len(every)
        open_ = top[group_of[x]] != top[group_of[y]]
        x, y, pairs = x[open_], y[open_], pairs[open_]
        near = _similar(words, begin, x, y)
        tested = np.union1d(tested if len(tested) < MOST_TESTED else tested[:0], pairs[~near])
        up = {}
        def root(g: int) -> int:
            while g in up:
                g = up[g]
            return g
        for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
            g, h = (root(int(top[group_of[k]])) for k in (i, j))
            if g != h:
                up[max(g, h)] = min(g, h)
                links.append((i, j))
        if up:
            roots = np.arange(len(top))
            for g in up:
                roots[g] = root(g)
            top = roots[top]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    held, size = [], 0
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True):
        cell = slice(start, end)
        for x, y in _allowed(ids[cell], n[cell], [o[cell].view(np.uint64) for o in odd], own[cell], part[cell]):
            x, y = row[cell][x], row[cell][y]
            some = top[group_of[x]] != top[group_of[y]]
            held.append((np.minimum(x, y) * len(every) + np.maximum(x, y))[some])
            size += len(held[-1])
            if size > AT_ONCE:
                test(np.concatenate(held))
                held, size = [], 0
    if size:
        test(np.concatenate(held))
    a, b = every[np.array(links, np.int64).reshape(-1, 2)].T
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _allowed(ids, n, odd, group, part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the lines (numbers) of a cell, sorted by length, that are of different groups and that the bound allows, of different
    parts if ``part`` isn't negative; those of some of the longer or equal lines at once."""
    if (group == group[0]).all():
        return
    most = 2 * (100 - PERCENT) * n // 100
    shortest = np.searchsorted(n, -(-PERCENT * n[::AT_LENGTH] // 100))
    for a, lo in zip(range(0, len(ids), AT_LENGTH), shortest.tolist(), strict=True):
        b = min(a + AT_LENGTH, len(ids))
        apart = np.bitwise_count(odd[0][a:b, None] ^ odd[0][lo:b])
        apart += np.bitwise_count(odd[1][a:b, None] ^ odd[1][lo:b])
        y, x = np.nonzero(apart <= ((most - n)[a:b, None] + n[lo:b]))
        x, y = x + lo, y + a
        some = (x < y) & (100 * n[x] >= PERCENT * n[y])
        x, y = x[some], y[some]
        some = (group[x] != group[y]) & ((part[x] < 0) | (part[x] != part[y]))
        some &= sum(np.bitwise_count(o[x] ^ o[y]).astype(np.int64) for o in odd) + n[y] - n[x] <= most[y]
        yield x[some], y[some]


def _cell_pairs(ids, n, odd, group, part, limit: int | None) -> tuple[list[np.ndarray], bool]:
    """The pairs of ``_allowed`` by ids; and whether ``limit`` left some out."""
    pairs, dense = [], False
    for x, y in _allowed(ids, n, odd, group, part):
        if limit is not None and len(y):
            new = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            stays = np.arange(len(y)) - np.repeat(new, np.diff(np.append(new, len(y)))) < limit
            dense |= not stays.all()
            x, y = x[stays], y[stays]
        if len(x):
            pairs.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1))
    return pairs, dense


def _cells(rows: pa.Table) -> Iterator[tuple]:
    """The cells of a bucket of ``_meeting``, with their keys, as arguments of ``_allowed``."""
    read = lambda c: rows.column(c).to_numpy()
    ids, n = read("id"), read("words").astype(np.int64)
    cell = read("key").view(np.uint64) ^ mix((read("i").astype(np.uint64) << np.uint64(32)) | read("j").astype(np.uint64))
    by = np.lexsort((ids, n, cell))
    once = np.ones(len(by), bool)
    once[1:] = (cell[by[1:]] != cell[by[:-1]]) | (ids[by[1:]] != ids[by[:-1]])
    by = by[once]
    ids, n, cell = ids[by], n[by], cell[by]
    key, part = read("key")[by], np.where(read("i") != read("j"), read("p"), -1)[by].astype(np.int64)
    odd = [read(o)[by].view(np.uint64) for o in ODD]
    group = read("component")[by] if "component" in rows.column_names else ids
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
        own = slice(start, end)
        yield key[start], (ids[own], n[own], [o[own] for o in odd], group[own], part[own])


def _met_lines(rows: pa.Table, limit: int | None) -> pa.Table:
    """What ``_meeting`` finds in a bucket."""
    pairs, dense, cells = [], [], []
    for key, cell in _cells(rows):
        new, more = _cell_pairs(*cell, limit)
        pairs += new
        if more:
            ids, n, odd, _, part = cell
            dense.append(key)
            cells.append(np.concatenate([x.view(np.int64) for x in (ids, n, part, *odd)]).tobytes())
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    column = lambda x, more, front: pa.concat_arrays([x, pa.nulls(more, x.type)][:: 1 if front else -1])
    columns = [column(pa.array(np.ascontiguousarray(pairs[:, i])), len(dense), True) for i in range(2)]
    return pa.table([*columns, column(pa.array(dense, pa.int64()), len(pairs), False), column(pa.array(cells, pa.binary()), len(pairs), False)], names=["a", "b", "key", "cell"])


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The groups ``node, component`` in ``found`` after more ``links`` between their nodes or others, staged."""
    for x in "ab":
        label = found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        links = links.join(label, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    over = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    into = over.select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = found.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    new = over.join(found, "node", "left_anti").select("node", "component")
    out = staged(known.union(new))
    release(over)
    return out


def _texts(wanted: DataFrame, docs: DataFrame, copied: bool, id_col: str, text_col: str) -> DataFrame:
    """``id, words``: the lines as they stand. ``copied``: whether rows share id and text."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.col("th")]
    per_doc = wanted.groupBy(*key).agg(F.collect_list(F.struct("at", "bytes", "id")).alias("which"))
    rows = _keyed(docs, id_col, text_col)
    known = few(wanted.select("th"))
    if known is not None:  # only their texts need to be dealt
        rows = rows.join(known, "th", "left_semi")
    rows = rows.join(per_doc.hint("shuffle_hash"), ["k", "none", "th"])
    cut = lambda b: F.transform("which", lambda x: F.struct(x["id"].alias("id"), F.substring(b, x["at"] + 1, x["bytes"]).alias("words")))
    rows = rows.select(F.explode(let(F.col("text").cast("binary"), cut)).alias("x")).select("x.id", F.col("x.words").cast("string").alias("words"))
    return rows.dropDuplicates(["id"]) if copied else rows


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row of ``docs``: struct ``kept`` of its columns, ``text`` without removed lines, ``n_lines, n_removed``."""
    occurring = staged(occurrences(docs, id_col, text_col))
    every = occurring.where(F.col("words").isNull())
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), F.col("th")]
    rows = _keyed(docs, id_col, text_col, row_of(docs).alias("kept"))
    copies = staged(every.where("lead").groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    one = [F.first(c).alias(c) for c in ("doc_id", "th", "at", "bytes", "sim", *ODD)]  # of one occurrence
    lines = every.groupBy("h1", "h2").agg(F.count("*").alias("of"), F.first("n").alias("words"), *one)
    lines = staged(lines.select(F.monotonically_increasing_id().alias("id"), "*"))
    long = lines.where(F.col("words") >= LEAST_FUZZY).drop("h2", "of")
    copied = bool(copies.take(1))
    groups = _groups(long, commonness(occurring), docs, copied, id_col, text_col)
    grouped = lines.select("id", "h1", "h2", "of").join(groups, "id", "left").where("component is not null or of > 1").withColumn("component", F.coalesce("component", "id"))
    repeated = staged(grouped.select("h1", "h2", "component"))
    release(lines)
    again = staged(every.join(repeated, ["h1", "h2"]).select("component", "doc_id", "th", "line", "at", "bytes"))
    first = again.groupBy("component").agg(F.min(F.struct("doc_id", "th", "line")).alias("first"))
    gone = again.join(first, "component").where("not (struct(doc_id, th, line) <=> first)")
    place = F.collect_set(F.struct("at", "bytes"))
    gone = gone.groupBy(*key).agg(place.alias("gone"))
    worded = every.select(*key, "at", "bytes").join(copies, ["k", "none", "th"], "left_semi").groupBy("k", "none", "th").agg(place.alias("all"))
    drops = staged(gone.join(worded, ["k", "none", "th"], "full"))
    release(occurring, repeated, again, copies)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines")
    known = few(drops.select("th"))
    touched, untouched = rows, None
    if known is not None:  # only texts that lose lines need to be dealt
        touched = rows.join(known, "th", "left_semi")
        untouched = rows.join(known, "th", "left_anti").select("kept", "text", n_lines, F.lit(0).cast("long").alias("n_removed"))
    copy = F.row_number().over(Window.partitionBy("k", "none", "th").orderBy(F.lit(0))) if copied else F.lit(1)
    touched = touched.join(drops.hint("shuffle_hash"), ["k", "none", "th"], "left").withColumn("i", copy)
    drop = F.coalesce(F.when(F.col("i") > 1, F.col("all")).otherwise(F.col("gone")), F.array().cast("array<struct<at:int,bytes:int>>"))
    touched = touched.withColumn("drop", F.array_sort(drop))
    begin = F.concat(F.array(F.lit(0)), F.transform("drop", lambda x: x["at"] + x["bytes"] + 1))
    end = F.concat(F.transform("drop", lambda x: x["at"]), F.array(F.octet_length("text") + 1))
    cut = lambda b: F.array_join(F.zip_with(begin, end, lambda x, y: F.substring(b, x + 1, y - x).cast("string")), "")
    ended = let(F.concat(F.col("text").cast("binary"), F.lit(b"\n")), cut).cast("binary")  # each line that stays with its line feed
    stay = let(ended, lambda b: F.substring(b, F.lit(1), F.octet_length(b) - 1)).cast("string")
    touched = touched.select("kept", F.when(F.size("drop") > 0, stay).otherwise(F.col("text")).alias("text"), n_lines, F.size("drop").cast("long").alias("n_removed"))
    return touched if untouched is None else touched.unionByName(untouched)


def thinned(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The columns of ``docs`` with the remaining texts; rows that lost lines and have no word left go."""
    rows = deduplicated(docs, id_col, text_col).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return rows.select(*(F.col("text").alias(text_col) if c == text_col else F.col(f"kept.{quoted(c)}").alias(c) for c in docs.columns))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("kept.doc_id", "text", "n_lines", "n_removed")


QUERIES = {"op9_lines": op9_lines}
SQL: dict[str, str] = {}
