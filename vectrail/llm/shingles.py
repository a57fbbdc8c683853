"""Hashes of words and sets of word shingles, by whole arrays.

Texts are read as UTF-8; A-Z are lower-cased; a word is a run of bytes other than the blank and 9 to 13, which is the
same as by characters. A word's hash mixes its bytes in, eight at a time. Buffers are
cut between words into segments, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
#: Texts that are handled at once, in bytes.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: The low bytes of a long, by their number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of words that are hashed together; longer ones are hashed one by one.
_TOGETHER = 512
#: Powers of BASE, as many as the longest word so far took.
_POWERS: list[np.ndarray] = []


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word of a buffer that ends with a blank."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while not _BLANK[data[end - 1]]:  # reaches the final blank at the latest
            more = np.flatnonzero(_BLANK[data[end : end + SEGMENT]])
            end = end + int(more[0]) + 1 if len(more) else min(end + SEGMENT, len(data))
        part = data[at:end]
        blank = (part == 32) | (part - np.uint8(9) < 5)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        first, last = edge[::2], edge[1::2]
        size = last - first
        eight = np.ndarray(len(part), "<u8", part.tobytes().lower() + bytes(8), 0, (1,))  # the eight bytes from each place
        found = mix(eight[first] & _LOW[np.minimum(size, 8)] ^ size.astype(np.uint64) * np.uint64(BASE))
        some, k = np.flatnonzero((size > 8) & (size <= _TOGETHER)), 8
        while len(some):
            left = size[some] - k
            found[some] = mix(found[some] * np.uint64(BASE) + (eight[first[some] + k] & _LOW[np.minimum(left, 8)]))
            some, k = some[left > 8], k + 8
        for i in np.flatnonzero(size > _TOGETHER).tolist():
            blocks = eight[first[i] : last[i] : 8].copy()
            blocks[-1] &= _LOW[(size[i] - 1) % 8 + 1]
            if not _POWERS or len(_POWERS[0]) < len(blocks):
                _POWERS[:] = [_powers(2 * len(blocks), BASE)]
            found[i] = mix(found[i : i + 1] + (mix(blocks) * _POWERS[0][: len(blocks)]).sum(dtype=np.uint64))[0]
        hashes.append(found)
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, the bytes of their texts (some ``most`` at once), each with a line feed after it, and where each begins; null is empty."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + 1)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        parts = column.slice(a, b - a).to_pylist()
        data = ("\n".join(x or "" for x in parts) + "\n").encode()
        begin = np.concatenate([[0], ends[a : b - 1] - (ends[a - 1] if a else 0)])
        yield a, b, np.frombuffer(data, np.uint8), begin
        a = b


def shingle_sets(data: np.ndarray, begin: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``k`` words; with fewer words one for them all; none without."""
    starts, hashes = words_of(data)
    cuts = np.append(np.searchsorted(starts, begin), len(starts))
    rolled = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(BASE) + hashes[i : i + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= k:
            part = np.sort(rolled[a : b - k + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole + h)
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
