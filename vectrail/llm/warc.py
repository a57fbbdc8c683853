"""WARC archives as seekable Zstandard bundles.

Each bundle is one file: independent Zstandard frames, each holding a group of WARC/1.1 records, and at the end a
skippable frame with the seek table of the Zstandard seekable format (compressed and decompressed size of every
frame, then the number of frames, a descriptor and the magic number). An index row maps a record to bundle, frame
and offset within the decompressed frame, so one record costs one seek table, one frame and no scan.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response and the
others are revisits that refer to it; smaller payloads are all responses. A revisit holds no payload, but states
length and digest of the full one.

Bundles go through pyarrow's file systems to the folder in ``spark.checkpoint.dir``, so any store that pyarrow
reaches works. A task writes under a name of its own and reports it; files of lost or repeated attempts are never
reported, hence never read. The index is staged before anything is read back, so no bundle is written twice.

Defined results: null html is an empty payload; a null id is kept and sorts below all others; rows that share the
largest id of their payload are all responses; an empty table writes nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
RECORDS_PER_FRAME = 64
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """One WARC record; without ``payload`` a revisit."""
    kind = "revisit" if payload is None else "response"
    headers = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if payload is None:
        headers += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    headers += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload or b'')}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + (payload or b"") + b"\r\n\r\n"


def parse(block: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the end of the record at ``offset``."""
    end = block.index(b"\r\n\r\n", offset)
    lines = block[offset:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, block[start:stop], stop + 4


class Bundle:
    """Collects records to frames and frames to a file's bytes."""

    def __init__(self) -> None:
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames, self.table, self.open, self.open_bytes, self.where, self.size = [], [], [], 0, [], 0

    def add(self, page_id, data: bytes) -> None:
        self.where.append((page_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        if len(self.open) >= RECORDS_PER_FRAME or self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.table.append((len(packed), self.open_bytes))
            self.size += len(packed)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries


class Reader:
    """Random access to the frames of a bundle."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        sizes = list(struct.iter_unpack("<II", self._at(size - 9 - 8 * n, 8 * n)))
        self.sizes, self.starts, at = sizes, [], 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def _store(uri: str):
    """pyarrow's file system and the path in it, for a plain path, ``scheme:/path`` or ``scheme://host/path``."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri if rest.startswith("//") else f"{scheme}://{rest}")


def open_bundle(uri: str) -> Reader:
    store, path = _store(uri)
    return Reader(store.open_input_file(path), store.get_file_info(path).size)


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``page_id, url, html, size, digest, refers_to, revisit``; returns the index, staged."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        def flush(bundle: Bundle) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(bundle.finish())
            ids, frames, offsets, lengths = (list(x) for x in zip(*bundle.where, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "bundle", "frame", "offset", "length"])
        bundle = Bundle()
        for batch in batches:
            for row in batch.to_pylist():
                payload = None if row["revisit"] else (row["html"] or "").encode()
                bundle.add(row["page_id"], record(row["page_id"], row["url"], payload, row["size"], base64.b32encode(bytes.fromhex(row["digest"])).decode(), row["refers_to"]))
                if bundle.size >= BUNDLE_BYTES:
                    yield flush(bundle)
                    bundle = Bundle()
        if bundle.where:
            yield flush(bundle)
    return staged(records.mapInArrow(write, INDEX))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record that the index names, by its frame and offset: headers and the payload's measured length and digest.

    A bundle's entries come to one task, as they are bounded with the bundle; a frame is unpacked once for all of them.
    """
    schema = "page_id long, url string, record_type string, refers_to long, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    def number(urn: str):
        return int(urn[len("<urn:page:"):-1] or 0) if urn and urn != "<urn:page:>" else None
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, entries in zip(batch.column("bundle").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                reader, frame, block, rows = open_bundle(bundle), None, b"", []
                for e in sorted(entries, key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != frame:
                        frame, block = e["frame"], reader.frame(e["frame"])
                    headers, payload, end = parse(block, e["offset"])
                    if number(headers["WARC-Record-ID"]) != e["page_id"] or end - e["offset"] != e["length"]:
                        raise ValueError(f"{bundle}: the index and frame {frame} differ at {e['offset']}")
                    rows.append((e["page_id"], headers["WARC-Target-URI"], headers["WARC-Type"], number(headers.get("WARC-Refers-To", "")), int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload), base32_sha1(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
    bundles = index.groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("entries"))
    return bundles.mapInArrow(read, schema)


def records_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows for ``write_bundles``. Counts are summed by digest before they meet; the html takes part in one join."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    counts = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    rows = rows.join(staged(counts.where("n > 1")), ["digest", "size"], "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def archived(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the pages to bundles under ``folder``; returns the staged index."""
    return write_bundles(records_of(pages, least), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/vectrail-warc/{uuid.uuid4().hex}"
    read = read_bundles(archived(table(spark, sf_dir, "pages"), folder))
    revisit = F.col("record_type") == "revisit"
    broken = ~revisit & ((F.col("payload_bytes") != F.col("stated_bytes")) | (F.col("payload_digest") != F.col("stated_digest")))
    pick = lambda a, b: F.when(broken, F.raise_error("a payload differs from its digest")).when(revisit, F.col(a)).otherwise(F.col(b))
    return read.select("page_id", pick("stated_bytes", "payload_bytes").cast("long").alias("payload_bytes"), pick("stated_digest", "payload_digest").cast("string").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
#: Base 32 from the hexadecimal digest: 32 digits of five bits, read from its bits as text.
SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, html FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM h),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(bits, 5 * i + k + 1, 1) = '1' THEN [16, 8, 4, 2, 1][k + 1] ELSE 0 END))::INT, 1)), '') AS digest,
      max(page_id) OVER (PARTITION BY html) AS last, count(*) OVER (PARTITION BY html) AS c FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN c > 1 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d""",
}
