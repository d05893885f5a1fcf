"""Media columns: payloads in tar shards, addressed by content.

A payload is stored as a PNG of 64 RGB pixels a row (192 samples of 8 bits), losslessly compressed,
as the member ``<sha256 of the payload>.png`` of a tar file.  A task appends its payloads to one
shard, each digest once; rows carry digest, shard, offset and length of the member's bytes.  Where
several shards hold a digest, the locator that sorts first counts.  Metadata columns come from range
reads of a member's first 33 bytes; payloads come from range reads of the whole member.

Shards lie under the shared folder and are named by task and attempt; the manifest, written by
Spark's committer, names only shards of attempts that succeeded, so a lost executor's half-written
shard is never read.  Shards are opened by URI through pyarrow's file systems.

A payload that several tasks have is a member of each one's shard, since dealing payloads by digest would
shuffle all of them; only the member that the locator names is read.

Null text is the empty text, whose payload is 192 spaces.  Rows that repeat an id stay rows.
Equal payloads share one locator and all values.  Empty tables give empty results.  Other columns, whatever their
names, are ignored.  A task holds one payload of any length, about 8 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.workers import lean
from strandwise.llm.workspace import Workspace

UNIT = 192
PIXELS = 64
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(payload: bytes) -> bytes:
    size = max(1, -(-len(payload) // UNIT)) * UNIT
    return payload.ljust(size, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Lossless 8-bit RGB image of a payload whose length is a multiple of UNIT."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    scan = np.zeros((len(rows), UNIT + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(scan, 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits per sample, samples per pixel) from the first HEADER bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return width, height, bits, {0: 1, 2: 3, 4: 2, 6: 4}[colour]


def decode_png(data: bytes) -> bytes:
    """Samples of an image that :func:`encode_png` made."""
    width, height, _, samples = png_header(data)
    at, body = HEADER, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    scan = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width * samples + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows")
    return scan[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean sample in thousandths, then a 64-bit mean hash: which of 64 stretches lie above the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, edges = int(x.sum()), np.arange(64) * len(x) // 64
    ends = np.append(edges[1:], len(x))
    sums = np.add.reduceat(x, edges)
    bits = np.packbits(sums * len(x) > total * (ends - edges)).tobytes().hex()
    return f"{total * 1000 // len(x)}-{bits}"


def _file_system(uri: str):
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))
    return found, path


class ShardWriter:
    """Appends members to one tar file."""

    def __init__(self, uri: str):
        self.uri = uri
        where, path = _file_system(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.has = where.open_output_stream(path), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        """(offset, length) of the member's bytes."""
        if digest not in self.has:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % 512))
            self.has[digest] = (self.at + 512, len(data))
            self.at += 512 + len(data) + -len(data) % 512
        return self.has[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


MANIFEST = "doc_id long, n_bytes long, payload_sha256 string, shard string, offset long, length long"


def _store(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer = TaskContext.get(), None
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if writer is None:
                    writer = ShardWriter(f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tar")
                payload = pad(text or b"")
                digest = hashlib.sha256(payload).hexdigest()
                held = writer.has.get(digest)
                offset, length = held or writer.add(digest, encode_png(payload))
                rows.append((doc, len(text or b""), digest, writer.uri, offset, length))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])
        if writer is not None:
            writer.close()

    return run


def store(docs: DataFrame, root: str, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Write the payloads under ``root``; returns the manifest, to be saved before it is read twice."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(payload_col).cast("binary").alias("payload"))
    return rows.mapInArrow(lean(_store(root)), MANIFEST)


class RangeReader:
    """Range reads of shards, one of which stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            where, path = _file_system(uri)
            self.file, self.uri = where.open_input_file(path), uri
        return self.file.read_at(length, offset)


def _mapped(reads: tuple, extra: tuple[tuple[str, pa.DataType], ...], keep: tuple[str, ...]):
    """Adds to each locator what ``reads`` give, in one pass, so that a task needs one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for b in batches:
            got = [sum((read(reader, *x) for read in reads), ()) for x in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            cols = list(zip(*got, strict=True)) or [()] * len(extra)
            yield pa.record_batch([*[b.column(c) for c in keep], *[pa.array(c, t) for c, (_, t) in zip(cols, extra, strict=True)]], names=[*keep, *[n for n, _ in extra]])

    return run


def _head(reader: RangeReader, shard: str, offset: int, length: int) -> tuple:
    return png_header(reader.read(shard, offset, min(HEADER, length)))


def _features(reader: RangeReader, shard: str, offset: int, length: int) -> tuple:
    data = reader.read(shard, offset, length)
    payload = decode_png(data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)


LOCATOR = ("payload_sha256", "shard", "offset", "length")
_LOCATOR = "payload_sha256 string, shard string, offset long, length long"


def locators(manifest: DataFrame) -> DataFrame:
    """One locator per digest, dealt by shard and in the order of offsets."""
    first = manifest.groupBy("payload_sha256").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("payload_sha256", "at.*").repartition("shard").sortWithinPartitions("shard", "offset")


_METADATA = (("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("channels", pa.int32()))
_CONTENT = (("payload_bytes", pa.int64()), ("read_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def _schema(extra: tuple) -> str:
    return ", ".join([_LOCATOR, *[f"{n} { {pa.int64(): 'long', pa.int32(): 'int', pa.string(): 'string'}[t] }" for n, t in extra]])


def read_metadata(found: DataFrame) -> DataFrame:
    """Locators with width, height, bits and channels, reading headers only."""
    return found.mapInArrow(lean(_mapped((_head,), _METADATA, LOCATOR)), _schema(_METADATA))


def read_media(found: DataFrame) -> DataFrame:
    """Locators with the metadata of the headers, and with what the payloads read back have."""
    return found.mapInArrow(lean(_mapped((_head, _features), _METADATA + _CONTENT, LOCATOR)), _schema(_METADATA + _CONTENT))


def media_columns(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload_sha256 with its locator, metadata, and features read back."""
    ws = Workspace(spark, "media")
    manifest = ws.save(store(docs, ws.path("shards"), id_col, payload_col), "manifest")
    got = ws.save(read_media(locators(manifest)), "features")
    return manifest.select("doc_id", "n_bytes", "payload_sha256").join(got, "payload_sha256")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_columns(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", F.col("read_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "channels", "shard", "offset")
