"""Documents in chunks of a few MB, and an exchange of sorted 64-bit keys between chunks.

Grouping every n-gram or window of a corpus as rows costs tens of bytes and a JVM row each.  Here a
chunk of documents sends, for each range of the key space, one message that holds its distinct keys,
sorted and delta-coded, with a value for each; a range's task reduces the values of equal keys and answers
each message with one of values in the order of the keys sent.  A key that is everywhere is sent once a
chunk, whatever the number of its occurrences, and chunks and ranges are of bounded size.

Ranges grow in number with the chunks, so direct messages would grow with their square.  From ``2 ** FULL_BITS``
ranges on, ranges grow first, to ``MOST_CHUNKS_PER_RANGE``; a range's task works on a part of its keys at a time.  Beyond
``2 ** FAN_BITS`` ranges, keys go in hops, each of which holds and writes all keys once more: a chunk sends to that many coarse ranges at most, and as many
messages to one coarse range are reduced to one row, which sends on to the parts of the range as a chunk
does.  Messages a hop are at most ``2 ** FAN_BITS`` a chunk; hops grow with the logarithm of the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.workers import give_back, lean
from strandwise.llm.workspace import Workspace

CHUNK_BYTES = 2 << 20
CHUNKS_PER_RANGE = 4
MOST_CHUNKS_PER_RANGE = 16
#: Keys that a range's task orders and reduces at once, about; what it holds of others is their 64 bits and values.
PART_KEYS = 1 << 19
#: Chunks that a Python worker gets at once.
BATCH = 8
LEAST_RANGE_BITS = 7
#: Leading bits of keys from which on ranges grow before they grow in number.
FULL_BITS = 10
#: Leading bits of keys by which one hop parts them.
FAN_BITS = 12
NULL_ID = (1 << 63) - 1

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; works in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(32)
    return h


#: A random value for each byte, for a second hash that is independent of the first.
_VALUES = np.random.Generator(np.random.Philox(50)).integers(0, 1 << 64, 256, dtype=U64)


def gram_hashes(data: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """64-bit hash of the k bytes from each position of ``data`` (uint8) on; len(data) - k + 1 of them.
    ``second`` gives another hash, of other byte values."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    part, size, at = _VALUES[data] if second else data.astype(U64) + U64(1), 1, 0
    while True:
        if k & size:
            out *= U64(pow(_BASE, size, 1 << 64))
            out += part[at : at + n]
            at += size
        if size * 2 > k:
            return mix(out)
        part = part[:-size] * U64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        had = np.ones((n | 0x3FFFF) + 1, U64)
        size = 1
        while size < len(had):
            more = min(size, len(had) - size)
            had[size : size + more] = had[:more] * U64(pow(base, size, 1 << 64))
            size *= 2
        if len(had) <= 2 * CHUNK_BYTES:
            _POWERS[base] = had
    return had[:n]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word of documents that lie at ``offsets`` of ``data``.

    Words are runs of bytes other than space and 9 to 13; A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    out = ~_SEPARATOR[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = out[0], out[1:] & ~out[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = out[edge]
    starts = np.flatnonzero(first)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = out[-1], out[:-1] & ~out[1:]
    before = offsets[1:] - 1
    before = before[before >= 0]
    last[before] = out[before]
    ends = np.flatnonzero(last) + 1
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(inverse, len(data) + 1)[starts]
    h += (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return np.searchsorted(offsets, starts, side="right") - 1, mix(h)


def ngrams(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the runs of n words that lie in one document."""
    if len(word) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    m = len(word) - n + 1
    h = np.full(m, U64(n * _BASE % (1 << 64)), U64)
    for k in range(n):
        h = mix(h * U64(0xA0761D6478BD642F) + word[k : k + m])
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, h[at]


def _planes(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(a) else b"")


def _unplanes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, U64)
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return _planes(np.diff(a, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob), dtype=U64)


pack_values, unpack_values = _planes, _unplanes


def pack_bits(a: np.ndarray) -> bytes:
    raw = np.packbits(a).tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(a) else b"")


def unpack_bits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, bool)
    raw = pa.decompress(blob[8:], decompressed_size=-(-n // 8), codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


CHUNK = "chunk_id long, ids array<long>, offsets array<long>, text binary"
_CHUNK_ARROW = pa.schema([("chunk_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("text", pa.binary())])


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bytes]] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            rows = sorted(held, key=lambda x: x[0])
            offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([b"".join(t for _, t in rows)], pa.binary())], schema=_CHUNK_ARROW)

        for b in batches:
            for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                i, t = i.as_py(), t.as_py() or b""
                held.append((NULL_ID if i is None else i, t))
                total += len(t)
                if total >= size or len(held) >= size // 64:
                    yield chunk()
                    held, total, made = [], 0, made + 1
        if held:
            yield chunk()

    return run


def write_chunks(ws: Workspace, docs: DataFrame, name: str = "chunks", size: int = CHUNK_BYTES) -> DataFrame:
    """A written table of chunks of ``docs`` (doc_id, text), in each of which ids ascend; a null id is NULL_ID.

    Only once written are chunks fixed: read them from the table returned, never from the plan.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return ws.save(rows.mapInArrow(lean(_chunked(size)), CHUNK), name)


def range_bits(chunks: DataFrame) -> int:
    """How many leading bits of a key name its range, so that a range's keys stay few as chunks grow."""
    return bits_of(chunks.count())


def bits_of(chunks: int) -> int:
    needed = lambda each: math.ceil(math.log2(max(1, chunks / each)))
    return max(LEAST_RANGE_BITS, min(needed(CHUNKS_PER_RANGE), max(FULL_BITS, needed(MOST_CHUNKS_PER_RANGE))))


def split_ranges(keys: np.ndarray, bits: int, key_bits: int = 64) -> list[tuple[int, slice]]:
    """(range, where it lies) in sorted ``keys`` of ``key_bits`` bits; ranges without keys are left out."""
    if not len(keys):
        return []
    name = keys >> U64(key_bits - bits) if bits else np.zeros(len(keys), U64)
    edges = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(keys)]])
    return [(int(name[a]), slice(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Reduction:
    """What an exchange makes of equal keys.  Values are a tuple of arrays, one entry of each a key.

    A subclass packs values, reduces those of equal keys, and says what a sender is told."""

    key_bits = 64

    def pack(self, values: tuple[np.ndarray, ...]) -> bytes:
        raise NotImplementedError

    def unpack(self, blob: bytes) -> tuple[np.ndarray, ...]:
        raise NotImplementedError

    def order(self, keys: np.ndarray, values: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys, and in it where another key begins."""
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        return order, new

    def reduce(self, values: tuple[np.ndarray, ...], first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Values of the groups of sorted ``values`` that begin at ``first``."""
        raise NotImplementedError

    def told(self, own: tuple[np.ndarray, ...], reduced: tuple[np.ndarray, ...], above: np.ndarray | None) -> np.ndarray:
        """The answer to ``own`` values, from what they were reduced to and what that was ``told`` itself, if it was sent on."""
        raise NotImplementedError

    def pack_told(self, told: np.ndarray) -> bytes:
        return pack_values(told)

    def unpack_told(self, blob: bytes) -> np.ndarray:
        return unpack_values(blob)

    def merge(self, each: list[np.ndarray], own: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """(reduced keys, their values, all values, each one's place among the reduced) of messages."""
        every = np.concatenate(each)
        values = tuple(np.concatenate(c) for c in zip(*own, strict=True))
        order, new = self.order(every, values)
        first = np.flatnonzero(new)
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        return every[order][first], self.reduce(tuple(v[order] for v in values), first), values, place

    def messages(self, keys: np.ndarray, values: tuple[np.ndarray, ...], bits: int) -> list[tuple[int, bytes, bytes]]:
        return [(r, pack_sorted(keys[s]), self.pack(tuple(v[s] for v in values))) for r, s in split_ranges(keys, bits, self.key_bits)]

    def parts(self, keys: list[bytes], data: list[bytes]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
        """What ``merge`` gives, and how many keys each message has, for one part of the key space after another."""
        each, own = [unpack_sorted(k) for k in keys], [self.unpack(d) for d in data]
        cuts = _cuts(each)
        at = np.array([np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]) for k in each])
        for a, b in zip(at.T[:-1], at.T[1:], strict=True):
            s = [slice(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield *self.merge([k[x] for k, x in zip(each, s, strict=True)], [tuple(v[x] for v in o) for o, x in zip(own, s, strict=True)]), b - a

    def answers(self, keys: list[bytes], data: list[bytes], above: list[bytes] | None = None) -> list[bytes]:
        """An answer to each message of one range."""
        up = np.concatenate([self.unpack_told(x) for x in above]) if above is not None else None
        done, told = 0, [[] for _ in keys]
        for reduced_keys, reduced, values, place, sizes in self.parts(keys, data):
            part = self.told(values, tuple(v[place] for v in reduced), None if up is None else up[done : done + len(reduced_keys)][place])
            done += len(reduced_keys)
            for mine, x in zip(told, np.split(part, np.cumsum(sizes)[:-1]), strict=True):
                mine.append(x)
        return [self.pack_told(np.concatenate(x)) for x in told]


def _cuts(each: list[np.ndarray]) -> np.ndarray:
    """Keys that part sorted arrays into about PART_KEYS each; equal keys stay together."""
    total = sum(map(len, each))
    if total <= PART_KEYS:
        return np.zeros(0, U64)
    # One step over all messages, as the first keys of each would be low ones.
    some = np.sort(np.concatenate(each)[::17])
    n = -(-total // PART_KEYS)
    return np.unique(some[np.arange(1, n) * len(some) // n])


SENT = "range long, chunk_id long, keys binary, data binary"
GATHERED = "chunk_id long, range long, chunks array<long>, keys array<binary>, data array<binary>"
REPLY = "chunk_id long, range long, reply binary"
#: (sorted keys, values) of a row; None if it has none.
Sender = Callable[[dict], tuple[np.ndarray, tuple[np.ndarray, ...]] | None]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_py() for n in b.schema.names}


def arrays_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids) of a chunk."""
    return np.frombuffer(row["text"], np.uint8), np.array(row["offsets"], np.int64), np.array(row["ids"], np.int64)


def _sent(table: DataFrame, send: Sender, how: Reduction, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            got = send(row)
            if got is not None and (out := how.messages(*got, bits)):
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array([row["chunk_id"]] * len(out), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["range", "chunk_id", "keys", "data"])

    return table.mapInArrow(lean(run), SENT)


def exchange(ws: Workspace, name: str, table: DataFrame, send: Sender, how: Reduction, bits: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(chunk_id, replies), written as ``name``: for each row of ``table`` (chunk_id, ...) the (range, reply) of all ranges
    that it sent keys to, each reply in the order of the keys.  Keys go in hops of ``fan_bits``."""
    replies = _exchanged(ws, name, table, send, how, 0, bits, fan_bits)
    return ws.save(replies.groupBy("chunk_id").agg(F.collect_list(F.struct("range", "reply")).alias("replies")), name, batch=BATCH)


def _exchanged(ws: Workspace, name: str, table: DataFrame, send: Sender, how: Reduction, done: int, bits: int, fan_bits: int) -> DataFrame:
    """REPLY rows to ``table``, each row of which lies in one range of ``done`` bits."""
    to = min(bits, done + fan_bits)
    sent = _sent(table, send, how, to)
    if to == bits:

        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            try:
                return pd.DataFrame({"chunk_id": rows.chunk_id, "range": rows["range"], "reply": how.answers(list(rows["keys"]), list(rows["data"]))})
            finally:
                give_back()

        return sent.groupBy("range").applyInPandas(settle, REPLY)

    # About 2 ** fan_bits messages a row, so that rows are as many and as large as those that sent.
    groups = (MOST_CHUNKS_PER_RANGE if bits > FULL_BITS else CHUNKS_PER_RANGE) << (bits - to)
    dealt = sent.withColumn("group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)))
    listed = dealt.groupBy("range", "group").agg(F.collect_list(F.struct("chunk_id", "keys", "data")).alias("m"))
    gathered = ws.save(listed.select((F.col("range") * groups + F.col("group")).alias("chunk_id"), "range", F.col("m.chunk_id").alias("chunks"), "m.keys", "m.data"), f"{name}_hop{to}", batch=BATCH)

    def forward(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        done = [(keys, reduced) for keys, reduced, *_ in how.parts(row["keys"], row["data"])]
        return np.concatenate([k for k, _ in done]), tuple(np.concatenate(v) for v in zip(*[r for _, r in done], strict=True))

    above = _exchanged(ws, name, gathered, forward, how, to, bits, fan_bits)
    above = ws.save(above.groupBy("chunk_id").agg(F.collect_list(F.struct("range", "reply")).alias("replies")), f"{name}_above{to}", batch=BATCH)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            out = how.answers(row["keys"], row["data"], in_order(row["replies"]))
            yield pa.record_batch([pa.array(row["chunks"], pa.int64()), pa.array([row["range"]] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["chunk_id", "range", "reply"])

    return gathered.join(above, "chunk_id").mapInArrow(lean(back), REPLY)


def in_order(replies: list[dict] | None) -> list[bytes]:
    return [bytes(x["reply"]) for x in sorted(replies or [], key=lambda x: x["range"])]


def told(how: Reduction, replies: list[dict] | None) -> np.ndarray:
    """What all ranges answered, in the order of the keys."""
    return np.concatenate([how.unpack_told(r) for r in in_order(replies)])
