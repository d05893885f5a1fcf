"""Removal of repeated byte strings by a difference-cover suffix algorithm of bounded depth.

Suffixes need to be told apart only by their first ``LENGTH`` bytes, so the recursion ends early:

1. Sample: positions whose offset modulo 31 is in a perfect difference set of six.  Any two
   positions i, j have a shift below 31 at which both are sampled, so two equal strings of 50 bytes
   hold two sampled positions at the same place with at least 20 bytes left in the string.
2. Sort the sampled 20-byte tuples across the cluster (by fingerprint, as in sorting names) and keep
   the positions whose name another document has.  All other suffixes have no partner.  Recurse on
   the names that are left with longer tuples, of 35 and 36 bytes: every string that holds a kept
   position holds one of its two.
3. Merge: the remaining suffixes are those within 31 bytes before a kept position.  Their 50-byte
   prefixes are sorted across the cluster and adjacent equal ones compared by document: a prefix
   whose smallest document is smaller than the one at hand marks its 50 bytes.

All sorts exchange distinct keys of chunks (see ``blocks``).  Names may collide without harm, since
they only admit positions; prefixes are compared by 96 bits of two independent hashes, so that of 10^13 that
are compared, two different ones are taken for equal with a chance of under 1 in 1000.  Copies of a whole text are
found by digest first and never sampled.

Null text is empty; a null id, and 2^63 - 1, counts as larger than all others; rows that repeat id and text are
judged alike, and rows that repeat an id never remove from one another.  Texts of under 50 bytes
are left alone.  Empty tables give empty results.  Other columns, whatever their names, are ignored.  A text longer
than a chunk is a chunk of its own, for which a task holds about 60 bytes for each byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import blocks
from strandwise.llm.blocks import U64
from strandwise.llm.workers import lean
from strandwise.llm.workspace import Workspace

LENGTH = 50
#: A perfect difference set modulo 31.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
TUPLE = LENGTH - MODULUS + 1
HALF = 15
NAME_BITS = 29

_IN_COVER = np.zeros(MODULUS, bool)
_IN_COVER[list(COVER)] = True


def _sampled(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, document, fingerprint of its tuple) of the sampled positions of a chunk."""
    data, offsets, _ = blocks.arrays_of(row)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = np.arange(len(data)) - offsets[:-1][doc]
    at = np.flatnonzero(_IN_COVER[own % MODULUS] & (own + TUPLE <= sizes[doc]))
    return at, doc[at], blocks.gram_hashes(data, TUPLE)[at]


def _names(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, place of its name, sorted names, which of them several documents of the chunk have)."""
    at, doc, h = _sampled(row)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    return at[order], np.cumsum(new) - 1, h[first] >> U64(64 - NAME_BITS - bits), doc[first] != doc[last] if len(h) else np.zeros(0, bool)


class _Several(blocks.Reduction):
    """Whether several documents have a name."""

    def __init__(self, bits: int):
        self.key_bits = NAME_BITS + bits

    def pack(self, values: tuple[np.ndarray, ...]) -> bytes:
        return blocks.pack_bits(values[0])

    def unpack(self, blob: bytes) -> tuple[np.ndarray, ...]:
        return (blocks.unpack_bits(blob),)

    def reduce(self, values: tuple[np.ndarray, ...], first: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(first):
            return values
        return (np.logical_or.reduceat(values[0], first) | (np.diff(np.append(first, len(values[0]))) > 1),)

    def told(self, own: tuple[np.ndarray, ...], reduced: tuple[np.ndarray, ...], above: np.ndarray | None) -> np.ndarray:
        return reduced[0] if above is None else above

    def pack_told(self, told: np.ndarray) -> bytes:
        return blocks.pack_bits(told)

    def unpack_told(self, blob: bytes) -> np.ndarray:
        return blocks.unpack_bits(blob)


def _send_names(bits: int) -> blocks.Sender:
    def send(row: dict):
        _, _, names, several = _names(row, bits)
        return names, (several,)

    return send


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the intervals."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


SEGMENTS = "chunk_id long, ids array<long>, docs array<int>, starts array<long>, sizes array<long>, text binary, marks array<long>"


def _windows(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bytes of the windows that begin in one of [low, high], as maximal pieces that keep within the units at
    ``offsets``: (unit, start in data, bytes) of each."""
    starts, ends = _runs(_cover(low, high + 1, len(data)))
    # A run of windows may go on from one unit to the next.
    unit = np.searchsorted(offsets, starts, side="right") - 1
    last = np.searchsorted(offsets, ends - 1, side="right") - 1
    cuts = np.sort(np.concatenate([starts, *[offsets[u + 1 : e + 1] for u, e in zip(unit, last, strict=True) if e > u]]))
    stop = np.minimum(np.append(cuts[1:], len(data)), ends[np.searchsorted(starts, cuts, side="right") - 1])
    return np.searchsorted(offsets, cuts, side="right") - 1, cuts, [data[a : b + LENGTH - 1] for a, b in zip(cuts, stop, strict=True)]


def _segment_batch(row: dict, docs: np.ndarray, starts: np.ndarray, pieces: list[np.ndarray], marks: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([row["chunk_id"]], pa.int64()),
            pa.array([row["ids"]], pa.list_(pa.int64())),
            pa.array([docs.tolist()], pa.list_(pa.int32())),
            pa.array([starts.tolist()], pa.list_(pa.int64())),
            pa.array([[len(p) for p in pieces]], pa.list_(pa.int64())),
            pa.array([np.concatenate(pieces).tobytes()], pa.binary()),
            pa.array([marks.tolist()], pa.list_(pa.int64())),
        ],
        names=[x.split()[0] for x in SEGMENTS.split(", ")],
    )


def _segments(bits: int):
    """Of a chunk, the stretches of text whose 50-byte windows may have a partner, and the kept positions in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            at, place, _, _ = _names(row, bits)
            kept = np.sort(at[blocks.told(_Several(bits), row["replies"])[place]])
            data, offsets, _ = blocks.arrays_of(row)
            doc = np.searchsorted(offsets, kept, side="right") - 1
            low, high = np.maximum(kept - (MODULUS - 1), offsets[doc]), np.minimum(kept, offsets[doc + 1] - LENGTH)
            fit = high >= low
            if not fit.any():
                continue
            docs, cuts, pieces = _windows(data, offsets, low[fit], high[fit])
            own = np.cumsum([0] + [len(p) for p in pieces])[:-1]
            piece = np.searchsorted(cuts, low[fit], side="right") - 1
            yield _segment_batch(row, docs, cuts - offsets[docs], pieces, own[piece] + kept[fit] - cuts[piece])

    return run


def _longer(row: dict, bits: int) -> tuple[np.ndarray, ...]:
    """The longer tuples of a row's segments: (low, high) of the windows that each stands for, its name's place, the
    sorted names, and which of them several documents of the chunk have.

    A window that holds a kept position in its first HALF + 1 bytes holds the LENGTH - HALF bytes from there on;
    any other holds the HALF + 1 bytes before it with the TUPLE bytes from there on.
    """
    data, sizes, marks = np.frombuffer(row["text"], np.uint8), np.array(row["sizes"], np.int64), np.array(row["marks"], np.int64)
    docs = np.array(row["docs"], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    # A mark may lie where no window of its segment begins, but never outside of the segment's windows' bytes.
    seg = np.searchsorted(offsets, marks, side="right") - 1
    first, last = offsets[seg], offsets[seg + 1] - LENGTH
    after_low, after_high = np.maximum(marks - HALF, first), np.minimum(marks, last)
    before_low, before_high = np.maximum(marks - (MODULUS - 1), first), np.minimum(marks - HALF - 1, last)
    after, before = np.flatnonzero(after_high >= after_low), np.flatnonzero(before_high >= before_low)
    h = np.concatenate([blocks.gram_hashes(data, LENGTH - HALF)[marks[after]], blocks.gram_hashes(data, TUPLE + HALF + 1)[marks[before] - HALF - 1] ^ U64(0x9E3779B97F4A7C15)])
    owner = docs[np.concatenate([seg[after], seg[before]])]
    low, high = np.concatenate([after_low[after], before_low[before]]), np.concatenate([after_high[after], before_high[before]])
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.flatnonzero(new)
    several = owner[group] != owner[np.append(group[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
    return low[order], high[order], np.cumsum(new) - 1, h[group] >> U64(64 - NAME_BITS - bits), several


def _send_longer(bits: int) -> blocks.Sender:
    def send(row: dict):
        _, _, _, names, several = _longer(row, bits)
        return names, (several,)

    return send


def _narrow(bits: int):
    """Of a row's segments, the windows whose longer tuples another document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            low, high, place, _, _ = _longer(row, bits)
            kept = blocks.told(_Several(bits), row["replies"])[place]
            if not kept.any():
                continue
            sizes = np.array(row["sizes"], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            seg, cuts, pieces = _windows(np.frombuffer(row["text"], np.uint8), offsets, low[kept], high[kept])
            docs, starts = np.array(row["docs"], np.int64)[seg], np.array(row["starts"], np.int64)[seg] + cuts - offsets[seg]
            yield _segment_batch(row, docs, starts, pieces, np.zeros(0, np.int64))

    return run


def _prefixes(row: dict) -> tuple[np.ndarray, ...]:
    """The windows in the order of their prefixes, which are known by two hashes, as (window, place of its prefix, sorted
    first hashes of the prefixes, their second hashes, smallest id of each, id of the window's document, segment of each
    window); windows are in the order of the segments' bytes."""
    data, sizes = np.frombuffer(row["text"], np.uint8), np.array(row["sizes"], np.int64)
    ids = np.array(row["ids"], np.int64)[np.array(row["docs"], np.int64)]
    segment = np.repeat(np.arange(len(sizes)), sizes - LENGTH + 1)
    at = np.arange(len(segment)) + segment * (LENGTH - 1)
    h, check = blocks.gram_hashes(data, LENGTH)[at], (blocks.gram_hashes(data, LENGTH, second=True)[at] >> U64(32)).astype("<u4")
    owner = ids[segment]
    order, new = PREFIXES.order(h, (check,))
    h, check, owner = h[order], check[order], owner[order]
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, h[first], check[first], np.minimum.reduceat(owner, first), owner, segment


def _pack_ids(ids: np.ndarray, which: np.ndarray) -> bytes:
    """``ids[which]`` of ascending ``ids``, of which a chunk has far fewer than it has prefixes."""
    used, which = np.unique(which, return_inverse=True)
    table = blocks.pack_sorted(ids[used].astype(U64))
    return len(table).to_bytes(8, "little") + table + blocks.pack_values(which.astype(U64))


def _unpack_ids(blob: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(blob[:8], "little")
    return blocks.unpack_sorted(blob[8:size]).astype(np.int64)[blocks.unpack_values(blob[size:]).astype(np.int64)]


class _Smallest(blocks.Reduction):
    """The smallest document that has a prefix; a sender is told whether that is smaller than its own.

    Keys of one first hash are told apart by 32 bits of the second, which are a value's first entry."""

    def pack(self, values: tuple[np.ndarray, ...]) -> bytes:
        check = np.ascontiguousarray(values[0]).tobytes()
        return len(check).to_bytes(8, "little") + check + _pack_ids(*np.unique(values[1], return_inverse=True))

    def unpack(self, blob: bytes) -> tuple[np.ndarray, ...]:
        size = 8 + int.from_bytes(blob[:8], "little")
        return np.frombuffer(blob[8:size], "<u4"), _unpack_ids(blob[size:])

    def order(self, keys: np.ndarray, values: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        other = values[0][order][1:] != values[0][order][:-1]
        if (other & ~new[1:]).any():
            # Some first hash stands for several prefixes.
            order = np.lexsort((values[0], keys))
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (values[0][order][1:] != values[0][order][:-1])
        return order, new

    def reduce(self, values: tuple[np.ndarray, ...], first: np.ndarray) -> tuple[np.ndarray, ...]:
        return (values[0][first], np.minimum.reduceat(values[1], first)) if len(first) else values

    def told(self, own: tuple[np.ndarray, ...], reduced: tuple[np.ndarray, ...], above: np.ndarray | None) -> np.ndarray:
        smaller = reduced[1] < own[1]
        return smaller if above is None else smaller | above

    def pack_told(self, told: np.ndarray) -> bytes:
        return blocks.pack_bits(told)

    def unpack_told(self, blob: bytes) -> np.ndarray:
        return blocks.unpack_bits(blob)


PREFIXES = _Smallest()


def _send_prefixes(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    _, _, prefixes, check, smallest, _, _ = _prefixes(row)
    return prefixes, (check, smallest)


SPANS = "chunk_id long, docs array<int>, starts array<long>, ends array<long>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk's segments, the maximal runs of bytes that go, by document."""
    for row in blocks.rows_of(batches):
        order, place, _, _, smallest, owner, segment = _prefixes(row)
        earlier = blocks.told(PREFIXES, row["replies"])
        goes = np.empty(len(order), bool)
        goes[order] = earlier[place] | (owner > smallest[place])
        sizes, starts, docs = (np.array(row[c], np.int64) for c in ("sizes", "starts", "docs"))
        at = np.flatnonzero(goes)
        seg = segment[at]
        first = np.concatenate([[0], np.cumsum(sizes - LENGTH + 1)])[:-1]
        begin = starts[seg] + at - first[seg]
        doc = docs[seg]
        # Windows ascend by document and place: a new run begins where a window doesn't touch the one before.
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + LENGTH)
        k = np.flatnonzero(new)
        last = np.append(k[1:], len(at)) - 1
        if len(k):
            yield pa.record_batch([pa.array([row["chunk_id"]], pa.int64()), pa.array([doc[k].tolist()], pa.list_(pa.int32())), pa.array([begin[k].tolist()], pa.list_(pa.int64())), pa.array([(begin[last] + LENGTH).tolist()], pa.list_(pa.int64()))], names=["chunk_id", "docs", "starts", "ends"])


KEPT = "doc_id long, digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.rows_of(batches):
            data, offsets, ids = row["text"], row["offsets"], row["ids"]
            by_doc: dict[int, list[tuple[int, int]]] = {}
            for d, s, e in zip(row["docs"] or [], row["starts"] or [], row["ends"] or [], strict=True):
                by_doc.setdefault(d, []).append((s, e))
            out = []
            for d, own in by_doc.items():
                text = data[offsets[d] : offsets[d + 1]]
                parts, at = [], 0
                for s, e in own:
                    parts.append(text[at:s])
                    at = e
                kept = b"".join([*parts, text[at:]])
                out.append((None if ids[d] == blocks.NULL_ID else ids[d], hashlib.sha256(text).digest(), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore").encode() if with_text else None))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in KEPT.split(", ")])

    return run


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def suffix_dedup(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256, kept: one row per row of ``docs`` (doc_id, text).

    ``kept`` is what stays of texts that lose bytes, if ``with_text``, and null otherwise; it is UTF-8, so
    where a cut parts a character, the character's other bytes go from it too.
    """
    ws = Workspace(spark, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", _digest("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(blocks.NULL_ID))
    keys = ws.save(rows.select("doc_id", "digest", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "keys")
    # Written, so that joins on a digest that many rows have read both sides from shuffles and can be split.
    firsts = ws.save(keys.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min(order).alias("first")), "firsts")
    # One row of each text that is long enough to share anything.
    chosen = firsts.select(F.col("first").alias("__id"), F.col("digest").alias("__digest"))
    alone = rows.withColumn("__order", order).join(chosen.hint("merge"), (F.col("__order") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_semi")
    chunks = blocks.write_chunks(ws, alone.select("doc_id", "text"))
    del alone
    ws.release()
    bits = blocks.range_bits(chunks)
    names = blocks.exchange(ws, "names", chunks, _send_names(bits), _Several(bits), bits)
    ws.release()
    segments = ws.save(chunks.join(names, "chunk_id").mapInArrow(lean(_segments(bits)), SEGMENTS), "segments", batch=blocks.BATCH)
    del names
    ws.release()
    longer = blocks.exchange(ws, "longer", segments, _send_longer(bits), _Several(bits), bits)
    ws.release()
    segments = ws.save(segments.join(longer, "chunk_id").mapInArrow(lean(_narrow(bits)), SEGMENTS), "narrow", batch=blocks.BATCH)
    del longer
    ws.drop("names", "segments", "longer")
    ws.release()
    prefixes = blocks.exchange(ws, "prefixes", segments, _send_prefixes, PREFIXES, bits)
    ws.release()
    spans = ws.save(segments.join(prefixes, "chunk_id").mapInArrow(lean(_spans), SPANS), "spans", batch=blocks.BATCH)
    del segments, prefixes
    ws.drop("narrow", "prefixes")
    ws.release()
    cut = ws.save(chunks.join(spans, "chunk_id").mapInArrow(lean(_kept(with_text)), KEPT), "cut", batch=blocks.BATCH)
    ws.drop("chunks", "spans")
    # Rows that repeat a text chunked under one id: the id's own row stands for it; copies under larger ids go whole.
    cut = cut.withColumn("__order", order).withColumnRenamed("digest", "__digest").drop("doc_id").dropDuplicates(["__order", "__digest"])
    out = keys.withColumn("o", order).join(firsts.hint("merge"), "digest", "left").join(cut, (F.col("o") == F.col("__order")) & (F.col("digest") == F.col("__digest")), "left")
    copy = F.col("first").isNotNull() & (F.col("o") > F.col("first"))
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated bytes; rows of which nothing stays go."""
    cut = suffix_dedup(spark, docs.select("doc_id", "text"), with_text=True).filter("kept is not null").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("kept").cast("string").alias("__kept"))
    cut = cut.dropDuplicates(["__id", "__digest"])
    joined = docs.join(cut.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_digest("text") == F.col("__digest")), "left")
    text = F.coalesce(F.col("__kept"), F.col("text"))
    return joined.filter("__kept is null or __kept <> ''").select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("digest", "kept")


SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, b[i:i + 49] as s from (select doc_id, b, unnest(range(1, n - 48)) as i from d where n >= 50)),
m as (select s, min(doc_id) as first from w group by s),
g as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as new from w join m using (s) where first < doc_id),
r as (select doc_id, min(i) as a, max(i) + 50 as e from (select *, sum(case when new then 1 else 0 end) over (partition by doc_id order by i) as run from g) group by doc_id, run),
t as (select doc_id, sum(e - a) as n_removed, count(*) as n_spans from r group by doc_id),
k as (
  select doc_id, e as x, lead(a) over (partition by doc_id order by a) as y from r
  union all select doc_id, 1, min(a) from r group by doc_id
  union all select doc_id, 1, null from d where doc_id not in (select doc_id from r)),
o as (select k.doc_id, string_agg(hex(b[x:coalesce(y, n + 1) - 1]), '' order by x) as kept from k join d using (doc_id) where x < coalesce(y, n + 1) group by k.doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join t using (doc_id) left join o using (doc_id)
"""
