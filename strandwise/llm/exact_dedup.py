"""Exact dedup: a minimal perfect hash over the distinct digests of a historical table.

The history's distinct digests are dealt to buckets by digest; each bucket holds a
multi-level minimal perfect hash whose slots keep the full digest, the winner's locator and
the number of copies.  New rows are pre-aggregated by digest and looked up: a slot counts only
if its 32 bytes equal those asked for, so nonmembers are told apart and group among themselves.

Texts are equal when identical.  Null text counts as the empty text.  Of equal texts the row
with the largest id stays; null ids lose against all others.  Rows that repeat id and text are
one document's copies: the first is kept, all are counted.  Empty tables give empty results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.workspace import Workspace

KEYS_PER_BUCKET = 32_768
GAMMA = 2.0
_MIX = 0x9E3779B97F4A7C15


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8").reshape(-1, 4)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level's bit array has these keys; digests are random already."""
    h = words[:, level % 4] + np.uint64(_MIX * (level + 1) % 2**64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits per level, all bits, slot of each key) for distinct 32-byte digests, shape (n, 32)."""
    words = _words(np.ascontiguousarray(digests))
    left, slots = np.arange(len(words)), np.empty(len(words), np.int64)
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    spots: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    while len(left):
        size = max(1, math.ceil(GAMMA * len(left)))
        at = _spot(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        spots.append((left[won], base + at[won]))
        sizes.append(size)
        bits.append(alone)
        base += size
        left = left[~won]
    every = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(every) - 1
    for keys, at in spots:
        slots[keys] = rank[at]
    return sizes, every, slots


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot that the hash names for each digest, member or not; -1 where no level claims it."""
    words = _words(np.ascontiguousarray(digests))
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _spot(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


INDEX_SCHEMA = "bucket long, sizes array<long>, bits binary, digests binary, winners binary, copies binary"


def _build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows.digest)
    sizes, bits, slots = build_mph(digests)
    order = np.argsort(slots)
    winner = rows.winner.fillna(-1 << 63).astype("int64").to_numpy()
    return pd.DataFrame(
        [
            {
                "bucket": rows.bucket.iloc[0],
                "sizes": sizes,
                "bits": np.packbits(bits).tobytes(),
                "digests": digests[order].tobytes(),
                "winners": winner[order].tobytes(),
                "copies": rows.copies.to_numpy("int64")[order].tobytes(),
            }
        ]
    )


def _probe_bucket(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """One row per digest of either side: winner and copies over both."""
    none = np.int64(-1 << 63)
    new_d = _matrix(asked.digest) if len(asked) else np.zeros((0, 32), np.uint8)
    new_w = asked.winner.fillna(none).astype("int64").to_numpy()
    new_c = asked.copies.to_numpy("int64")
    if len(index):
        row = index.iloc[0]
        digests = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
        winners, copies = np.frombuffer(row.winners, "<i8").copy(), np.frombuffer(row.copies, "<i8").copy()
        sizes = [int(x) for x in row.sizes]
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8))[: sum(sizes)].astype(bool)
        slot = find_slots(new_d, sizes, bits)
        member = slot >= 0
        member[member] = (digests[slot[member]] == new_d[member]).all(axis=1)
        np.maximum.at(winners, slot[member], new_w[member])
        np.add.at(copies, slot[member], new_c[member])
        was = np.ones(len(winners), bool)
        new_d, new_w, new_c = new_d[~member], new_w[~member], new_c[~member]
    else:
        digests, winners, copies, was = np.zeros((0, 32), np.uint8), np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0, bool)
    d = np.concatenate([digests, new_d])
    w = np.concatenate([winners, new_w])
    return pd.DataFrame(
        {
            "digest": [x.tobytes() for x in d],
            "keep_id": pd.Series(w, dtype="Int64").mask(w == none),
            "group_size": np.concatenate([copies, new_c]),
            "historical": np.concatenate([was, np.zeros(len(new_d), bool)]),
        }
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n): n rows have this id and this text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))


def per_digest(keys: DataFrame) -> DataFrame:
    return keys.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("copies"))


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(buckets)))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """History given as (digest, winner, copies), each digest once: a row per bucket."""
    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(_build_bucket, INDEX_SCHEMA)


def probe(index: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Look (digest, winner, copies) up; returns digest, keep_id, group_size, historical over both sides."""
    return (
        index.groupBy("bucket")
        .cogroup(_bucketed(asked, buckets).groupBy("bucket"))
        .applyInPandas(_probe_bucket, "digest binary, keep_id long, group_size long, historical boolean")
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, history_upto: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, historical: one row per row of ``docs``.

    ``history_upto``: ids up to this one are the history that the hash is built over, the others
    are looked up; by default the middle of the ids seen.  The result doesn't depend on it.
    """
    ws = Workspace(spark, "exact")
    keys = ws.save(keyed(docs, id_col, text_col), "keys")
    if history_upto is None:
        history_upto = keys.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0] or 0
    old = F.coalesce(F.col("doc_id") <= F.lit(history_upto), F.lit(True))
    buckets = max(1, math.ceil(keys.count() / KEYS_PER_BUCKET))
    index = ws.save(build_index(per_digest(keys.filter(old)), buckets), "index")
    groups = probe(index, per_digest(keys.filter(~old)), buckets)
    won = keys.join(groups, "digest")
    first = (F.col("copy") == 0) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return won.select("*", F.posexplode(F.expr("array_repeat(0, cast(n as int))")).alias("copy", "zero")).select(
        "doc_id", "keep_id", "group_size", first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("historical")


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) window w as (partition by t)
"""
