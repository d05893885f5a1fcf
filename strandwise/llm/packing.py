"""Best-fit packing by the sum-of-squares rule.

Documents are tokenized and closed with an end id; only those longer than a sequence are cut, into
full pieces and a rest.  Pieces go to groups of bounded size by a hash; in a group, in order of
decreasing length, each is put where the sum over gaps g of (open bins with gap g)**2 becomes
smallest, the least gap among equals.  Bins left with a gap of over an eighth are opened again and their
pieces packed across groups, as long as there is more than one group and the round before left at most half
of its pieces in such bins: groups are random samples of one distribution of lengths, so where most bins
stay open for want of short pieces, another round deals the same lengths again and fills no more.  Full
pieces are sequences of their own and never move.

Null text is the empty text: its one piece is the end id.  Rows that repeat an id, and identical rows, stay
separate pieces, and go to groups of their own draw.  Pieces of one length are placed in the order of id, piece
and digest.  Empty tables give empty results.  Other columns, whatever their names, are ignored.  A text of any
length is cut by one task, which holds its ids, 4 bytes each.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.workers import lean
from strandwise.llm.workspace import Workspace

LIMIT = 4096
END_ID = 1
GROUP_PIECES = 40_000
WORDS_HELD = 1_500_000
WORDS_KEPT = 700_000
NEARLY_FULL = 8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Number of each word; a new word gets the next number and is put on ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of whole texts, from the ids of their white-space separated words.

    The tokenizer drops white space before anything else that looks past it, so a text's ids are its
    words' ids in order; each distinct word is encoded once while the table of words (bounded) holds it.
    It lower-cases, and parts punctuation from letters, which is done here first where that is safe, so
    that fewer words are distinct.  Words of letters alone are one run each, whose last id closes a
    word, so many of them go through one call.
    """

    _POINT = re.compile(rb"(?<=[a-z0-9])([!-&(-/:-@\[-`{-~]+)(?=\s)")
    CLOSES = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith(self.CLOSES)]] = True
        self.reset()

    def reset(self) -> None:
        self.known = _Words()
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the new words, which have the last numbers."""
        words = [w.decode("utf-8", "replace") for w in self.known.new]
        n = len(self.known) - len(words)
        self.known.new.clear()
        while len(self.known) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        other = [k for k, w in enumerate(words) if not w.isalpha()]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(self._ids([" ".join([words[k] for k in part])])[0], "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                self._add(n + np.array(part), ids, np.diff(ends, prepend=0))
            else:
                other += part
        if other:
            got = self._ids([words[k] for k in other])
            self._add(n + np.array(other), np.array([x for ids in got for x in ids], "<u4"), np.array([len(ids) for ids in got], np.int64))

    def _add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)

    def _split(self, text: bytes) -> list[bytes]:
        # Lower case could make a special token of what is none.
        return text.split() if b"<|" in text else self._POINT.sub(rb" \1", text.lower()).split()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > WORDS_HELD:
            self.reset()
        places = []
        for t in texts:
            words = self._split(t)
            places.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if self.known.new:
            self._learn()
        out = []
        for at in places:
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[at] - ends + sizes, sizes)])
        return out


_ENCODERS: dict[str, WordEncoder] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder = _ENCODERS[path]
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                rows: list[tuple] = []
                texts = [t or b"" for t in b.column("text").to_pylist()]
                for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), limit)):
                        own = ids[s : s + limit]
                        rows.append((doc, k, s, len(own), zlib.crc32(own.tobytes())))
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        # The worker lives on, for this operator's next task or for others that need its memory.
        if len(encoder.known) > WORDS_KEPT:
            encoder.reset()

    return run


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lean(_pieces(vocabulary, limit, end_id)), PIECES)


def sum_of_squares(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are placed in order of decreasing length, and a bin is opened
    only when no open one has room, since that needs fewer bins than the rule's online form."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    counts = np.zeros(limit + 1, np.int64)
    made = 0
    fresh = np.int64(1 << 40)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # Growth of the sum of squares: 2 (N(h - s) - N(h) + 1), and 1 - 2 N(s) where the bin becomes full.
        cost = np.where(counts[size:] > 0, 2 * (counts[: limit + 1 - size] - counts[size:] + 1), fresh)
        if counts[size]:
            cost[0] = 1 - 2 * counts[size]
        k = int(cost.argmin())
        if cost[k] < fresh:
            gap = size + k
            b = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, made = limit, made, made + 1
        bins[i], offsets[i] = b, limit - gap
        if gap > size:
            open_by_gap[gap - size].append(b)
            counts[gap - size] += 1
    return bins, offsets


PACKED = PIECES + ", row long, sequence_id long, offset long, full boolean"
#: Numbers of sequences that a group has.
GROUP_BITS = 24
_COLUMNS = [*[x.split()[0] for x in PIECES.split(", ")], "row"]


def _pack_group(level: int, limit: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        lengths = rows.length.to_numpy()
        bins, offsets = sum_of_squares(lengths, limit)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        if len(fill) > 1 << GROUP_BITS:
            raise ValueError(f"a group of {len(rows)} pieces has no numbers left")
        base = (level << 58) + (int(rows["group"].iloc[0]) << GROUP_BITS)
        return rows[_COLUMNS].assign(doc_id=rows.doc_id.astype("Int64"), sequence_id=base + bins, offset=offsets, full=fill[bins] >= limit - limit // NEARLY_FULL)

    return run


def pack(spark: SparkSession, pieces: DataFrame, ws: Workspace, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    whole = pieces.filter(F.col("length") == limit)
    done = [whole.select(*_COLUMNS, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = pieces.filter(F.col("length") < limit), 1
    n = left.count()
    while n:
        groups = math.ceil(n / group_pieces)
        # The level salts the hash, so that a later round brings other pieces together.
        keyed = left.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        packed = ws.save(keyed.groupBy("group").applyInPandas(_pack_group(level, limit), PACKED), f"level{level}")
        over = packed.filter(~F.col("full")).count()
        last = groups == 1 or over > 0.5 * n
        done.append((packed if last else packed.filter("full")).drop("full"))
        if last:
            break
        left, n, level = packed.filter(~F.col("full")).select(*_COLUMNS), over, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("row")


def best_fit_packing(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    ws = Workspace(spark, "packing")
    pieces = ws.save(token_pieces(docs, vocabulary or default_vocabulary(), limit, end_id), "pieces")
    return pack(spark, pieces, ws, limit, group_pieces)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
