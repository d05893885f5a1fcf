"""MinHash near-dedup by an LSH forest.

A document's set is its distinct 5-word shingles, or its whole word sequence if it has fewer words.
Equal sets form one class.  A class has ``TREES * LEVELS`` minimum hashes; each tree sorts the classes
by its own order of them, so that rows lie next to the rows with which they share the longest prefix.
A region of a tree is a run of classes with a common prefix of ``LEVELS`` hashes.  The depth adapts to the
region: one of up to ``TILE`` rows is compared whole, by two-bit sketches of all minimum hashes; in a longer
one, candidates are the rows that lie within half a tile, which share a longer prefix the more rows there are.

No region emits all its pairs.  A region joins the rows whose sketches may be links and emits a spanning
forest of them; a region of over ``TILE`` rows, and one that may be cut by the edge of a task's range, is joined
whole, so that neither loses a link.  The forests' connected components are families, outside of which nothing
is linked.  A family of up to ``FAMILY`` classes and ``FAMILY_BYTES`` of text is settled on the full sets by one
task, which walks an inverted index from class to class and drops what is reached, so its copies are never paired
with each other.  A larger family gives the same result in two rounds: first each class with its most similar
partner and its hub (the row of a tile with most similar rows) among its candidates, confirmed on the full sets;
then blocks of ``BLOCK`` classes or ``BLOCK_BYTES``, each pair of which is compared whole on the full sets.  Blocks
of one component aren't compared with each other; all else is quadratic in the family.

A pair at similarity 0.75 shares a region of some tree but for 2.4e-8 of the cases, and passes the
sketch but for about 1e-6.  There is no cap on partners.  A task holds the shingles of a few hundred texts or of
``SLICE_BYTES``, whichever is less, and at least of one text, about 45 bytes for each of its bytes.

Null or empty texts, and texts without words, have the empty set and are linked with nothing.  Rows
with one text share a class; rows that repeat the smallest id of a component are all kept.  A null id, and
2^63 - 1, counts as larger than all others.  Empty tables give empty results.  Other columns, whatever their names, are
ignored, or kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.llm import blocks
from strandwise.llm.blocks import NULL_ID, U64
from strandwise.llm.components import components
from strandwise.llm.workers import lean
from strandwise.llm.workspace import Workspace

SHINGLE = 5
TREES = 32
LEVELS = 3
HASHES = TREES * LEVELS
SKETCH_WORDS = HASHES // 32
TILE = 8192
#: Classes and bytes of text of a family that one task settles.
FAMILY = 8192
FAMILY_BYTES = 4 << 20
#: Rows and bytes of a family's block, pairs of which are compared whole.
BLOCK = 2048
BLOCK_BYTES = 2 << 20
HOT_ROWS = 32
HOT_COLUMNS = 1024
#: Sketches estimate 0.75 with a standard error of 0.053; pairs below this estimate aren't confirmed.
LEAST_ESTIMATE = 0.48
HUB_ESTIMATE = 0.7
SIMILAR, OF = 75, 100
#: Texts and bytes whose shingles are held at once.
SLICE = 256
SLICE_BYTES = 2 << 20
#: Pairs of rows that are compared at once; a pair takes about 100 bytes.
CELLS = 1 << 18

_rng = np.random.Generator(np.random.Philox(20))
MULTIPLIERS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by text and hash."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, word = blocks.words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    at, h = blocks.ngrams(doc, word, SHINGLE)
    d = doc[at]
    counts = np.bincount(doc, minlength=len(texts))
    parts_d, parts_h = [d], [h]
    for n in range(1, SHINGLE):
        # Texts of n words have one n-gram.
        short = np.flatnonzero(counts == n)
        if len(short):
            at, h = blocks.ngrams(doc, word, n)
            own = np.isin(doc[at], short)
            parts_d.append(doc[at][own])
            parts_h.append(h[own])
    d, h = np.concatenate(parts_d), np.concatenate(parts_h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def signatures(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts with shingles, sizes, class, minimum hashes (text, HASHES)) from shingle sets."""
    first = np.flatnonzero(np.diff(d, prepend=-1))
    sizes = np.diff(np.append(first, len(d)))
    out = np.empty((len(first), HASHES), np.uint32)
    if len(first):
        x = h ^ (h >> U64(29))
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((x * MULTIPLIERS[k]) >> U64(32)).astype(np.uint32), first)
        a = np.add.reduceat(h, first)
        b = np.bitwise_xor.reduceat(h * U64(0xC2B2AE3D27D4EB4F), first)
        cls = blocks.mix(a * U64(0x9FB21C651E98DF25) ^ b ^ sizes.astype(U64)).view(np.int64)
    else:
        cls = np.zeros(0, np.int64)
    return d[first], sizes, cls, out


def _slices(*texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of at most SLICE rows and SLICE_BYTES of ``texts``, but of one row at least."""
    start = size = 0
    for k, row in enumerate(zip(*texts, strict=True)):
        own = sum(map(len, row))
        if k > start and (k - start >= SLICE or size + own > SLICE_BYTES):
            yield start, k
            start, size = k, 0
        size += own
    if texts[0]:
        yield start, len(texts[0])


SIGNED = "doc_id long, text_key long, n_shingles long, n_bytes long, cls long, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        every = [t or b"" for t in big.column("text").to_pylist()]
        for at, to in _slices(every):
            b, texts = big.slice(at, to - at), every[at:to]
            which, sizes, cls, sig = signatures(*shingle_sets(texts))
            n, c, s = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for k, w in enumerate(which):
                n[w], c[w], s[w] = int(sizes[k]), int(cls[k]), sig[k].tobytes()
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), size, pa.array(c, pa.int64()), pa.array(s, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each minimum hash, in SKETCH_WORDS words of 64 bits."""
    two = (sig & np.uint32(3)).astype(U64).reshape(len(sig), SKETCH_WORDS, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=U64) * U64(2)), axis=2)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from sketches, over the last axis."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> U64(1))) & U64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    return 1 - differ / HASHES * (4 / 3)


BRANCHES = "key long, rest long, cls long, label long, sketch binary"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class a row per tree: region, the hashes that come next, and the sketch."""
    # Deeper levels of a tree are the next trees' hashes.
    orders = (np.arange(LEVELS + 2)[None, :] + np.arange(0, HASHES, LEVELS)[:, None]) % HASHES
    salt = np.arange(TREES, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for big in batches:
        for at in range(0, big.num_rows, 4096):
            b = big.slice(at, 4096)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
            sketch = sketches(sig).tobytes()
            width = 8 * SKETCH_WORDS
            h = sig[:, orders].astype(U64)
            key = np.broadcast_to(salt, h.shape[:2]).copy()
            for k in range(LEVELS):
                key = blocks.mix(key * U64(0xA0761D6478BD642F) + h[:, :, k])
            rest = (h[:, :, LEVELS] << U64(31)) | (h[:, :, LEVELS + 1] >> U64(1))
            own = [sketch[k * width : (k + 1) * width] for k in range(len(sig))]
            for t in range(TREES):
                yield pa.record_batch([pa.array(key[:, t].view(np.int64)), pa.array(rest[:, t].view(np.int64)), b.column("cls"), b.column("label"), pa.array(own, pa.binary())], names=[x.split()[0] for x in BRANCHES.split(", ")])


PAIRS = "a long, b long, estimate double, degree long"


def _tile_best(sketch: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(row, row, estimate, degree): each row's best partner and its hub, of other components."""
    m = len(sketch)
    degree, best, value = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
    step = max(1, CELLS // m)
    for s in range(0, m, step):
        e = estimates(sketch[s : s + step, None], sketch[None])
        e[label[s : s + step, None] == label[None]] = -1
        degree[s : s + step] = (e >= HUB_ESTIMATE).sum(axis=1)
        best[s : s + step], value[s : s + step] = e.argmax(axis=1), e.max(axis=1)
    rows = np.arange(m)
    hub = int(degree.argmax())
    to_hub = estimates(sketch, sketch[hub])
    fit, near = value >= LEAST_ESTIMATE, (to_hub >= LEAST_ESTIMATE) & (label != label[hub])
    return [rows[fit], rows[near]], [best[fit], np.full(int(near.sum()), hub)], [value[fit], to_hub[near]], [np.zeros(int(fit.sum()), np.int64), np.full(int(near.sum()), degree[hub])]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n rows' components over the edges (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return root


def _tile_forest(sketch: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the pairs that may be links: each row with the first of its component."""
    m = len(sketch)
    root = np.arange(m)
    step = max(1, CELLS // m)
    for s in range(0, m, step):
        i, j = np.nonzero(estimates(sketch[s : s + step, None], sketch[None]) >= LEAST_ESTIMATE)
        root = root[local_components(m, root[i + s], root[j])][root]
        root = root[root]
    rows = np.flatnonzero(root != np.arange(m))
    return [rows], [root[rows]], [np.zeros(len(rows))], [np.zeros(len(rows), np.int64)]


def _pairs(compare, cls: np.ndarray, label: np.ndarray, sketch: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
    """PAIRS of the rows in each of the regions at ``starts`` to ``ends``."""
    a, b, v, g = [], [], [], []
    size = ends - starts
    two = starts[size == 2]
    if len(two):
        e = estimates(sketch[two], sketch[two + 1])
        fit = (e >= LEAST_ESTIMATE) & (label[two] != label[two + 1])
        a.append(two[fit])
        b.append(two[fit] + 1)
        v.append(e[fit])
        g.append(np.zeros(int(fit.sum()), np.int64))
    for s, t in zip(starts[size > 2], ends[size > 2], strict=True):
        own = label[s:t]
        if (own == own[0]).all():
            continue
        for into, part in zip((a, b, v, g), compare(sketch[s:t], own), strict=True):
            into += [x + s for x in part] if into is a or into is b else part
    if not a or not sum(map(len, a)):
        return None
    return _records(cls[np.concatenate(a)], cls[np.concatenate(b)], np.concatenate(v), np.concatenate(g))


def _records(a: np.ndarray, b: np.ndarray, estimate: np.ndarray, degree: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(estimate), pa.array(degree)], names=["a", "b", "estimate", "degree"])


def _branches(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [*[batch.column(c).to_numpy() for c in ("key", "cls", "label")], np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)]


def _neighbours(tile: int):
    """Of sorted branches, each row's best partner and its hub within half a tile of its region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = _branches(batch)
            key, *rest = (np.concatenate([h, n]) for h, n in zip(held, now, strict=True)) if held else now
            if not len(key):
                continue
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            starts, ends = edges[:-1], edges[1:]
            if len(starts) > 1 and (got := _pairs(_tile_best, *rest, starts[:-1], ends[:-1])):
                yield got
            open_at = int(starts[-1])
            # An open region that is longer than a tile goes tile by tile, each with half of the one before.
            while len(key) - open_at > tile:
                if got := _pairs(_tile_best, *rest, np.array([open_at]), np.array([open_at + tile])):
                    yield got
                open_at += tile // 2
            held = (key[open_at:], *[x[open_at:] for x in rest])
        if held and len(held[0]) > 1 and (got := _pairs(_tile_best, *held[1:], np.array([0]), np.array([len(held[0])]))):
            yield got

    return run


#: The degree of a record that names a region, in ``a``, and a row that all of its rows of one task are joined with.
JOINED = -1


def _forest(tile: int):
    """Of sorted branches, spanning forests of the rows of each region that may be links.  A region of over ``tile``
    rows, and the first and the last of a task, which other tasks may go on with, are joined whole and named."""

    def joined(key: int, head: int, cls: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(cls) + 1)
        return _records(np.append(cls, key), np.full(len(cls) + 1, head), zero, np.append(np.zeros(len(cls), np.int64), JOINED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        head, whole = None, True
        for batch in batches:
            now = _branches(batch)
            key, cls, label, sketch = (np.concatenate([h, n]) for h, n in zip(held, now, strict=True)) if held else now
            if not len(key):
                continue
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            starts, ends = edges[:-1], edges[1:]
            head = int(cls[0]) if head is None else head
            if len(starts) > 1:
                if whole:
                    yield joined(int(key[0]), head, cls[: ends[0]])
                closed = slice(1 if whole else 0, -1)
                if got := _pairs(_tile_forest, cls, label, sketch, starts[closed], ends[closed]):
                    yield got
                head, whole = int(cls[starts[-1]]), False
            at = int(starts[-1])
            whole = whole or len(key) - at > tile
            if whole:
                yield joined(int(key[-1]), head, cls[at:])
                # The key is needed to know where the region ends.
                at = len(key) - 1
            held = (key[at:], cls[at:], label[at:], sketch[at:])
        if held:
            yield joined(int(held[0][-1]), head, held[1])

    return run


def _dealt(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("cls", "label", "sig").mapInArrow(lean(_grow), BRANCHES)
    # By range, so that a region that is most of a tree still spreads over tasks.
    return rows.repartitionByRange("key", "rest").sortWithinPartitions("key", "rest", "cls")


def forests(ws: Workspace, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are the families of ``nodes`` (cls, label, sig)."""
    got = ws.save(_dealt(nodes).mapInArrow(lean(_forest(tile)), PAIRS), "forest")
    edges = got.filter(F.col("degree") != JOINED).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # A region that several tasks have is one.
    named = got.filter(F.col("degree") == JOINED).select(F.col("a").alias("key"), F.col("b").alias("v")).distinct()
    first = named.groupBy("key").agg(F.min("v").alias("u"))
    return edges.unionByName(named.join(first, "key").select("u", "v")).filter("u <> v")


def neighbours(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a, b, estimate, degree) of ``nodes`` (cls, label, sig) of different labels: each row's best
    partner and its hub among those with the longest common prefixes."""
    best = _dealt(nodes).mapInArrow(lean(_neighbours(tile)), PAIRS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "estimate", "degree")
    return best.groupBy("a", "b").agg(F.max("estimate").alias("estimate"), F.max("degree").alias("degree"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        left, right = ([t or b"" for t in big.column(c).to_pylist()] for c in ("text_a", "text_b"))
        for at, to in _slices(left, right):
            n = to - at
            d, h = shingle_sets(left[at:to] + right[at:to])
            edges = np.searchsorted(d, np.arange(2 * n + 1))
            links = np.zeros(n, bool)
            for k in range(n):
                x, y = h[edges[k] : edges[k + 1]], h[edges[n + k] : edges[n + k + 1]]
                both = len(x) + len(y)
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                links[k] = OF * common >= SIMILAR * (both - common)
            p = big.slice(at, n)
            yield pa.record_batch([p.column("a"), p.column("b"), pa.array(links)], names=["a", "b", "link"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, link): which ``pairs`` are links by the full sets of ``texts`` (cls, text)."""
    first = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(_confirm), "a long, b long, link boolean")


def chosen(pairs: DataFrame) -> DataFrame:
    """Of candidate pairs, for each class the one of highest estimate and the one of the largest hub."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "a", "b", "estimate", "degree"), F.struct(F.col("b").alias("node"), "a", "b", "estimate", "degree"))))
    best = ends.groupBy("node").agg(F.max(F.struct("estimate", "a", "b")).alias("x"), F.max(F.struct("degree", "estimate", "a", "b")).alias("y"))
    return best.select(F.inline(F.array(F.struct("x.a", "x.b"), F.struct("y.a", "y.b")))).distinct()


def family_links(sets: list[np.ndarray]) -> np.ndarray:
    """Component (its smallest member) of each of a family's sets of hashes, by exact similarity."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    begin = np.cumsum(sizes) - sizes
    root, free, n_free = np.full(m, -1), np.ones(m, bool), m
    for start in range(m):
        if root[start] >= 0:
            continue
        root[start], free[start], n_free = start, False, n_free - 1
        queue = [start]
        while queue and n_free:
            x = queue.pop()
            own = token[begin[x] : begin[x] + sizes[x]]
            lo, n = first[own], first[own + 1] - first[own]
            at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            near = posting[at]
            common = np.bincount(near[free[near]], minlength=m)
            found = np.flatnonzero((OF * common >= SIMILAR * (sizes[x] + sizes - common)) & free)
            root[found], free[found] = start, False
            n_free -= len(found)
            queue += found.tolist()
        # Postings of classes that are reached are dead weight.
        if n_free * 2 < len(free) - start and n_free:
            alive = free[posting]
            first = np.concatenate([[0], np.cumsum(alive)])[first]
            posting = posting[alive]
    return root


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each class with the first of its component, from rows (family, cls, text) sorted by family."""

    def settled(family: list[int], cls: list[int], texts: list[bytes]) -> pa.RecordBatch:
        d, h = shingle_sets(texts)
        edges = np.searchsorted(d, np.arange(len(texts) + 1))
        sets = [h[edges[k] : edges[k + 1]] for k in range(len(texts))]
        cuts = np.flatnonzero(np.diff(np.array(family), prepend=family[0] ^ 1))
        u, v = [], []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(family)], strict=True):
            for k, r in enumerate(family_links(sets[a:b]).tolist()):
                if r != k:
                    u.append(cls[a + k])
                    v.append(cls[a + r])
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    family: list[int] = []
    cls: list[int] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for f, c, t in zip(b.column("family").to_pylist(), b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True):
            size += len(t or b"")
            if texts and f != family[-1] and (len(texts) >= SLICE or size > SLICE_BYTES):
                yield settled(family, cls, texts)
                family, cls, texts, size = [], [], [], len(t or b"")
            family.append(f)
            cls.append(c)
            texts.append(t or b"")
    if texts:
        yield settled(family, cls, texts)


def block_links(left: list[np.ndarray], right: list[np.ndarray], left_label: np.ndarray, right_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of a spanning forest of the exact links between two blocks of sets whose labels differ.

    Rows count left first, then right.  Shingles that many rows share are counted by products of
    matrices of ``HOT_COLUMNS`` of them, all others by their postings.
    """
    m, n = len(left), len(right)
    size_l, size_r = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    _, token = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    a, b = token[: size_l.sum()], token[size_l.sum() :]
    row_a, row_b = np.repeat(np.arange(m), size_l), np.repeat(np.arange(n), size_r)
    count_a, count_b = (np.bincount(x, minlength=token.max() + 1) for x in (a, b))
    hot = (count_a >= HOT_ROWS) & (count_b >= HOT_ROWS)
    rare = (count_a > 0) & (count_b > 0) & ~hot
    common = np.zeros((m, n), np.float32)
    column = np.cumsum(hot) - 1
    for c in range(0, int(hot.sum()), HOT_COLUMNS):
        x, y = (np.zeros((k, HOT_COLUMNS), np.float32) for k in (m, n))
        for into, t, row in ((x, a, row_a), (y, b, row_b)):
            own = hot[t] & (column[t] >= c) & (column[t] < c + HOT_COLUMNS)
            into[row[own], column[t[own]] - c] = 1
        common += x @ y.T
    # Postings of the right rows by shingle; each rare shingle of a left row meets all of its postings.
    own = rare[b]
    order = np.argsort(b[own], kind="stable")
    posting = row_b[own][order]
    first = np.concatenate([[0], np.cumsum(np.bincount(b[own], minlength=len(hot)))])
    a, row_a = a[rare[a]], row_a[rare[a]]
    begin = np.concatenate([[0], np.cumsum(np.bincount(row_a, minlength=m))])
    step = max(1, CELLS // n)
    root = np.arange(m + n)
    for s in range(0, m, step):
        e = min(m, s + step)
        t, r = a[begin[s] : begin[e]], row_a[begin[s] : begin[e]] - s
        lo, k = first[t], first[t + 1] - first[t]
        at = np.arange(int(k.sum())) + np.repeat(lo - np.cumsum(k) + k, k)
        both = common[s:e].astype(np.int64) + np.bincount(np.repeat(r, k) * n + posting[at], minlength=(e - s) * n).reshape(e - s, n)
        i, j = np.nonzero((OF * both >= SIMILAR * (size_l[s:e, None] + size_r[None] - both)) & (left_label[s:e, None] != right_label[None]))
        root = root[local_components(m + n, root[i + s], root[j + m])][root]
        root = root[root]
    rows = np.flatnonzero(root != np.arange(m + n))
    return rows, root[rows]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): spanning forests of the links of rows (family, low, high, block, cls, label, text) sorted by pair of blocks."""

    def crossed(held: list[tuple]) -> pa.RecordBatch | None:
        low, high = held[0][1], held[0][2]
        d, h = shingle_sets([r[6] or b"" for r in held])
        edges = np.searchsorted(d, np.arange(len(held) + 1))
        block, cls, label = (np.array([r[k] for r in held], np.int64) for k in (3, 4, 5))
        x = np.flatnonzero(block == low)
        y = np.flatnonzero(block == high)
        if not len(x) or not len(y) or (label == label[0]).all():
            return None
        sets = lambda rows: [h[edges[k] : edges[k + 1]] for k in rows]
        u, v = block_links(sets(x), sets(y), label[x], label[y])
        own = np.concatenate([cls[x], cls[y]])
        u, v = own[u], own[v]
        return pa.record_batch([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    held: list[tuple] = []
    for b in batches:
        for r in zip(*[b.column(c).to_pylist() for c in ("family", "low", "high", "block", "cls", "label", "text")], strict=True):
            if held and r[:3] != held[0][:3]:
                if got := crossed(held):
                    yield got
                held = []
            held.append(r)
    if held and (got := crossed(held)):
        yield got


def cross_links(labelled: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(u, v) that join all links of ``labelled`` (family, cls, label, text) between rows of a family that differ in label.

    A family is dealt into blocks of about ``block`` rows and ``block_bytes``, and each pair of blocks is compared whole on
    the full sets.  Labels of more have blocks of their own, which aren't compared with each other.
    """
    # How much of a block a label fills.
    fill = F.greatest(F.count("*") / F.lit(block), F.sum(F.octet_length("text")) / F.lit(block_bytes))
    sizes = labelled.groupBy("family", "label").agg(fill.alias("n"))
    pooled = sizes.withColumn("pool", F.when(F.col("n") > 1, F.col("label")))
    pools = pooled.groupBy("family", "pool").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).withColumn("blocks", F.ceil("n"))
    by_pool = Window.partitionBy("family").orderBy(F.col("pool").asc_nulls_first())
    placed = pools.withColumn("first", F.sum("blocks").over(by_pool) - F.col("blocks")).withColumn("total", F.sum("blocks").over(Window.partitionBy("family")))
    # Families of one label have all their links.
    placed = placed.withColumn("whole", F.sum("labels").over(Window.partitionBy("family"))).filter("whole > 1")
    places = pooled.select("family", "label", "pool").join(placed.select("family", F.col("pool").alias("p"), "blocks", "first", "total").withColumnRenamed("family", "f"), (F.col("family") == F.col("f")) & F.col("pool").eqNullSafe(F.col("p")))
    rows = labelled.join(places.select("family", "label", "pool", "blocks", "first", "total"), ["family", "label"])
    rows = rows.withColumn("block", F.col("first") + F.pmod(F.xxhash64("cls"), F.col("blocks")))
    # The other blocks, without those of the same label.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda o: F.col("pool").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")))
    pairs = rows.select("family", "block", "cls", "label", "text", F.explode(others).alias("other"))
    pairs = pairs.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "label", "text")
    return pairs.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high").mapInArrow(lean(_cross), "u long, v long")


def _pair_links(ws: Workspace, nodes: DataFrame, texts: DataFrame, tile: int, block: int) -> DataFrame:
    """(u, v) links of classes in families too large for a task."""
    ends = lambda rows: rows.filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = ws.save(neighbours(nodes.withColumn("label", F.col("cls")), tile), "pairs1")
    tried = ws.save(confirm(chosen(pairs), texts), "tried1")
    roots = components(ws, ends(tried), "first")
    labelled = texts.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("family", "cls", F.coalesce("root", "cls").alias("label"), "text")
    more = ws.save(cross_links(ws.save(labelled, "labelled"), block), "crossed")
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)


def near_components(spark: SparkSession, docs: DataFrame, tile: int = TILE, family: int = FAMILY, block: int = BLOCK, family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text)."""
    ws = Workspace(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = ws.save(rows.mapInArrow(lean(_sign), SIGNED), "signed")
    order = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(order.alias("least"), "text_key", "n_bytes", "sig")).alias("r"))
    nodes = ws.save(classes.select("cls", "r.least", "r.text_key", "r.n_bytes", "r.sig"), "nodes")

    forest = forests(ws, nodes.withColumn("label", F.col("cls")), tile)
    ws.release()
    roots = components(ws, forest, "families")
    members = ws.save(roots.select(F.col("node").alias("cls"), F.col("root").alias("family")).unionByName(roots.select(F.col("root").alias("cls"), F.col("root").alias("family")).distinct()), "members")
    some = ws.save(nodes.join(members, "cls"), "some")
    ids = some.select("cls", "family", F.col("least").alias("__least"), F.col("text_key").alias("__key"))
    texts = rows.withColumn("__order", order).join(ids.hint("merge"), (F.col("__order") == F.col("__least")) & (F.col("text_key") == F.col("__key"))).select("family", "cls", "text")
    texts = ws.save(texts.dropDuplicates(["cls"]), "texts")
    ws.release()
    of_family = some.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    large = ws.save(of_family.filter((F.col("n") > family) | (F.col("n_bytes") > family_bytes)).select("family"), "large")
    small = texts.join(large, "family", "left_anti").repartition("family").sortWithinPartitions("family", "cls")
    links = ws.save(small.mapInArrow(lean(_settle), "u long, v long"), "links")
    if not large.isEmpty():
        own = some.join(large, "family", "left_semi")
        links = links.unionByName(_pair_links(ws, own, texts.join(large, "family", "left_semi"), tile, block))
    roots = components(ws, links, "settled")

    own = nodes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = own.groupBy("root").agg(F.min("least").alias("component"))
    of_class = ws.save(own.join(smallest, "root").select("cls", "component"), "of_class")
    joined = signed.select("doc_id", "text_key", "n_shingles", "cls").join(of_class, "cls", "left")
    found = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("component"), F.lit(NULL_ID)))
    result = ws.save(joined.select("doc_id", "text_key", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept")), "result")
    ws.close("result")
    return result


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that their components keep."""
    found = near_components(spark, docs.select("doc_id", "text")).filter("kept")
    kept = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(kept.hint("merge"), same, "left_semi")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_key")


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as node, doc_id as c from documents union select b, c from reach join both_ways on a = node)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id, c = doc_id as kept
from documents left join n using (doc_id) join (select node, min(c) as c from reach group by node) on node = doc_id
"""
