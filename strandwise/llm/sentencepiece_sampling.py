"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text is escaped as SentencePiece does (a mark in front and for each space); its lattice has an edge
for each piece of the vocabulary that matches, and one of byte pieces for a character that is no
piece.  Pieces weigh ``1 / (rank + OFFSET)`` of their rank in the vocabulary, so a segmentation's
probability is its product of weights over the lattice's total.

Sampling is Gumbel top-k by a perturbed A* search, written with arrival times ``t = exp(-Gumbel)``:
a set of segmentations of probability p first arrives after Exp(1)/p.  The search pops the set that
arrives first.  Such a set is a path up to a lattice node with the edges already taken there barred;
popping draws another edge and goes on to the end by the lattice's backward sums, and leaves one set
for each node passed, which arrives later by an exponential of its probability.  So the first k
pops are k distinct segmentations, sampled without replacement; the arrival t of the next set gives
each its inclusion score ``1 - exp(-p t)``.  All draws are hashes of the row's key, so neither
batches nor retries change a result.

Lattices of bounded blocks of text are built at once in numpy: the text is cut wherever no piece has
the two characters beside the cut, and each distinct part is built once.

Null and empty texts have one segmentation, without pieces, of probability and score 1.  A text with
fewer than k segmentations gives those it has.  The mark U+2581 in a text is decoded as a space, as
SentencePiece does.  Rows that repeat a key and text get equal samples; a null key counts as -1.  Of sets that arrive at one time the
first along the path counts.  Empty tables give empty results.  Other columns, whatever their names, are ignored.  A
task holds one text of any length, with about 400 bytes for each of its characters that no other part repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.blocks import U64, mix
from strandwise.llm.workers import lean

SAMPLES = 2
OFFSET = 10.0
BLOCK_CHARS = 1 << 21
MARK = "▁"
_UNUSED = -1e8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    size = 1
    while size < len(out):
        m = min(size, len(out) - size)
        out[size : size + m] = out[:m] * U64(pow(base, size, 1 << 64))
        size *= 2
    return out


_PIECE, _LONGER = 1, 2


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h.copy()) >> U64(44)).astype(np.int64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers; blocks of usual size share them."""
    if n > 2 * BLOCK_CHARS:
        return _power_table(base, n)
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _power_table(base, n)
    return _POWERS[base][:n]


class Vocabulary:
    """Pieces of a SentencePiece model: hashes for matching, weights, ids and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        texts: dict[str, int] = {}
        self.bytes = [b""] * n
        rank = np.full(n, float(n))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (len(piece) == 1 or sp.get_score(i) > _UNUSED):
                texts[piece] = i
                rank[i] = -sp.get_score(i) if sp.get_score(i) > _UNUSED else i
                self.bytes[i] = piece.encode()
        weight = 1 / (rank + OFFSET)
        known = np.array([*texts.values(), *self.byte_ids[self.byte_ids >= 0]])
        self.logp = np.log(weight / weight[known].sum())
        codes = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(U64) for t in texts]
        self.longest = max(map(len, codes))
        powers = _power_table(_BASE, self.longest)
        h = np.array([((c + U64(1)) * powers[: len(c)]).sum(dtype=U64) for c in codes], U64) * np.array([2 * len(c) + 1 for c in codes], U64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(list(texts.values()))[order]
        # By 20 bits of the hash: whether it may be a piece's (1), and that of a piece's beginning (2).
        longer = [((c[:-1] + U64(1)) * powers[: len(c) - 1]).cumsum(dtype=U64) * (U64(2) * np.arange(1, len(c), dtype=U64) + U64(1)) for c in codes if len(c) > 1]
        self.maybe = np.zeros(1 << 20, np.uint8)
        self.maybe[_slot(np.concatenate([h[:0], *longer]))] = _LONGER
        slots = _slot(self.hashes)
        self.maybe[slots] |= _PIECE
        # Where the slot's only piece is, or -1: it has several.
        self.spot = np.full(1 << 20, -1, np.int32)
        self.spot[slots] = np.where(np.bincount(slots, minlength=1 << 20)[slots] == 1, np.arange(len(h)), -1)
        inner = np.array([(int(a) << 21) | int(b) for c in codes for a, b in zip(c[:-1], c[1:], strict=True)], U64)
        self.joined = np.zeros(1 << 20, bool)
        self.joined[(mix(inner) >> U64(44)).astype(np.int64)] = True

    def match(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, ids) of the hashes that are pieces', and the places of those that longer pieces may begin with."""
        slots = _slot(h)
        kind = self.maybe[slots]
        at = np.flatnonzero(kind & _PIECE)
        own = h[at]
        spot = self.spot[slots[at]]
        several = np.flatnonzero(spot < 0)
        spot[several] = np.minimum(np.searchsorted(self.hashes, own[several]), len(self.hashes) - 1)
        hit = self.hashes[spot] == own
        return at[hit], self.ids[spot[hit]], np.flatnonzero(kind & _LONGER)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(text: str | None, path: str) -> list[int]:
    """Ids of the model's own, deterministic segmentation."""
    return vocabulary(path).processor.encode(text or "")


def decode(ids: list[int], path: str) -> str:
    v = vocabulary(path)
    text = b"".join(v.bytes[i] for i in ids).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _keyed(key: np.ndarray, *parts) -> np.ndarray:
    """Hashes of keys and counters."""
    h = key.astype(U64)
    for p in parts:
        h = h * U64(0xA0761D6478BD642F)
        h += np.asarray(p).astype(U64)
        h += U64(0x632BE59BD9B4E019)
        mix(h)
    return h


def _drawn(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 1) * 2.0**-53


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Draws in (0, 1] for keys and counters."""
    return _drawn(_keyed(key, *parts))


class Lattice:
    """Lattice of a block of texts: distinct parts, and where each text has which."""

    def __init__(self, texts: list[str], v: Vocabulary):
        self.v = v
        escaped = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        sizes = np.array([len(t) for t in escaped], np.int64)
        codes = np.frombuffer("".join(escaped).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        n = len(codes)
        ends = np.cumsum(sizes)
        cut = np.ones(n + 1, bool)
        if n > 1:
            cut[1:n] = ~v.joined[(mix((codes[:-1] << U64(21)) | codes[1:]) >> U64(44)).astype(np.int64)]
        cut[ends] = True
        cut[0] = True
        starts = np.flatnonzero(cut[:n])
        lengths = np.diff(np.append(starts, n))
        sums = np.zeros(n + 1, U64)
        np.cumsum((codes + U64(1)) * _powers(_BASE, n), out=sums[1:])
        inverse = _powers(_INVERSE, n + 1)
        h = mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        # Distinct parts by first place, so that common ones lie near each other.
        self.part = pa.array(h).dictionary_encode().indices.to_numpy().astype(np.int64)
        first = np.zeros(int(self.part.max(initial=-1)) + 1, np.int64)
        first[self.part[::-1]] = np.arange(len(h))[::-1]
        self.bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        # The distinct parts' characters, one part after the other, each with a node more than characters.
        own = lengths[first]
        begin = np.cumsum(own + 1) - own - 1
        nodes = int((own + 1).sum())
        self.begin = begin
        node = np.arange(int(own.sum())) + np.repeat(np.arange(len(own)), own)
        self.codes = codes[np.repeat(starts[first] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        to_end = np.repeat(own + (np.cumsum(own) - own), own) - np.arange(int(own.sum()))
        src, dst, ids = self._edges(node, to_end)
        self._backward(src, dst, ids, nodes, node, to_end)

    def _edges(self, node: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, c = self.v, self.codes
        sums = np.zeros(len(c) + 1, U64)
        np.cumsum((c + U64(1)) * _powers(_BASE, len(c)), out=sums[1:])
        inverse = _powers(_INVERSE, len(c) + 1)
        src, dst, ids = [], [], []
        single = np.zeros(len(c), bool)
        at = np.arange(len(c))
        for size in range(1, v.longest + 1):
            at = at[to_end[at] >= size]
            if not len(at):
                break
            where, found, longer = v.match((sums[at + size] - sums[at]) * inverse[at] * U64(2 * size + 1))
            src.append(node[at[where]])
            dst.append(src[-1] + size)
            ids.append(found)
            if size == 1:
                single[at[where]] = True
            at = at[longer]
        odd = np.flatnonzero(~single)
        # A character that is no piece: an edge of its bytes, named by -1 - code.
        src.append(node[odd])
        dst.append(node[odd] + 1)
        ids.append(-1 - c[odd].astype(np.int64))
        return np.concatenate(src), np.concatenate(dst), np.concatenate(ids)

    def _bytes_of(self, code: int) -> np.ndarray:
        return self.v.byte_ids[list(chr(code).encode("utf-8", "surrogatepass"))]

    def _backward(self, src: np.ndarray, dst: np.ndarray, ids: np.ndarray, nodes: int, node: np.ndarray, to_end: np.ndarray) -> None:
        """Edges by node, likeliest first, each with the chance that a path through the node takes it."""
        # Ids of an edge: one piece, or the bytes of a character, which lie after the vocabulary.
        odd = np.flatnonzero(ids < 0)
        codes, which = np.unique(-1 - ids[odd], return_inverse=True)
        own = [self._bytes_of(int(c)) for c in codes]
        sizes = np.array([len(x) for x in own], np.int64)
        self.flat = np.concatenate([np.arange(len(self.v.logp)), *own])
        start, count = ids.copy(), np.ones(len(ids), np.int64)
        start[odd] = len(self.v.logp) + (np.cumsum(sizes) - sizes)[which]
        count[odd] = sizes[which]
        logp = self.v.logp[np.maximum(ids, 0)]
        logp[odd] = np.array([self.v.logp[x].sum() for x in own])[which] if len(own) else 0.0
        left = np.zeros(nodes, np.int64)
        left[node] = to_end
        # Levels in as few bits as they need, which numpy sorts by radix if they are 16.
        level = left[src]
        by_src = np.argsort(src, kind="stable")
        order = by_src[np.argsort(level[by_src].astype(np.uint16) if level.max() < 1 << 16 else level[by_src], kind="stable")]
        s, d, p = src[order], dst[order], logp[order]
        beta = np.zeros(nodes)
        ends = np.cumsum(np.bincount(level))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            if a == b:
                continue
            own, x = s[a:b], p[a:b] + beta[d[a:b]]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            top = np.maximum.reduceat(x, first)
            x -= np.repeat(top, np.diff(np.append(first, b - a)))
            beta[own[first]] = top + np.log(np.add.reduceat(np.exp(x, out=x), first))
        chance = logp + beta[dst] - beta[src]
        share = np.exp(chance)
        # Almost sorted by node already, which a stable sort is quick at.
        order = by_src[np.argsort((src + (1 - share) * 0.999)[by_src], kind="stable")]
        self.dst, self.start, self.count, self.log_chance = dst[order], start[order], count[order], np.minimum(chance[order], 0.0)
        src = src[order]
        degree = np.bincount(src, minlength=nodes)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        self.only = degree[src] == 1
        self.goes = (degree > 0)[self.dst]
        upto = np.cumsum(share[order])
        base = np.concatenate([[0.0], upto])[self.first[:-1]]
        self.upto = (upto - base[src]).astype(np.float64)

    def ids_of(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the edges one after the other, where each edge's begin and the last's end)."""
        count = self.count[edges]
        if count.max(initial=1) == 1:
            return self.flat[self.start[edges]], np.arange(len(edges) + 1)
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.flat[np.arange(int(upto[-1])) + np.repeat(self.start[edges] - upto[:-1], count)], upto

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node."""
        edge = self.first[node]
        last = self.first[node + 1] - 1
        live = np.flatnonzero((u > self.upto[edge]) & (edge < last))
        while len(live):
            edge[live] += 1
            live = live[(u[live] > self.upto[edge[live]]) & (edge[live] < last[live])]
        return edge

    def finish(self, text: np.ndarray, unit: np.ndarray, node: np.ndarray, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths to the end of each part from ``node``: (row given, step, edge), sorted."""
        rows, edges = [], []
        row, now = np.arange(len(node)), node
        begin = self.begin[self.part[self.bounds[text] + unit]]
        seed = _keyed(key[text], salt, unit)
        length = np.zeros(len(node), np.int64)
        while len(row):
            e = self.draw(now, _drawn(_keyed(seed[row], now - begin[row])))
            rows.append(row)
            edges.append(e)
            length[row] += 1
            more = np.flatnonzero(self.goes[e])
            row, now = row[more], self.dst[e[more]]
        upto = np.cumsum(length) - length
        step, edge = np.repeat(np.arange(len(node)), length), np.zeros(int(length.sum()), np.int64)
        for k, (r, e) in enumerate(zip(rows, edges, strict=True)):
            edge[upto[r] + k] = e
        return step, np.arange(len(edge)) - upto[step], edge


class _Path:
    """One segmentation of each of some texts: edges in order, and when the sets they leave arrive."""

    def __init__(self, text: np.ndarray, unit: np.ndarray, edge: np.ndarray, n: int):
        self.unit, self.edge = unit, edge
        self.bounds = np.searchsorted(text, np.arange(n + 1))


def sample(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct segmentations, as (ids, log probability, log inclusion score)."""
    out: list[list[tuple[np.ndarray, float, float]]] = [[(np.zeros(0, np.int64), 0.0, 0.0)] if not t else [] for t in texts]
    whole = [i for i, t in enumerate(texts) if t]
    if not whole:
        return out
    lat = Lattice([texts[i] for i in whole], v)
    n, seed = len(whole), mix(keys[whole].astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + U64(7))
    paths: list[_Path] = []
    arrivals: list[np.ndarray] = []
    barred: dict[tuple[int, int, int], list[int]] = {}
    clock = -np.log(_uniform(seed, 1))
    # The first path: every part from its first node.
    text = lat.text
    unit = np.arange(len(text)) - lat.bounds[text]
    r, _, e = lat.finish(text, unit, lat.begin[lat.part], seed, 0)
    first = _Path(text[r], unit[r], e, n)

    def clocks(path: _Path, text: np.ndarray, since: np.ndarray, salt: int) -> np.ndarray:
        """When the sets arrive that the path leaves at each step from ``since`` on; never before that."""
        log = lat.log_chance[path.edge]
        total = np.concatenate([[0.0], np.cumsum(log)])
        place = np.arange(len(text)) - path.bounds[text]
        at = np.flatnonzero(place >= since[text])
        own, log = text[at], log[at]
        prefix = total[at] - total[path.bounds[:-1]][own]
        with np.errstate(divide="ignore", over="ignore"):
            rate = np.exp(prefix) * -np.expm1(log)
            wait = -np.log(_drawn(_keyed(_keyed(seed, 2 + salt)[own], place[at]))) / np.where(lat.only[path.edge[at]], 0.0, rate)
        t = np.full(len(text), np.inf)
        t[at] = clock[own] + wait
        return t

    paths.append(first)
    arrivals.append(clocks(first, text[r], np.zeros(n, np.int64), 0))
    live = np.ones(n, bool)
    # Segmentations found: (round in which, arrival of the set).
    has = [np.ones(n, bool)]
    threshold = np.full(n, np.inf)
    for step in range(1, k + 1):
        best_t, best_path, best_at = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for p, (path, t) in enumerate(zip(paths, arrivals, strict=True)):
            full = np.flatnonzero(np.diff(path.bounds))
            if not len(full):
                continue
            least = np.minimum.reduceat(t, path.bounds[:-1][full])
            spread = np.repeat(least, np.diff(path.bounds)[full])
            hits = np.flatnonzero(t == spread)
            own = np.repeat(full, np.diff(path.bounds)[full])[hits]
            _, one = np.unique(own, return_index=True)
            at = hits[one] - path.bounds[own[one]]
            better = least < best_t[own[one]]
            rows = own[one][better]
            best_t[rows], best_path[rows], best_at[rows] = least[better], p, at[better]
        live &= np.isfinite(best_t)
        if step == k:
            threshold = np.where(live, best_t, threshold)
            break
        has.append(live.copy())
        rows = np.flatnonzero(live)
        clock = best_t
        taken = np.zeros(n, np.int64)
        draws, waits = _uniform(seed, 100 + step), -np.log(_uniform(seed, 1000 + step))
        for i in rows.tolist():
            p, at = int(best_path[i]), int(best_at[i])
            path = paths[p]
            spot = int(path.bounds[i]) + at
            node = int(np.searchsorted(lat.first, path.edge[spot], side="right")) - 1
            bar = barred.setdefault((p, i, at), [int(path.edge[spot])])
            choices = [x for x in range(int(lat.first[node]), int(lat.first[node + 1])) if x not in bar]
            chances = np.exp(lat.log_chance[choices])
            pick = choices[min(int(np.searchsorted(np.cumsum(chances), draws[i] * chances.sum())), len(choices) - 1)]
            bar.append(pick)
            taken[i] = pick
            # The same node with one edge more barred arrives later.
            rest = chances.sum() - np.exp(lat.log_chance[pick])
            lead = float(lat.log_chance[path.edge[path.bounds[i] : spot]].sum())
            rate = np.exp(lead) * rest if len(choices) > 1 else 0.0
            arrivals[p][spot] = best_t[i] + waits[i] / rate if rate > 0 else np.inf
        # New paths: the old one up to the node, the edge drawn, the rest of its part, and fresh parts.
        at_unit = np.array([paths[best_path[i]].unit[paths[best_path[i]].bounds[i] + best_at[i]] for i in rows], np.int64)
        here = lat.dst[taken[rows]]
        open_ = lat.first[here + 1] > lat.first[here]
        later = np.concatenate([np.arange(lat.bounds[i] + u + 1, lat.bounds[i + 1]) for i, u in zip(rows, at_unit, strict=True)]) if len(rows) else np.zeros(0, np.int64)
        f_text = np.concatenate([rows[open_], lat.text[later]])
        f_unit = np.concatenate([at_unit[open_], later - lat.bounds[lat.text[later]]])
        f_node = np.concatenate([here[open_], lat.begin[lat.part[later]]])
        order = np.lexsort((f_unit, f_text))
        f_text, f_unit, f_node = f_text[order], f_unit[order], f_node[order]
        r, _, e = lat.finish(f_text, f_unit, f_node, seed, step)
        old = [(paths[best_path[i]], int(paths[best_path[i]].bounds[i]), int(best_at[i])) for i in rows]
        head_text = np.concatenate([np.repeat(rows, [x[2] for x in old]), rows]) if len(rows) else np.zeros(0, np.int64)
        head_unit = np.concatenate([*[p.unit[b : b + a] for p, b, a in old], at_unit]) if len(rows) else np.zeros(0, np.int64)
        head_edge = np.concatenate([*[p.edge[b : b + a] for p, b, a in old], taken[rows]]) if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(head_text, kind="stable")
        all_text = np.concatenate([head_text[order], f_text[r]])
        all_unit = np.concatenate([head_unit[order], f_unit[r]])
        all_edge = np.concatenate([head_edge[order], e])
        order = np.argsort(all_text, kind="stable")
        path = _Path(all_text[order], all_unit[order], all_edge[order], n)
        paths.append(path)
        since = np.zeros(n, np.int64)
        since[rows] = best_at[rows] + 1
        arrivals.append(clocks(path, all_text[order], since, step))
    for path, had in zip(paths, has, strict=True):
        total = np.concatenate([[0.0], np.cumsum(lat.log_chance[path.edge])])
        ids, upto = lat.ids_of(path.edge)
        for i in np.flatnonzero(had).tolist():
            a, b = int(path.bounds[i]), int(path.bounds[i + 1])
            p = float(total[b] - total[a])
            out[whole[i]].append((ids[upto[a] : upto[b]], p, float(inclusion(p, threshold[i]))))
    return out


def inclusion(log_p: float, threshold: float) -> float:
    """log(1 - exp(-p t)), also where p is too small for a float."""
    if not np.isfinite(threshold):
        return 0.0
    log_rate = log_p + np.log(threshold)
    return log_rate if log_rate < -30 else np.log(-np.expm1(-np.exp(log_rate)))


SAMPLED = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids array<int>"
DIGESTED = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids_crc32 long, decoded_sha256 string"


def _run(path: str, k: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        mark = MARK.encode()
        plain = [x.replace(mark, b" ") for x in v.bytes]
        flat = np.frombuffer(b"".join(plain), np.uint8)
        sizes = np.array([len(x) for x in plain], np.int64)
        starts = np.cumsum(sizes) - sizes

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            keys = np.array([-1 if i is None else i for i in ids], np.int64)
            got = []
            for doc, found in zip(ids, sample(texts, keys, v, k), strict=True):
                for j, (pieces, p, score) in enumerate(found):
                    if not digests:
                        got.append((doc, j, len(pieces), p, score, pieces.tolist()))
                        continue
                    own = sizes[pieces]
                    upto = np.cumsum(own)
                    total = int(upto[-1]) if len(upto) else 0
                    data = flat[np.arange(total) + np.repeat(starts[pieces] - upto + own, own)].tobytes()
                    data = data.replace(mark, b" ")
                    got.append((doc, j, len(pieces), p, score, zlib.crc32(pieces.astype("<u4").tobytes()), hashlib.sha256(data[1:] if data[:1] == b" " else data).hexdigest()))
            cols = list(zip(*got, strict=True))
            last = (pa.int64(), pa.string()) if digests else (pa.list_(pa.int32()),)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), *last)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in (DIGESTED if digests else SAMPLED).split(", ")])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS or len(ids) >= 4096:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample_segmentations(docs: DataFrame, model: str | None = None, k: int = SAMPLES) -> DataFrame:
    """doc_id, sample, n_pieces, log_prob, log_inclusion, ids for up to ``k`` samples of each row of ``docs``."""
    return _rows(docs).mapInArrow(lean(_run(model or default_model(), k, False)), SAMPLED)


def segmentation_digests(docs: DataFrame, model: str | None = None, k: int = SAMPLES) -> DataFrame:
    """The same with digests of the ids and of the text that they decode to in place of the ids."""
    return _rows(docs).mapInArrow(lean(_run(model or default_model(), k, True)), DIGESTED)


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = segmentation_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.withColumn("log_prob", F.round("log_prob", 6)).withColumn("log_inclusion", F.round("log_inclusion", 6))
