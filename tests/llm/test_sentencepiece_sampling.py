import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import pairs_of

from strandwise.llm import sentencepiece_sampling as S


@pytest.fixture(scope="module")
def v():
    return S.vocabulary(S.default_model())


def segmentations(v, text):
    """All segmentations with their log weights, by recursion."""
    ids = {v.processor.id_to_piece(int(i)): int(i) for i in v.ids}

    def rest(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in ids:
                for tail, p in rest(s[n:]):
                    yield (ids[s[:n]], *tail), p + v.logp[ids[s[:n]]]

    every = list(rest(S.MARK + text.replace(" ", S.MARK)))
    total = np.logaddexp.reduce([p for _, p in every])
    return {s: p - total for s, p in every}


@pytest.mark.parametrize("text", ["a", "abc", "the er", "in heit"])
def test_probabilities_and_exhaustion(v, text):
    every = segmentations(v, text)
    (got,) = S.sample([text], np.array([3]), v, len(every) + 5)
    assert {tuple(x[0].tolist()) for x in got} == set(every)
    assert len(got) == len(every)
    for ids, p, score in got:
        assert p == pytest.approx(every[tuple(ids.tolist())], abs=1e-9)
        assert score == 0.0


def test_frequencies_without_replacement(v):
    text, n = "abc", 30_000
    every = {s: math.exp(p) for s, p in segmentations(v, text).items()}
    got = S.sample([text] * n, np.arange(n), v, 2)
    first, second = Counter(tuple(g[0][0].tolist()) for g in got), Counter(tuple(g[1][0].tolist()) for g in got)
    for s, p in every.items():
        later = sum(q * p / (1 - q) for t, q in every.items() if t != s)
        for seen, share in ((first[s], p), (second[s], later)):
            assert abs(seen / n - share) < 5 * math.sqrt(max(share, 1e-4) / n)
    # An estimate that divides by inclusion scores is unbiased.
    estimate = np.mean([sum(math.exp(p - s) for _, p, s in g) for g in got])
    assert estimate == pytest.approx(1.0, abs=0.02)


def test_distinct_decodable_and_independent_of_batches(v):
    texts = ["Hello  world\nab \t x", "", " a", "é漢😀", "<s>x</s>", "The " * 500, "x" * 3000, "12.5"]
    keys = np.arange(len(texts))
    together = S.sample(texts, keys, v, 4)
    for t, k, got in zip(texts, keys, together):
        (alone,) = S.sample([t], np.array([k]), v, 4)
        assert [(a[0].tolist(), round(a[1], 6)) for a in alone] == [(a[0].tolist(), round(a[1], 6)) for a in got]
        assert len({tuple(a[0].tolist()) for a in got}) == len(got) >= 1
        for ids, p, score in got:
            assert S.decode(ids.tolist(), S.default_model()) == t
            assert v.processor.decode(ids.tolist()) == t
            assert p <= 1e-9 and score <= 1e-9


def test_lookups_end_where_no_piece_goes_on(v, monkeypatch):
    words = ["Anblewh", "sttible", "thonreoronsetion", "edthndingwhin", "internationalization", "qzjxk", "é漢😀", "x" * 40]
    looked, match = [], S.Vocabulary.match
    monkeypatch.setattr(S.Vocabulary, "match", lambda self, h: looked.append(len(h)) or match(self, h))
    lat = S.Lattice([" ".join(words), "and " * 9 + "the"], v)
    pieces = {v.processor.id_to_piece(int(i)) for i in v.ids}
    beginnings = {p[:n] for p in pieces for n in range(1, len(p))}
    size = np.diff(np.append(lat.begin, len(lat.first) - 1)) - 1
    all_, needed = 0, 0
    for k, (begin, n) in enumerate(zip(lat.begin.tolist(), size.tolist())):
        at = int(size[:k].sum())
        s = "".join(map(chr, lat.codes[at : at + n].tolist()))
        for a in range(n):
            node = begin + a
            got = sorted((lat.dst[lat.first[node] : lat.first[node + 1]] - begin).tolist())
            assert got == [b for b in range(a + 1, n + 1) if s[a:b] in pieces or b == a + 1]
            all_ += min(n - a, v.longest)
            needed += next((m for m in range(1, n - a) if s[a : a + m] not in beginnings), n - a)
    assert sum(looked) <= needed * 1.2 < all_ * 0.8


def test_samples_stay_what_they_were(v):
    texts = ["The quick brown fox  jumps,\nover 12.5 lazy dogs", "Anblewh sttible athawh " * 20, "é漢😀 ▁ x" * 3, "q" * 60]
    got = S.sample(texts, np.array([5, -1, 7, 1 << 40]), v, 3)
    assert [[zlib.crc32(ids.astype("<u4").tobytes()) for ids, _, _ in g] for g in got] == [[3480040384, 1378902734, 2401861277], [3883519711, 125367844, 1091416364], [3032331725, 1163238475, 3132978551], [252963932, 3905254517, 1395948670]]


def test_table(spark, odd_docs, no_docs):
    import hashlib

    got = S.segmentation_digests(odd_docs).collect()
    texts = [(t or "").replace(S.MARK, " ") for _, t in pairs_of(odd_docs)]
    assert Counter(r.decoded_sha256 for r in got if r.sample == 0) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert S.sample_segmentations(no_docs).collect() == []
