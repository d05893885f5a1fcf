import random

import brute
import numpy as np
import pytest

from strandwise.llm import minhash_dedup as M


def family_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 4, 8, 40, 200]))] for _ in range(30)]
    rows = []
    for i in range(260):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b).upper() if rng.random() < 0.1 else " ".join(b)))
    big = [rng.choice(words) for _ in range(150)]
    for i in range(260, 400):
        b = list(big)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b)))
    return [*rows, (400, None), (401, ""), (402, " \n")]


@pytest.mark.parametrize(("tile", "family", "family_bytes"), [(8192, 8192, M.FAMILY_BYTES), (16, 8192, M.FAMILY_BYTES), (64, 3, M.FAMILY_BYTES), (64, 8192, 3000)])
def test_against_all_pairs(spark, tile, family, family_bytes):
    rows = family_rows()
    got = M.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tile, family, family_bytes=family_bytes).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_family_links_equals_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.choice(500, 60, replace=False)
        sets = [np.unique(np.concatenate([base[rng.random(60) > 0.12], rng.choice(9000, rng.integers(0, 12))])).astype(np.uint64) for _ in range(40)]
        up = list(range(40))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a in range(40):
            for b in range(a):
                c = len(np.intersect1d(sets[a], sets[b]))
                if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
        assert [root(i) for i in range(40)] == M.family_links(sets).tolist()


def test_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (50, M.HASHES), dtype=np.uint32)
    s = M.sketches(a)
    assert (M.estimates(s, s) == 1).all()
    b = a.copy()
    b[:, : M.HASHES // 2] = rng.integers(0, 1 << 32, (50, M.HASHES // 2), dtype=np.uint32)
    assert abs(M.estimates(s, M.sketches(b)).mean() - 0.5) < 0.03


def test_odd_rows(spark, odd_docs, no_docs):
    got = M.near_components(spark, odd_docs.select("doc_id", "text")).collect()
    assert len(got) == 16
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[2] == {(1, False)} and by[1] == {(1, True)} and by[3] == {(3, True)} and by[10] == {(9, False)}
    assert by[7] == {(6, False)} and (9, False) in by[None] and (None, True) in by[None]
    assert M.near_components(spark, no_docs).collect() == []
    # Extra columns stay.
    assert M.one_of_each(spark, odd_docs).columns == odd_docs.columns


def passage_rows(n, shared=84, own=20, same=6):
    """Documents in pairs: all have one passage, and the two of a pair have ``same`` words of their own in common."""
    passage = [f"p{k}" for k in range(shared)]
    return [(i, " ".join(passage + [f"c{i // 2}x{k}" for k in range(same)] + [f"o{i}x{k}" for k in range(own - same)])) for i in range(n)]


def test_links_of_a_hot_passage(spark):
    # Small batches, as a region inside of one batch is compared whole.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    try:
        rows = passage_rows(1000)
        got = M.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, 3, 300).collect()
    finally:
        spark.conf.set(key, before)
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_block_links_equal_pairs():
    rng = np.random.default_rng(5)
    base = rng.choice(500, 60, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.12], rng.choice(9000, rng.integers(0, 12))])).astype(np.uint64) for _ in range(120)]
    left, right = sets[:70], sets[70:]
    label_l, label_r = rng.integers(0, 30, 70), rng.integers(0, 30, 50)
    want = np.arange(120)
    for a in range(70):
        for b in range(50):
            c = len(np.intersect1d(left[a], right[b]))
            if label_l[a] != label_r[b] and 100 * c >= 75 * (len(left[a]) + len(right[b]) - c):
                p, q = sorted((want[a], want[70 + b]))
                want[want == q] = p
    rows, roots = M.block_links(left, right, label_l, label_r)
    got = np.arange(120)
    got[rows] = roots
    assert got.tolist() == want.tolist() and 1 < len(set(want)) < 120


def test_slices_are_bounded_in_bytes():
    texts = [b"x" * n for n in (5, M.SLICE_BYTES + 1, 3, M.SLICE_BYTES - 1, 2, *[0] * 600)]
    got = list(M._slices(texts))
    assert [a for a, _ in got] == [0, 1, 2, 3, 4, 4 + M.SLICE, 4 + 2 * M.SLICE] and got[-1][1] == len(texts)
    assert [b for _, b in got[:-1]] == [a for a, _ in got[1:]]
    assert list(M._slices([])) == []


@pytest.mark.parametrize("tile", [4, 1000])
def test_regions_over_several_tasks_are_joined(tile):
    """Rows of one region that tasks hold parts of lie in one component, whatever the tile."""
    n = 40
    sketch = np.zeros((n, M.SKETCH_WORDS), np.uint64)
    cls, key = np.arange(n), np.repeat([1, 2, 2, 2], 10)
    edges = []
    for rows in (slice(0, 17), slice(17, 25), slice(25, 40)):
        parts = [slice(rows.start, rows.start + 3), slice(rows.start + 3, rows.stop)]
        batches = [M.pa.record_batch([M.pa.array(key[r]), M.pa.array(cls[r]), M.pa.array(cls[r]), M.pa.array([x.tobytes() for x in sketch[r]], M.pa.binary())], names=["key", "cls", "label", "sketch"]) for r in parts]
        for b in M._forest(tile)(iter(batches)):
            edges += [(x["a"], x["b"], x["degree"]) for x in b.to_pylist()]
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    named = {}
    for a, b, d in edges:
        a = named.setdefault(a, b) if d == M.JOINED else a
        p, q = sorted((root(a), root(b)))
        up[q] = p
    assert [root(i) for i in range(n)] == [0] * 10 + [10] * 30
