import hashlib
import random

import brute
import pytest
from conftest import pairs_of

from strandwise.llm import blocks
from strandwise.llm import suffix_dedup as D


def test_cover_has_every_shift():
    assert {(b - a) % D.MODULUS for a in D.COVER for b in D.COVER} == set(range(D.MODULUS))


def check(spark, rows, parts=4):
    got = D.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    want = {(i, hashlib.sha256(t).digest()): v for (i, t), v in brute.repeats(rows).items()}
    assert len(got) == len(rows)
    for r in got:
        i = (1 << 63) - 1 if r.doc_id is None else r.doc_id
        assert want[i, bytes(r.digest)] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


@pytest.mark.parametrize(("seed", "size"), [(1, 2 << 20), (2, 700)])
def test_against_brute_force(spark, monkeypatch, seed, size):
    chunked = blocks._chunked
    monkeypatch.setattr(blocks, "_chunked", lambda _: chunked(size))
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé \n") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s, a = rng.choice(base), rng.randint(0, 250)
            parts.append(s[a : a + rng.randint(0, 120)] + rng.choice(["", "x", "yz"]))
        t = "".join(parts)
        rows.append((rng.choice([i, i, i, None, 7, -i]), rng.choice([t, t, t, t, None])))
    check(spark, rows)


def test_exact_lengths(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("abcdefgh") for _ in range(200))
    rows = [(1, p)] + [(k, f"{k}" * 7 + p[k % 60 : k % 60 + n] + "!" * 9) for k, n in enumerate(range(45, 95), 2)]
    check(spark, rows)


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, pairs_of(odd_docs))
    assert D.suffix_dedup(spark, no_docs).collect() == []
    out = D.without_repeats(spark, odd_docs)
    assert out.columns == odd_docs.columns
    assert all(r.text is None or r.text == r.text.encode().decode() for r in out.collect())


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """Removals of whole chunks whose first hash has only 4 bits, without Spark."""
    real = blocks.gram_hashes
    monkeypatch.setattr(blocks, "gram_hashes", lambda data, k, second=False: real(data, k, second) if second else real(data, k) & blocks.U64(15))
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(160)) for _ in range(3)]
    docs = [(i, base[i // 4][i : i + 110] + "".join(rng.choice("xyz") for _ in range(40))) for i in range(12)]
    rows = []
    for c in range(3):
        own = docs[c::3]
        text = [t.encode() for _, t in own]
        # The whole texts as segments, so that only prefixes decide.
        rows.append({"chunk_id": c, "ids": [i for i, _ in own], "docs": list(range(4)), "starts": [0] * 4, "sizes": [len(t) for t in text], "text": b"".join(text)})
    sent = [D.PREFIXES.messages(*D._send_prefixes(r), 0)[0] for r in rows]
    answers = D.PREFIXES.answers([m[1] for m in sent], [m[2] for m in sent])
    want = brute.repeats(docs)
    for row, told in zip(rows, answers):
        spans = {}
        row["replies"] = [{"range": 0, "reply": told}]
        for b in D._spans(iter([D.pa.RecordBatch.from_pylist([row])])):
            for out in b.to_pylist():
                for d, s, e in zip(out["docs"], out["starts"], out["ends"]):
                    spans.setdefault(d, []).append(e - s)
        for d, i in enumerate(row["ids"]):
            assert want[i, docs[i][1].encode()][1:3] == (sum(spans.get(d, [])), len(spans.get(d, [])))
