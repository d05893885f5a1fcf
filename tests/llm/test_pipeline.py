import zlib

import brute
import corpus_pipeline as P
import numpy as np
from tokenizers import Tokenizer

from strandwise.llm import packing


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name == "best_fit_packing":
            tok = Tokenizer.from_file(packing.default_vocabulary())
            want = {}
            for i, t in before.items():
                ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
                want |= {(i, k): zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()) for k, s in enumerate(range(0, len(ids), 4096))}
            assert {(r.doc_id, r.piece): r.ids_crc32 for r in out.collect()} == want
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert len(after) >= 0.99 * sum(any(c.isalpha() for c in t or "") for t in before.values())
        if name == "line_dedup":
            assert after == dict(zip(before, brute.kept_lines(list(before.items())))) and after != before
        if name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, c) in brute.components(list(before.items())).items() if i == c}
            assert all(after[i] == before[i] for i in after)
        if name == "suffix_dedup":
            want = brute.repeats(list(before.items()))
            for i, t in before.items():
                n, gone, _, digest = want[i, (t or "").encode()]
                if gone and gone < n and i in after:
                    assert len(after[i].encode()) <= n - gone
                elif gone == n and n:
                    assert i not in after
                else:
                    assert after[i] == t


def test_run(spark, sf_dir):
    """All stages at once give what they give one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    rows = P.run(spark, sf_dir).collect()
    assert pieces(rows) == pieces(docs.collect())
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    columns = odd_docs.columns
    for docs, want in ((odd_docs, [11, 11, 5, 5]), (no_docs, [0] * 4)):
        for (name, stage), n in zip(P.STAGES[:-1], want):
            docs = stage(spark, docs, "")
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            rows = docs.collect()
            assert len(rows) == n, (name, rows)
            assert all(r.n_chars == len(r.text) for r in rows)
        got = P.STAGES[-1][1](spark, docs, "").collect()
        assert sorted(r.doc_id for r in got if r.piece == 0) == sorted(r.doc_id for r in docs.collect())
