import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import language_id as G


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = G.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_bounds_on_learning(spark):
    rows = [(f"wort {i}", "de") for i in range(3000)] + [("mot", "fr")] * 500 + [(None, "fr"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found, totals = G.picked(docs, 300)
    by = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert totals == {"de": 3000, "fr": 500} and 220 < by["de"] < 380 and by.get("fr", 0) <= 1
    langs, table, prior = G.fit(docs, 3000)
    assert langs == ["de", "fr"] and table.shape == (2, G.FEATURES) and np.exp(prior).tolist() == pytest.approx([6 / 7, 1 / 7])
    # The commonest values are learned, and of equal ones the first.
    many = spark.createDataFrame([(f"w {k} {i}", f"l{k}") for k in range(9) for i in range(3)] + [("v", "l7")], "text string, lang string")
    assert G.fit(many, 100, 3)[0] == ["l0", "l1", "l7"]


def features_of(text):
    """Counts of hashed 1- to 3-grams, one at a time."""
    chars = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
    out = Counter()
    for n in G.ORDERS:
        for at in range(len(chars) - n + 1):
            if chars[at] == 32:
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in chars[at : at + n]:
                h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
            out[h >> 16] += 1
    return out


def test_against_a_plain_classifier(spark):
    rng = random.Random(2)
    words = {"aa": "le la été près où ça".split(), "bb": "the of and was Their".split(), "cc": "der die Straße über und".split()}
    rows = [(i, " ".join(rng.choice(words[g]) + rng.choice(["", ",", "!", "7"]) for _ in range(rng.randrange(1, 12))), g) for i, g in enumerate(rng.choices(list(words), [5, 3, 2], k=160))]
    rows += [(200, "le the der", None), (201, "42 !", "aa"), (202, None, "bb")]
    got = {r.doc_id: r for r in G.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learn = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2 and g and t is not None]
    counts = {g: sum((features_of(t) for t, x in set(learn) if x == g), Counter()) for g in words}
    sums = {g: sum(c.values()) + G.SMOOTHING * G.FEATURES for g, c in counts.items()}
    prior = Counter(g for _, g in learn)
    for i, t, _ in rows:
        f = features_of(t or "")
        if not f:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = {g: math.log(prior[g] / len(learn)) + sum(n * math.log((counts[g][x] + G.SMOOTHING) / sums[g]) for x, n in f.items()) for g in words}
        best = max(logs, key=logs.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_odd_rows(spark, odd_docs, no_docs):
    got = G.language_id(odd_docs).collect()
    assert len(got) == 16
    for r in got:
        if r.doc_id in (3, 4, 5, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert G.language_id(no_docs).collect() == []
    kept = G.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("text is null").count() == 0
    # Nothing to learn from.
    none = G.language_id(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_prediction_ignores_the_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(G.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in G.language_id(d).filter("held_out").collect()} for d in (docs, other))
    assert a == b and len(a) > 20
