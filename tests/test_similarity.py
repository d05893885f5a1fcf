from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strandwise.functions import similarity as S
from strandwise.functions.sufficiency import effective_number, resolved


def test_ratio_keeps_the_order_of_its_arguments(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("Ada", "ADA MOOR"), (None, "x"), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(S.ratio(F.col("a"), F.col("b"))).collect()]
    want = [SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in rows.collect()]
    assert got == want and got[0] != got[1]


def test_lexical(spark):
    rows = spark.createDataFrame([("based in", "Based  IN nation"), ("", "x"), (None, None), ("a b", "c")], "a string, b string")
    assert [r[0] for r in rows.select(S.lexical(F.col("a"), F.col("b"))).collect()] == pytest.approx([2 / 6**0.5, 0, 0, 0])


def test_models_see_distinct_inputs_once(spark):
    rows = spark.createDataFrame([("x", "y")] * 50 + [("y", "x"), (None, "x")], "a string, b string").repartition(4)
    pairs = S.PairScorer(lambda: lambda ps: [len(ps) for _ in ps], batch=1000)
    got = pairs.add(rows, "a", "b", "s")
    assert got.count() == 52 and max(r.s for r in got.collect()) <= 3
    embed = S.EmbeddingScorer(lambda: lambda texts: [[1.0, 0.0] if t == "x" else [0.6, 0.8] for t in texts])
    assert sorted(round(r.s, 6) for r in embed.add(rows, "a", "b", "s").distinct().collect()) == [0.0, 0.6, 0.6]
    assert {r.s for r in S.ZERO.add(rows, "a", "b", "s").collect()} == {0.0}


def test_factories_without_libraries():
    assert S.build_reranker(None) is S.ZERO and S.build_embedder(None) is S.LEXICAL
    assert S.build_reranker("some-model") is S.ZERO
    with pytest.raises(RuntimeError):
        S.build_embedder("some-model")


def neff(xs):
    if not xs:
        return float("inf")
    ws = [x - min(xs) + 1e-6 for x in xs] if min(xs) <= 0 else xs
    z = sum(ws)
    return float("inf") if z <= 0 else 1 / sum((w / z) ** 2 for w in ws)


def test_effective_number(spark):
    cases = [[-4.0, -1.0, 3.0], [0.0, 0.0, 0.0], [2.0], [0.0], [1.0, 1.0], [-1.0, 1.0], [], [5.0, 0.1]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, xs array<double>")
    got = rows.select(effective_number(F.col("xs")).alias("n"), resolved(effective_number(F.col("xs")), 1.5).alias("r")).collect()
    assert [r.n for r in got] == pytest.approx([neff(c) for c in cases])
    assert [r.r for r in got] == [neff(c) <= 1.5 for c in cases]
    assert round(got[0].n, 5) == 1.72414
