import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.config import Settings, from_mapping, parse_recall_ks
from strandwise.operators import anchors, bindings, chunking, containment, kg, metrics, rank, recovery, vectors
from strandwise.operators.retrieve import query_text, triple_text


def test_dense_ids_and_top(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    got = rank.dense_ids(rows, ["x"], "n").collect()
    assert all(r.x == r.n for r in got) and len(got) == 1000
    assert rank.dense_ids(rows.limit(0), ["x"], "n").collect() == []
    best = rank.top(rows.withColumn("g", F.col("x") % 3), ["g"], [F.desc("x")], 2).collect()
    assert sorted((r.g, r["rank"], r.x) for r in best) == [(0, 1, 999), (0, 2, 996), (1, 1, 997), (1, 2, 994), (2, 1, 998), (2, 2, 995)]


def test_settings():
    s = Settings()
    assert (s.top_n, s.top_k_entity, s.relation_k, s.neff_threshold, s.doc_prefilter_k, s.unres_top_similar) == (3, 3, 8, 1.5, 80, 20)
    assert from_mapping({"dataset": "2wiki", "recall_ks": "1, x,3", "num_samples": "none"}).recall_ks == (1, 3)
    assert parse_recall_ks("") == (2, 5, 10) and parse_recall_ks(None) == (2, 5, 10)
    for bad in ({"nope": 1}, {"dataset": "other"}):
        with pytest.raises(ValueError):
            from_mapping(bad)


def test_entities_and_triples(spark):
    names = spark.createDataFrame([(0, "Ada Moor", "person"), (1, "Nordic Rail", "company"), (2, "ADA  moor!", "LOC"), (3, "--", "x")], "pos int, name string, type string")
    ents = kg.resolve_entities(names, ["pos"])
    assert [(r.id, r.name, r.type) for r in ents.orderBy("id").collect()] == [(0, "Ada Moor", "PERSON"), (1, "Nordic Rail", "ORG")]
    said = spark.createDataFrame([(0, "ada moor", "works for", "Nordic Rail", "A", ""), (1, "Ada Moor", "Works  For", "nordic rail", "A", ""), (2, "Ada Moor", "works for", "Nordic Rail", "B", ""), (3, "Ada Moor", "is", "unknown", "A", "")], "pos int, head string, relation string, tail string, title string, evidence string")
    got = kg.link_triples(said, ents, ["pos"]).orderBy("triple_id").collect()
    assert [(r.triple_id, r.h, r.t, r.r, r.title) for r in got] == [(0, 0, 1, "works for", "A"), (1, 0, 1, "works for", "B")]
    listed = spark.createDataFrame([("A", 1), ("C", 0)], "title string, id long")
    t2e = {r.title: r.entity_ids for r in kg.title_entities(listed, kg.link_triples(said, ents, ["pos"])).collect()}
    assert t2e == {"A": [0, 1], "B": [0, 1], "C": [0]}
    assert {r.title: r.triple_idxs for r in kg.title_triples(kg.link_triples(said, ents, ["pos"])).collect()} == {"A": [0], "B": [1]}


def test_parse_triples_and_one_hop(spark):
    ents = spark.createDataFrame([(0, "zero"), (1, "one")], "id long, name string")
    raw = spark.createDataFrame([(0, "0", "r", "1"), (1, "7", "r", "0"), (2, "name", None, "1"), (3, "1", "loop", "1")], "triple_id long, h string, r string, t string").withColumn("meta", kg.meta_struct({}))
    got = {r.triple_id: (r.head_id, r.head, r.relation, r.tail_id, r.tail) for r in kg.parse_triples(raw, ents).collect()}
    assert got == {0: (0, "zero", "r", 1, "one"), 1: (None, "7", "r", 0, "zero"), 2: (None, "name", "", 1, "one"), 3: (1, "one", "loop", 1, "one")}
    hops = kg.one_hop(spark.createDataFrame([(1,)], "eid long"), kg.parse_triples(raw, ents))
    assert sorted(r.triple_id for r in hops.collect()) == [0, 2, 3]
    assert "NestedLoop" not in hops._jdf.queryExecution().toString()


def chunk(text, n):
    import re

    out, held = [], ""
    for p in re.split(r"\n{2,}", text):
        p = p.strip()
        if not p:
            continue
        if held and len(held) + 2 + len(p) > n:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=20, max_size=40), st.integers(1, 30))
def test_chunks(spark, texts, n):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = [r.y for r in rows.select("k", chunking.chunks(F.col("x"), n).alias("y")).orderBy("k").collect()]
    assert got == [chunk(t, n) for t in texts]


def test_anchor_ties_go_to_the_larger_id(spark):
    ents = spark.createDataFrame([(0, "Ada Moor"), (1, "Ada Moor"), (2, "Ada"), (3, "Bob")], "id long, name string")
    got = anchors.match_surfaces(spark.createDataFrame([("ada moor",), ("nobody",)], "surface string"), ents, 2).orderBy("rank").collect()
    assert [(r.eid, r.score) for r in got] == [(1, 1.0), (0, 1.0)]
    rows = spark.createDataFrame([("q", 0, "Ada", "Bob"), ("q", 1, "?x", "Ada")], "qid string, qi int, head string, tail string")
    matches = anchors.match_surfaces(anchors.known_surfaces(rows), ents, 3)
    got = anchors.assemble(rows, matches).filter("qi = 0").orderBy("pos").collect()
    assert [r.eid for r in got] == [2, 1, 0, 3]
    assert {r.anchor for r in anchors.alias_anchors(spark.createDataFrame([(0,)], "eid long"), ents, 2).collect()} == {0, 1}


def test_texts_of_constraints_and_triples(spark):
    rows = spark.createDataFrame([("Ada", ["a", " ", "b", "c", "d"], "?x"), ("", [], "Turin"), (None, None, None)], "h string, v array<string>, t string")
    got = [r[0] for r in rows.select(query_text(F.col("h"), F.col("v"), F.col("t"))).collect()]
    assert got == ["Ada (a | b | c) ?x", "Turin", ""]
    assert spark.range(1).select(triple_text(F.lit(" Ada "), F.lit(None).cast("string"), F.lit("Turin"))).first()[0] == "Ada Turin"


def induced(spark, sets):
    rows = [("q", k, "", v, e) for v, own in sets.items() for k, s in enumerate(own) for e in s]
    return spark.createDataFrame(rows, "qid string, qi int, inst string, var string, eid long")


def test_bindings(spark):
    ents = spark.createDataFrame([(k, f"n{k}") for k in range(10)], "id long, name string")
    got = {r["var"]: r for r in bindings.summarize(bindings.consolidate(induced(spark, {"?x": [{1, 2}, {2, 3}], "?z": [{1}, {5}], "?y": [{9}]})), ents).collect()}
    assert (got["?x"].binding_ids, got["?x"].method, got["?x"].union_ids, got["?x"].intersection_ids) == ([2], "intersection", [1, 2, 3], [2])
    assert (got["?z"].binding_ids, got["?z"].method, got["?z"].intersection_ids) == ([1, 5], "union", [])
    assert (got["?y"].binding_names, got["?y"].method, got["?y"].intersection_ids) == (["n9"], "union", None)


def test_query_texts(spark):
    rows = spark.createDataFrame([(["born in", "Born In"], ["Ada", "A."], ["Turin"]), ([], ["Ada"], ["Turin"]), (["is"], [], [])], "v array<string>, h array<string>, t array<string>")
    got = [r[0] for r in rows.select(recovery.query_texts(F.col("v"), F.col("h"), F.col("t"))).collect()]
    assert got == [["Ada born in Turin", "A. born in Turin"], [], ["is"]]
    q = spark.createDataFrame([("Who?", ["t"]), ("Who?", []), ("", ["t"]), (None, [])], "q string, t array<string>")
    assert [r[0] for r in q.select(recovery.rerank_query(F.col("q"), F.col("t"))).collect()] == ["question: Who? constraint: t", "question: Who?", "constraint: t", "constraint:"]


def f1(p, g):
    from collections import Counter

    a, b = p.lower().split(), g.lower().split()
    same = sum((Counter(a) & Counter(b)).values())
    return 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) if same else 0.0


def test_answer_scores(spark):
    pairs = [("Turin", "turin."), ("x y y", "y y z"), ("", "a"), ("b", ""), (None, "b"), ("b b", "b"), ("x", None)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, p string, g string")
    got = rows.select("k", metrics.exact_match(F.col("p"), F.col("g")).alias("em"), metrics.token_f1(F.col("p"), F.col("g")).alias("f1")).orderBy("k").collect()
    # The article "a" has the empty key, as the empty answer has.
    assert [r.em for r in got] == [1, 0, 1, 0, 0, 0, 0]
    assert [r.f1 for r in got] == pytest.approx([1, f1("x y y", "y y z"), 0, 0, 0, f1("b b", "b"), 0])


def test_recall(spark):
    unit = lambda q, i: (q, ("", i))
    gold = spark.createDataFrame([unit("a", 1), unit("a", 2), unit("b", 1), unit("d", 1)], "qid string, unit struct<title: string, idx: int>")
    found = spark.createDataFrame([("a", ("", 9), 0.5, 1), ("a", ("", 2), 0.5, 2), ("a", ("", 1), 0.5, 3), ("c", ("", 1), 0.5, 1)], "qid string, unit struct<title: string, idx: int>, similarity double, pos int")
    questions = spark.createDataFrame([(q,) for q in "abcd"], "qid string")
    s = Settings(recall_ks=(2, 5))
    got = {r.qid: r for r in metrics.recall(questions, gold, found, s).collect()}
    assert (got["a"].total_gold, got["a"]["recall@2"], got["a"]["recall@5"], got["a"].recall_all) == (2, 0.5, 1.0, 1.0)
    assert got["b"].total_gold == 0 and got["c"].total_gold == 0
    strict = {r.qid: r.total_gold for r in metrics.recall(questions, gold, found, s.with_(strict_recall=True)).collect()}
    assert strict == {"a": 2, "b": 1, "c": 0, "d": 1}
    scored = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 0.0)], "qid string, em double, f1 double")
    row = metrics.summary(scored, metrics.recall(questions, gold, found, s), s).first()
    assert (row.n, row.em, row.f1, row.n_with_gold, row["micro_recall@2"], row.macro_recall_all) == (2, 0.5, 0.25, 1, 0.5, 1.0)


def test_nearest_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 8))
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = vectors.nearest(rows.filter("vec_id < 7"), rows, 5, block=3).collect()
    want = {(q, int(i), k + 1) for q in range(7) for k, i in enumerate(np.argsort(-(v @ v[q]), kind="stable")[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_containments(spark):
    docs = spark.createDataFrame([(1, "xx Alpha beta-gamma deltas yy"), (2, "alpha beta gamma delt"), (3, None), (4, "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "Beta, gamma"), (3, ""), (4, None)], "item_id long, item string")
    assert sorted((r.doc_id, r.item_id) for r in containment.containments(docs, items).collect()) == [(1, 1), (1, 2), (2, 2), (4, 2)]


def test_best_of_rows():
    import numpy as np

    from strandwise.operators.vectors import best

    rng = np.random.default_rng(3)
    for m, k in ((0, 3), (2, 3), (3, 3), (40, 3), (40, 1)):
        ids = np.argsort(rng.random((7, m)), axis=1)
        scores = rng.integers(0, 5, (7, m)).astype(float)
        if m == 40:
            scores[2, :38] = -np.inf
        got_ids, got = best(ids, scores, k)
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        assert (got_ids == np.take_along_axis(ids, order, 1)).all() and (got == np.take_along_axis(scores, order, 1)).all()
