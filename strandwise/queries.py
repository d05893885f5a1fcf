"""Queries over the driver's tables, one or more for each group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise import evidence_queries, file_queries
from strandwise.config import Settings
from strandwise.functions import text as X
from strandwise.functions.similarity import LEXICAL, cosine, lexical
from strandwise.operators import anchors as A
from strandwise.operators import bindings as B
from strandwise.operators import chunking, kg, metrics, recovery
from strandwise.operators.rank import dense_ids, top
from strandwise.plans import stage1, star
from strandwise.sources import json_sources as J
from strandwise.workspace import Workspace

#: Three candidates that tie have 3 effective ones: with the first threshold they stay open, and with the second they settle.
SETTINGS = Settings(neff_threshold=2.95)
TIES = Settings(neff_threshold=3 + 1e-9)
# Surface forms, questions and plans of the queries.
SURFACES = ("ASIA", "small ring", "Blue BOLT part", "Supplier#000000001", "HOUSEHOLD goods", "nothing shared", "Brand#2 NATION_3")
ASIA_QUESTION = "Which suppliers are based in nations of ASIA?"
ASIA_PLAN = [("?nation", ["located in region"], "ASIA"), ("?supplier", ["based in nation"], "?nation")]
SHAPES = (
    ("q0", 0, "?nation", "ASIA"),
    ("q0", 1, "?supplier", "?nation"),
    ("q1", 0, "HOUSEHOLD", "BUILDING"),
    ("q1", 1, "", "?y"),
    ("q1", 2, "no such name", "?y"),
    ("q2", 0, "red widget", "?brand"),
    ("q2", 1, "?a", "?a"),
    ("q3", 0, "unknown thing", "other thing"),
)
QUERY_TEXTS = (
    ("t0", ["born in", "Born In", " place of birth "], ["Ada Moor", "ada moor", "Ada  M."], ["Turin"]),
    ("t1", ["based in"], [], ["Turin", "Milan"]),
    ("t2", ["based in", "located in"], ["Nordic Rail"], []),
    ("t3", [], ["Nordic Rail"], ["Turin"]),
    ("t4", ["is"], [], []),
)


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.entities(spark, sf_dir)


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.links(spark, sf_dir).select("triple_id", "h", "t", "r", "title")


def kg_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star.graph(spark, sf_dir)
    return kg.one_hop(g.entities.select(F.col("id").alias("eid")), g.triples)


def kg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.degrees(star.graph(spark, sf_dir).triples)


def title2entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents = star.entities(spark, sf_dir)
    listed = ents.filter("type = 'LOC'").select(F.lit("nation").alias("title"), "id")
    return kg.title_entities(listed, star.links(spark, sf_dir, ents)).select("title", F.explode("entity_ids").alias("eid"))


def title2triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.title_triples(star.links(spark, sf_dir)).select("title", F.posexplode("triple_idxs").alias("place", "triple_id"))


def _surfaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SURFACES], "surface string")


def anchor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidates(_surfaces(spark), star.entities(spark, sf_dir)).select("surface", "eid")


def anchor_topk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.match_surfaces(_surfaces(spark), star.entities(spark, sf_dir), 3).select("surface", "eid", "rank", F.round("score", 6).alias("score"))


def constraint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SHAPES, "qid string, qi int, head string, tail string")
    matches = A.match_surfaces(A.known_surfaces(rows), star.entities(spark, sf_dir), 3)
    return A.with_types(rows, A.assemble(rows, matches)).select("qid", "qi", "triple_type")


def _nation_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two constraints on who lives in each nation; for odd nations the second asks who is based there.

    The questions of two nations of three name a customer, who is thereby likelier than others."""
    last = star.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_name").alias("c_name"))
    n = star.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(last, "n_nationkey", "left")
    named = F.when(F.col("n_nationkey") % 3 > 0, F.col("c_name"))
    odd = F.col("n_nationkey") % 2 == 1
    variants = F.when(F.col("qi") == 0, F.array(F.lit("lives in nation"))).when(odd, F.array(F.lit("based in nation"))).otherwise(F.array(F.lit("lives in nation"), F.lit("resident of nation")))
    return n.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("qi")).select(F.col("n_name").alias("qid"), "qi", F.concat_ws(" ", F.lit("Who is in"), "n_name", F.lit("as"), named).alias("question"), F.lit("?x").alias("head"), F.col("n_name").alias("tail"), variants.alias("relation_variants"))


def _nation_pass(spark: SparkSession, sf_dir: str) -> tuple[stage1.Pass, star.Graph]:
    g = star.graph(spark, sf_dir)
    rows = _nation_constraints(spark, sf_dir)
    ws = Workspace(spark, "nations")
    found = ws.save(A.assemble(rows, A.match_surfaces(A.known_surfaces(rows), g.entities, 1)), "anchors")
    return stage1.first_pass(ws, A.with_types(rows, found), found, g, LEXICAL, LEXICAL, SETTINGS), g


def relation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _nation_pass(spark, sf_dir)
    return done.candidates.select("qid", "qi", "triple_id", "pos")


def rerank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _nation_pass(spark, sf_dir)
    return done.selected.select("qid", "qi", "triple_id", "pos", "sel", F.round("relation_score", 6).alias("relation_score"), F.round("logit", 6).alias("logit"))


def neff(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _nation_pass(spark, sf_dir)
    return done.states.select("qid", "qi", F.round("neff", 6).alias("neff"), "status")


def bindings_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _nation_pass(spark, sf_dir)
    return B.consolidate(stage1.induced_by(done)).select("qid", "var", "eid", "in_binding", "in_intersection", "n_sets", "method")


def binding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = _nation_pass(spark, sf_dir)
    bound = B.bound(B.consolidate(stage1.induced_by(done)))
    return B.filter_by_binding(done.tasks, done.selected, done.anchors, bound).select("qid", "qi", "triple_id")


def _asia(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, stage1.Stage1, star.Graph]:
    g = star.graph(spark, sf_dir)
    plan = [{"head": h, "tail": t, "relation_variants": r} for h, r, t in ASIA_PLAN]
    items = spark.createDataFrame([("asia", ASIA_QUESTION, None, plan)], f"qid string, question string, ground_truth_answer string, query_plan array<{J.CONSTRAINT.lower()}>")
    return items, stage1.run(items, J.constraints(items), g, TIES, LEXICAL, LEXICAL), g


def propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both passes bind."""
    _, done, _ = _asia(spark, sf_dir)
    return done.bindings.select("var", "method", F.posexplode("binding_ids").alias("place", "eid"))


def evidence_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done, g = _asia(spark, sf_dir)
    ev = stage1.evidence(done.support, g.triples)
    rows = stage1.support_indices(done.support, ev).select("qi", F.posexplode("evidence_indices").alias("place", "idx"))
    return rows.join(ev, "idx").select("qi", "place", "idx", "triple_id", "head", "relation", "tail")


def bound_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the second pass for constraints between variables, of which both ends, one or none are bound."""
    g = star.graph(spark, sf_dir)
    ends = (("?region", "?nation"), ("?nation", "?who"), ("?who", "?region"), ("?who", "?what"))
    typed = spark.createDataFrame([("both", k, "Where?", h, t, ["in"], "double_var") for k, (h, t) in enumerate(ends)], "qid string, qi int, question string, head string, tail string, relation_variants array<string>, triple_type string")
    known = lambda table, name, var: g.entities.join(star.table(spark, sf_dir, table).select(F.col(name).alias("name")), "name", "left_semi").select(F.lit("both").alias("qid"), F.lit(var).alias("var"), F.col("id").alias("eid"))
    tasks, _ = stage1.second_tasks(typed, known("region", "r_name", "?region").unionByName(known("nation", "n_name", "?nation")), g, SETTINGS)
    return tasks.select("qid", "qi", "inst", "head", "tail", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("head_id", "tail_id")])


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next."""
    v = star.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 5).alias("score"))


def stage1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested items of stage 1 as JSON."""
    items, done, g = _asia(spark, sf_dir)
    return stage1.assemble(items, done, g).select("id", F.to_json(F.struct("evidence_triples", "support", "debug")).alias("item"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(QUERY_TEXTS, "qid string, variants array<string>, heads array<string>, tails array<string>")
    texts = recovery.query_texts(F.col("variants"), X.distinct_ignoring_case(F.col("heads")), X.distinct_ignoring_case(F.col("tails")))
    return rows.select("qid", F.posexplode(texts).alias("place", "query_text"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id 50 divides, itself included, in blocks of queries."""
    from strandwise.operators.vectors import nearest

    rows = star.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, 10).select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


def _containments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.operators.containment import containments

    docs = star.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = star.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return containments(docs, items)


def text_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containments(spark, sf_dir)


def _numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(star.table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], "n")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that aren't blank as (doc_idx, title, sent_idx, raw_sent_idx, sent)."""
    lines = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("raw_sent_idx"), X.text(x).alias("sent"))), lambda x: x["sent"] != "").alias("s"))
    return lines.select("doc_idx", F.concat(F.lit("d"), "doc_idx").alias("title"), F.posexplode("s").alias("sent_idx", "x")).select("doc_idx", "title", "sent_idx", "x.raw_sent_idx", "x.sent")


def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lines of all documents for each benchmark item."""
    items = _numbered_items(spark, sf_dir)
    asked = items.select(F.col("n").cast("string").alias("qid"), F.lit(0).alias("qi"), F.array(X.squeeze(F.col("text"))).alias("query_texts"), recovery.rerank_query(F.lit(""), F.array(X.squeeze(F.col("text")))).alias("rerank_query"))
    ws = Workspace(spark, "recovery")
    units = ws.save(recovery.likely_units(asked, document_lines(spark, sf_dir), SETTINGS.unres_top_similar), "units").drop("qi")
    return recovery.recover_sentences(asked, units, LEXICAL, LEXICAL, SETTINGS)


def text_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovery(spark, sf_dir).select("qid", "place", F.col("paragraph_idx").alias("doc_id"), "sent_idx", F.round("similarity", 6).alias("similarity"))


def support_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the documents that contain an item among those that its lines were recovered from."""
    items = _numbered_items(spark, sf_dir)
    gold = _containments(spark, sf_dir).join(items, "item_id").select(F.col("n").cast("string").alias("qid"), metrics.unit_key(F.lit(""), F.col("doc_id")).alias("unit")).distinct()
    found = metrics.predicted_units(_recovery(spark, sf_dir).select("qid", "qi", "place", metrics.unit_key(F.lit(""), F.col("paragraph_idx")).alias("unit"), "similarity"))
    rows = metrics.recall(items.select(F.col("n").cast("string").alias("qid")), gold, found, SETTINGS)
    rate = lambda c: F.round(F.col(f"`{c}`"), 6)
    return rows.select("qid", "total_gold", F.col("`hits@2`").cast("long").alias("hits_2"), F.col("`hits@all`").cast("long").alias("hits_all"), rate("recall@2").alias("recall_2"), rate("recall_all").alias("recall_all"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("title"), F.col("doc_id").alias("ord"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.chunk_pages(pages, 1200)
    return rows.select(F.col("title").alias("doc_id"), "chunk_idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn against the assistant's next, as if it were the answer."""
    rows = star.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.withColumn("next_role", F.lead("role").over(w)).withColumn("gold", F.lead("text").over(w)).filter("role = 'user' and next_role = 'assistant'")
    return metrics.with_scores(pairs, "text", "gold").select("conv_id", "turn", "em", F.round("f1", 6).alias("f1"))


def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = em_f1(spark, sf_dir)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 5).alias("f1"))


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).select("p_type", X.entity_type(F.col("p_type")).alias("type"), "n")


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical similarity of part names and types, and best names for each type by it."""
    parts = star.table(spark, sf_dir, "part").select("p_name").distinct()
    brands = star.table(spark, sf_dir, "part").select(F.concat(F.split("p_name", " ")[0], F.lit(" bolt")).alias("asked")).distinct()
    left = brands.select("asked", F.explode(X.tokens(F.col("asked"))).alias("token"))
    right = parts.select("p_name", F.explode(X.tokens(F.col("p_name"))).alias("token"))
    pairs = left.join(right, "token").select("asked", "p_name").distinct().withColumn("score", F.round(lexical(F.col("asked"), F.col("p_name")), 6))
    return top(pairs, ["asked"], [F.desc("score"), F.asc("p_name")], 3)


QUERIES = {
    f.__name__: f
    for f in (
        kg_entities, kg_triples, kg_one_hop, kg_degree, title2entities, title2triples, anchor_candidates, anchor_topk_ratio, constraint_types,
        relation_topk, rerank_select, neff, bindings_consolidated, binding_filter, propagation, evidence_assembly, bound_tasks, stage1_items, query_texts,
        embedding_topk, vector_cosine, text_provenance, text_recovery, support_recall, chunk_pack, em_f1, answer_summary,
        entity_types, similar_names,
    )
} | file_queries.QUERIES | evidence_queries.QUERIES
