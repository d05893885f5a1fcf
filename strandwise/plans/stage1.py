"""Structural retrieval for all questions at once.

Pass 1 retrieves for constraints with anchors and at most one variable, and consolidates what they bind.  Pass 2
retrieves for constraints between two variables, once for each bound value (or pair of values), with the value's
look-alikes as anchors.  Both passes are one call of ``retrieve`` over all their tasks.

What several later steps read is written to the workspace: ranks with model scores are computed once, plans
stay small, and a lost executor costs a re-read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.similarity import LEXICAL, ZERO, Scorer
from strandwise.operators import anchors as A
from strandwise.operators import bindings as B
from strandwise.operators.rank import top
from strandwise.operators.retrieve import KEY, retrieve
from strandwise.sources.kg_sources import Graph
from strandwise.workspace import Workspace


@dataclass
class Pass:
    """Tasks of a pass and what came of them."""

    tasks: DataFrame
    anchors: DataFrame
    candidates: DataFrame
    selected: DataFrame
    states: DataFrame


@dataclass
class Stage1:
    """``constraints`` with triple_type; both passes; ``bindings`` as summarized at the end; ``status(qid, qi, status)``;
    ``support(qid, qi, triple_id, place, round)``; ``matches`` of surfaces."""

    constraints: DataFrame
    matches: DataFrame
    first: Pass
    second: Pass
    first_bindings: DataFrame
    bindings: DataFrame
    filtered: DataFrame
    status: DataFrame
    support: DataFrame


def _run(ws: Workspace, name: str, tasks: DataFrame, found: DataFrame, graph: Graph, relation: Scorer, reranker: Scorer, settings: Settings) -> Pass:
    best, rerank, states = retrieve(tasks, found, graph.triples, relation, reranker, settings)
    best = ws.save(best, f"{name}_best")
    selected = ws.save(rerank(best), f"{name}_selected")
    return Pass(tasks, found, best.select(*KEY, "triple_id", "pos"), selected, ws.save(states(selected), f"{name}_states"))


def first_pass(ws: Workspace, typed: DataFrame, found: DataFrame, graph: Graph, relation: Scorer, reranker: Scorer, settings: Settings) -> Pass:
    tasks = typed.filter("triple_type in ('single_var_with_anchor', 'no_var_with_anchor')").withColumn("inst", F.lit(""))
    own = found.withColumn("inst", F.lit("")).join(tasks.select(*KEY), KEY, "left_semi")
    return _run(ws, "first", tasks, own, graph, relation, reranker, settings)


def induced_by(done: Pass) -> DataFrame:
    """What resolved tasks with one variable bind."""
    resolved = done.states.filter("status = 'resolved'").select(*KEY)
    return B.induce(done.tasks, done.selected.join(resolved, KEY, "left_semi"), done.anchors)


def second_tasks(typed: DataFrame, bound: DataFrame, graph: Graph, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(tasks, anchors) of constraints between variables of which at least one is bound: a task for each of the first
    bound values by id, or for each pair of them."""
    named = top(bound, ["qid", "var"], [F.asc("eid")], max(1, settings.top_n)).join(graph.entities.select(F.col("id").alias("eid"), "name"), "eid")
    side = lambda s: named.select("qid", F.col("var").alias(s), F.col("eid").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"))
    double = typed.filter("triple_type = 'double_var'")
    rows = double.join(side("head"), ["qid", "head"], "left").join(side("tail"), ["qid", "tail"], "left").filter("head_id is not null or tail_id is not null")
    # A null would be formatted as a word.
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%012d", c)).otherwise("")
    inst = F.concat(number("head_id"), F.lit("|"), number("tail_id"))
    tasks = rows.select("qid", "qi", inst.alias("inst"), "question", F.coalesce("head_name", "head").alias("head"), F.coalesce("tail_name", "tail").alias("tail"), "relation_variants", "triple_type", "head_id", "tail_id")
    alias = A.alias_anchors(bound, graph.entities, settings.top_k_entity)
    ends = tasks.select(*KEY, F.posexplode(F.array("head_id", "tail_id")).alias("side", "eid")).filter("eid is not null")
    found = ends.join(alias, "eid").groupBy(*KEY, F.col("anchor").alias("eid")).agg(F.min(F.col("side") * F.lit(1 << 40) + F.col("anchor")).alias("pos"))
    return tasks, found


def run(items: DataFrame, constraints: DataFrame, graph: Graph, settings: Settings, relation: Scorer = LEXICAL, reranker: Scorer = ZERO) -> Stage1:
    """``constraints(qid, qi, question, head, tail, relation_variants)`` of normalized plans."""
    ws = Workspace(constraints.sparkSession, "stage1")
    matches = ws.save(A.match_surfaces(A.known_surfaces(constraints), graph.entities, settings.top_k_entity), "matches")
    found = ws.save(A.assemble(constraints, matches), "anchors")
    typed = ws.save(A.with_types(constraints, found), "typed")
    first = first_pass(ws, typed, found, graph, relation, reranker, settings)
    sets1 = ws.save(induced_by(first), "sets1")
    agreed1 = ws.save(B.consolidate(sets1), "agreed1")
    bound = B.bound(agreed1)

    resolved = first.states.filter("status = 'resolved'").select(*KEY)
    settled = first.selected.join(resolved, KEY, "left_semi")
    filtered = ws.save(B.filter_by_binding(first.tasks, settled, first.anchors, bound), "filtered")
    # A constraint whose variable is bound keeps what agrees; one without variable, or without binding, all.
    variables = first.tasks.select(*KEY, B.single_variable(F.col("head"), F.col("tail")).alias("var"))
    under = variables.join(bound.select("qid", "var").distinct(), ["qid", "var"], "left_semi").select(*KEY)
    support1 = settled.join(under, KEY, "left_anti").select("qid", "qi", "triple_id", F.col("sel").alias("place")).unionByName(filtered.select("qid", "qi", "triple_id", F.col("sel").alias("place")))

    tasks2, anchors2 = second_tasks(typed, bound, graph, settings)
    tasks2, anchors2 = ws.save(tasks2, "second_tasks"), ws.save(anchors2, "second_anchors")
    second = _run(ws, "second", tasks2, anchors2, graph, relation, reranker, settings)
    one_side = second.tasks.filter("head_id is null or tail_id is null").select(*KEY)
    sets2 = induced_by(second).join(one_side, KEY, "left_semi")
    final = ws.save(B.summarize(B.consolidate(sets1.unionByName(sets2)), graph.entities), "bindings")

    settled2 = second.states.groupBy("qid", "qi").agg(F.max((F.col("status") == "resolved").cast("int")).alias("r")).filter("r = 1").select("qid", "qi")
    merged = second.selected.select("qid", "qi", "triple_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("qid", "qi").orderBy("triple_id")) - 1)
    support2 = merged.join(settled2, ["qid", "qi"], "left_semi")
    support = support1.withColumn("round", F.lit(1)).unionByName(support2.withColumn("round", F.lit(2)))

    done = resolved.select("qid", "qi").union(settled2).distinct().withColumn("status", F.lit("resolved"))
    status = typed.select("qid", "qi").join(done, ["qid", "qi"], "left").select("qid", "qi", F.coalesce("status", F.lit("unresolved")).alias("status"))
    return Stage1(typed, matches, first, second, agreed1, final, filtered, ws.save(status, "status"), ws.save(support, "support"))


def evidence(support: DataFrame, triples: DataFrame) -> DataFrame:
    """(qid, idx, triple_id, head_id, tail_id, head, relation, tail, meta): a question's distinct triples by id."""
    once = support.select("qid", "triple_id").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("qid").orderBy("triple_id")) - 1)
    return once.join(triples, "triple_id").select("qid", "idx", "triple_id", "head_id", "tail_id", "head", "relation", "tail", "meta")


def support_indices(support: DataFrame, listed: DataFrame) -> DataFrame:
    """(qid, qi, round, evidence_indices) in the order of each support."""
    rows = support.join(listed.select("qid", "triple_id", "idx"), ["qid", "triple_id"])
    return rows.groupBy("qid", "qi", "round").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "idx"))), lambda x: x["idx"]).alias("evidence_indices"))


def _listed(rows: DataFrame, order: list[str], item, into: str) -> DataFrame:
    """(qid, into): the ``item`` structs of each question in ``order``."""
    packed = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], item.alias("x"))))
    return rows.groupBy("qid").agg(F.transform(packed, lambda s: s["x"]).alias(into))


def _records(done: Pass, graph: Graph, stage: str) -> DataFrame:
    """(qid, qi, inst, record): what happened in each task, as the debug record."""
    anchors = done.anchors.join(graph.entities.select(F.col("id").alias("eid"), F.col("name").alias("entity_name")), "eid", "left")
    a = anchors.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("eid").alias("entity_id"), "entity_name").alias("x")))), lambda s: s["x"]).alias("anchors"))
    c = done.candidates.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "triple_id"))), lambda s: s["triple_id"]).alias("candidate_ids_topk"))
    s = done.selected.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("sel", "triple_id", "pos"))).alias("s"))
    none = F.array().cast("array<bigint>")
    rows = done.states.join(done.tasks.select(*KEY, "triple_type"), KEY).join(a, KEY, "left").join(c, KEY, "left").join(s, KEY, "left")
    record = F.struct(
        F.lit(stage).alias("stage"),
        F.col("triple_type").alias("triple_type_initial"),
        "anchors",
        F.coalesce("candidate_ids_topk", none).alias("candidate_ids_topk"),
        F.coalesce(F.transform("s", lambda x: x["triple_id"]), none).alias("selected_triple_ids"),
        F.coalesce(F.transform("s", lambda x: x["pos"].cast("int")), F.array().cast("array<int>")).alias("selected_indices_in_topk"),
        "neff",
        "status",
    )
    return rows.filter("anchors is not null").select(*KEY, record.alias("record"))


def assemble(items: DataFrame, done: Stage1, graph: Graph) -> DataFrame:
    """One nested row per question: id, question, ground_truth_answer, query_plan, evidence_triples, support, debug."""
    ev = evidence(done.support, graph.triples)
    facts = F.struct(F.col("triple_id").alias("kg_triple_id"), F.col("head_id").alias("head_entity_id"), F.col("tail_id").alias("tail_entity_id"), "head", "relation", "tail", "meta")
    evidence_triples = _listed(ev, ["idx"], facts, "evidence_triples")
    support = _listed(support_indices(done.support, ev), ["round", "qi"], F.struct(F.col("qi").alias("query_triple_index"), "evidence_indices"), "support")

    surfaces = A.known_surfaces(done.constraints)
    known = surfaces.groupBy("qid").agg(F.sort_array(F.collect_set("surface")).alias("known_entities"))
    names = done.matches.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "eid", "name"))).alias("m"))
    mapped = surfaces.join(names, "surface").select("qid", "surface", F.struct(F.col("surface").alias("query_entity"), F.transform("m", lambda x: x["eid"]).alias("kg_entity_ids"), F.transform("m", lambda x: x["name"]).alias("kg_entity_names")).alias("x"))
    entity_map = _listed(mapped, ["surface"], F.col("x"), "entity_map")
    bindings = done.bindings.groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("var", F.struct("binding_ids", "binding_names", "method", "union_ids", "intersection_ids"))))).alias("bindings"))

    records = _records(done.first, graph, "first_pass").unionByName(_records(done.second, graph, "second_pass"))
    own = records.groupBy("qid", "qi").agg(F.transform(F.sort_array(F.collect_list(F.struct("inst", "record"))), lambda x: x["record"]).alias("stage_records"))
    induced = induced_by(done.first).groupBy("qid", "qi").agg(F.sort_array(F.collect_set("eid")).alias("induced_entities"))
    kept = done.filtered.groupBy("qid", "qi").agg(F.transform(F.sort_array(F.collect_list(F.struct("sel", "triple_id"))), lambda x: x["triple_id"]).alias("selected_triple_ids_filtered"))
    per = done.constraints.join(done.status, ["qid", "qi"]).join(own, ["qid", "qi"], "left").join(induced, ["qid", "qi"], "left").join(kept, ["qid", "qi"], "left")
    first = F.get("stage_records", 0)
    is_double = F.col("triple_type") == "double_var"
    merged = F.array_sort(F.array_distinct(F.flatten(F.transform("stage_records", lambda r: r["selected_triple_ids"]))))
    item = F.struct(
        F.col("qi").alias("query_triple_index"),
        F.struct("head", "tail", "relation_variants").alias("query_triple"),
        F.col("triple_type").alias("triple_type_initial"),
        F.coalesce("stage_records", F.array()).alias("stage_records"),
        "status",
        F.when(is_double, merged).otherwise(first["selected_triple_ids"]).alias("selected_triple_ids"),
        F.when(~is_double, first["neff"]).alias("neff"),
        F.when(~is_double & F.col("stage_records").isNotNull(), F.coalesce("induced_entities", F.array().cast("array<bigint>"))).alias("induced_entities"),
        "selected_triple_ids_filtered",
    )
    per_triple = _listed(per, ["qi"], item, "per_triple")
    out = items
    for part in (evidence_triples, support, known, entity_map, bindings, per_triple):
        out = out.join(part, "qid", "left")
    none = lambda c: F.coalesce(c, F.array())
    debug = F.struct(none("known_entities").alias("known_entities"), none("entity_map").alias("entity_map"), "bindings", none("per_triple").alias("per_triple"))
    return out.select(F.col("qid").alias("id"), "question", "ground_truth_answer", "query_plan", none("evidence_triples").alias("evidence_triples"), none("support").alias("support"), debug.alias("debug"))
