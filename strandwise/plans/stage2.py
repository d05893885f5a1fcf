"""Evidence text for every constraint: where the graph settled it, what its triples were taken from; where not, the
sentences or paragraphs most like the constraint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.similarity import LEXICAL, ZERO, Scorer
from strandwise.operators import anchors as A
from strandwise.operators import provenance, recovery
from strandwise.operators.rank import top
from strandwise.plans import stage1 as S1
from strandwise.sources.kg_sources import Graph

PLACE = ["qid", "qi", "place"]
EVIDENCE = ["title", "paragraph_idx", "sent_idx", "context", "evidence", "similarity", "sentence_similarity"]


def entity_map(done: S1.Stage1) -> DataFrame:
    """(qid, surface, kg_entity_names) of a question's known ends, best names first."""
    names = done.matches.groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("kg_entity_names"))
    return A.known_surfaces(done.constraints).join(names, "surface").select("qid", "surface", "kg_entity_names")


def resolved_evidence(facts: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Provenance of facts, the first of each constraint in the order of its support."""
    find = provenance.sentence_evidence if settings.by_sentence else provenance.paragraph_evidence
    return top(find(facts, texts), ["qid", "qi"], [F.col("place")], max(1, settings.topk_resolved), "__k").select(*PLACE, *EVIDENCE)


def open_evidence(open_: DataFrame, texts: DataFrame, bindings: DataFrame, mapped: DataFrame, settings: Settings, scorer: Scorer, reranker: Scorer) -> DataFrame:
    asked = recovery.with_query_texts(open_, bindings, mapped, settings)
    find = recovery.recover_sentences if settings.by_sentence else recovery.recover_paragraphs
    return find(asked, texts, scorer, reranker, settings).select(*PLACE, *EVIDENCE)


def run(done: S1.Stage1, graph: Graph, texts: DataFrame, settings: Settings, scorer: Scorer = LEXICAL, reranker: Scorer = ZERO) -> tuple[DataFrame, DataFrame]:
    """(evidences, facts): ``texts`` are the questions' text units, or paragraphs; a question without any gets none."""
    ev = S1.evidence(done.support, graph.triples)
    settled = done.status.filter("status = 'resolved'").select("qid", "qi")
    support = S1.support_indices(done.support, ev).join(settled, ["qid", "qi"], "left_semi")
    facts = provenance.support_facts(ev.select("qid", "idx", "triple_id", "head", "relation", "tail", F.col("meta.title").alias("title")), support)
    open_ = done.constraints.join(settled, ["qid", "qi"], "left_anti")
    found = resolved_evidence(facts, texts, settings).unionByName(open_evidence(open_, texts, done.bindings, entity_map(done), settings, scorer, reranker))
    return found, facts


def assemble(items: DataFrame, done: S1.Stage1, evidences: DataFrame, facts: DataFrame) -> DataFrame:
    """One nested row per question: id, question, ground_truth_answer, triples_evidence, and ``pos`` if ``items`` have it."""
    pack = lambda rows, item, into: rows.groupBy("qid", "qi").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("x")))), lambda s: s["x"]).alias(into))
    texts = pack(evidences, F.struct(*EVIDENCE), "candidate_evidences")
    triples = pack(facts, F.struct(F.col("triple_id").alias("kg_triple_id"), "head", "relation", "tail"), "kg_triples")
    per = done.constraints.join(done.status, ["qid", "qi"]).join(texts, ["qid", "qi"], "left").join(triples, ["qid", "qi"], "left")
    item = F.struct(
        F.col("qi").alias("query_triple_index"),
        F.struct("head", "tail", "relation_variants").alias("query_triple"),
        F.col("status").alias("triple_status"),
        F.coalesce("candidate_evidences", F.array()).alias("candidate_evidences"),
        F.coalesce("kg_triples", F.array()).alias("kg_triples"),
    )
    listed = per.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("qi", item.alias("x")))), lambda s: s["x"]).alias("triples_evidence"))
    out = items.join(listed, "qid", "left")
    place = ["pos"] if "pos" in items.columns else []
    return out.select(F.col("qid").alias("id"), "question", "ground_truth_answer", F.coalesce("triples_evidence", F.array()).alias("triples_evidence"), *place)
