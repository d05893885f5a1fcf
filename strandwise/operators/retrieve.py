"""Retrieval of a constraint's evidence from the graph, for any number of tasks at once.

A task is a constraint, or an instantiation of one, with the key ``(qid, qi, inst)``.  ``tasks`` has the
key, question, head, tail and relation_variants; ``anchors`` has the key and eid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.similarity import Scorer
from strandwise.functions.sufficiency import effective_number, resolved
from strandwise.functions.text import clean_list, distinct_ignoring_case, join_texts, text
from strandwise.operators.kg import one_hop
from strandwise.operators.rank import top

KEY = ["qid", "qi", "inst"]


def query_text(head: Column, variants: Column, tail: Column, most: int = 3) -> Column:
    """``head (variant | variant) tail`` with the first variants; empty parts are left out."""
    own = F.array_join(F.slice(clean_list(variants), 1, max(1, most)), " | ")
    return join_texts(head, F.when(own != "", F.concat(F.lit("("), own, F.lit(")"))), tail)


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    return join_texts(head, relation, tail)


def expand(anchors: DataFrame, triples: DataFrame) -> DataFrame:
    """The triples one hop from a task's anchors, each once."""
    return one_hop(anchors.select(*KEY, "eid"), triples).select(*KEY, "triple_id").distinct()


def relation_scores(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """``pairs(relation_variants, relation)`` with relation_score: the best of the variants; 0 without any, or
    without a relation.  Each distinct variant and relation is scored once."""
    distinct = pairs.select("relation_variants", "relation").distinct()
    texts = distinct.select("relation_variants", "relation", F.explode(distinct_ignoring_case(F.col("relation_variants"))).alias("variant"), text(F.col("relation")).alias("own"))
    scored = scorer.add(texts.filter("own <> ''"), "variant", "own", "score")
    best = scored.groupBy(F.col("relation_variants").alias("__v"), F.col("relation").alias("__r")).agg(F.max("score").alias("__s"))
    same = F.col("relation_variants").eqNullSafe(F.col("__v")) & F.col("relation").eqNullSafe(F.col("__r"))
    return pairs.join(best, same, "left").withColumn("relation_score", F.coalesce("__s", F.lit(0.0))).drop("__v", "__r", "__s")


def top_relations(candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` by relation_score, ties to the larger triple; ``pos`` counts from 0."""
    return top(candidates, KEY, [F.desc("relation_score"), F.desc("triple_id")], k, "pos").withColumn("pos", F.col("pos") - 1)


def rerank(candidates: DataFrame, scorer: Scorer, settings: Settings) -> DataFrame:
    """Best ``top_n`` by logit, ties to the larger ``pos``; ``sel`` counts from 0."""
    asked = query_text(F.col("task_head"), F.col("relation_variants"), F.col("task_tail"), settings.max_variants_in_text)
    lead = F.concat(text(F.col("question")), F.lit(" ")) if settings.include_question_in_rerank else F.lit("")
    # The labels in a reranker's query.
    rows = candidates.withColumn("query_text", text(F.concat(F.lit("question: "), lead, F.lit(" UnknownTriple: "), asked)))
    rows = scorer.add(rows.withColumn("triple_text", triple_text(F.col("head"), F.col("relation"), F.col("tail"))), "query_text", "triple_text", "logit")
    best = top(rows.withColumn("logit", F.col("logit").cast("double")), KEY, [F.desc("logit"), F.desc("pos")], max(1, settings.top_n), "sel")
    return best.withColumn("sel", F.col("sel") - 1)


def sufficiency(selected: DataFrame, threshold: float) -> DataFrame:
    """(key, neff, status) of tasks with selected triples."""
    logits = F.transform(F.sort_array(F.collect_list(F.struct("sel", "logit"))), lambda x: x["logit"])
    neff = selected.groupBy(*KEY).agg(logits.alias("logits")).withColumn("neff", effective_number(F.col("logits")))
    return neff.select(*KEY, "neff", F.when(resolved(F.col("neff"), threshold), "resolved").otherwise("unresolved").alias("status"))


def retrieve(tasks: DataFrame, anchors: DataFrame, triples: DataFrame, relation: Scorer, reranker: Scorer, settings: Settings) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """(best, select, judge), so that a caller can write each step's result before the next reads it.

    ``best``: the candidates kept by relation, with key, triple_id, pos and what reranking reads;
    ``select(best)``: key, triple_id, head_id, tail_id, pos, sel, relation_score, logit;
    ``judge(selected)``: key, neff, status, for every task, infinite and unresolved without candidates.
    """
    own = tasks.select(*KEY, "question", F.col("head").alias("task_head"), F.col("tail").alias("task_tail"), "relation_variants")
    facts = triples.select("triple_id", "head_id", "tail_id", "head", "relation", "tail")
    found = expand(anchors, triples).join(facts, "triple_id").join(own, KEY)
    best = top_relations(relation_scores(found, relation), settings.relation_k)

    def select(kept: DataFrame) -> DataFrame:
        return rerank(kept, reranker, settings).select(*KEY, "triple_id", "head_id", "tail_id", "pos", "sel", "relation_score", "logit")

    def judge(selected: DataFrame) -> DataFrame:
        states = tasks.select(*KEY).join(sufficiency(selected, settings.neff_threshold), KEY, "left")
        return states.select(*KEY, F.coalesce("neff", F.lit(float("inf"))).alias("neff"), F.coalesce("status", F.lit("unresolved")).alias("status"))

    return best, select, judge
