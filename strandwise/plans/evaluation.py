"""Answers and retrieved units against gold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.text import squeeze
from strandwise.operators import metrics, prompts
from strandwise.sources.llm_client import Client, ask


def units_of(evidences: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """(qid, unit, similarity, pos) that ``evidences`` point to; one without a place is matched to the text that is
    most like it.  Questions without texts have none."""
    have = texts.select("qid").distinct()
    rows = evidences.join(have, "qid", "left_semi").withColumn("ask", F.concat_ws(":", "qi", "place")).withColumn("evidence", F.coalesce(F.nullif("evidence", F.lit("")), F.col("context")))
    placed = F.col("sent_idx") if settings.by_sentence else F.col("paragraph_idx")
    missing = rows.filter(placed.isNull()).select("qid", "ask", "title", "evidence")
    if settings.by_sentence:
        found = metrics.best_sentence(missing, texts).select("qid", "ask", F.col("title").alias("found_title"), F.col("sent_idx").alias("found_idx"))
        title = F.coalesce(F.col("found_title"), squeeze(F.col("title")))
    else:
        found = metrics.best_paragraph(missing, texts).select("qid", "ask", F.col("idx").alias("found_idx"))
        title = F.lit("")
    own = rows.join(found, ["qid", "ask"], "left").withColumn("at", F.coalesce(placed, F.col("found_idx"))).filter("at is not null")
    return metrics.predicted_units(own.select("qid", "qi", "place", metrics.unit_key(title, F.col("at")).alias("unit"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")))


def gold_of(examples: DataFrame, settings: Settings) -> DataFrame:
    return metrics.gold_sentences(examples) if settings.by_sentence else metrics.gold_paragraphs(examples)


def answer(items: DataFrame, make_client: Callable[[], Client], settings: Settings) -> DataFrame:
    """(qid, model_input, model_answer) of stage-2 ``items(qid, question, triples_evidence)``."""
    asked = ask(prompts.answer_prompts(items, settings), make_client, prompts.ANSWER_SYSTEM, "model_input", "model_answer", temperature=0.0)
    return asked.withColumn("model_answer", F.trim(F.coalesce("model_answer", F.lit(""))))


def score_answers(answers: DataFrame) -> DataFrame:
    """``answers(qid, model_answer, ground_truth_answer)`` with em and f1."""
    return metrics.with_scores(answers, "model_answer", "ground_truth_answer")


def evaluate(items: DataFrame, answers: DataFrame, evidences: DataFrame, texts: DataFrame, gold: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(per question, one row of totals): ``items(qid, question, ground_truth_answer)``, ``answers(qid, model_input, model_answer)``."""
    scored = score_answers(items.join(answers, "qid", "left"))
    units = units_of(evidences, texts, settings)
    recalls = metrics.recall(items, gold, units, settings)
    listed = units.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit", "similarity"))), lambda s: F.struct(s["unit"]["title"].alias("title"), s["unit"]["idx"].alias("idx"), s["similarity"].alias("similarity"))).alias("retrieval_predicted_support_units"))
    rates = [f"recall@{k}" for k in settings.recall_ks] + ["recall_all"]
    per = scored.join(recalls, "qid", "left").join(listed, "qid", "left")
    out = per.select(
        F.col("qid").alias("id"),
        "question",
        "ground_truth_answer",
        "model_input",
        "model_answer",
        "em",
        "f1",
        F.coalesce("retrieval_predicted_support_units", F.array()).alias("retrieval_predicted_support_units"),
        F.col("total_gold").alias("retrieval_total_support_facts"),
        *[F.col(f"`{r}`").alias(f"retrieval_{r}") for r in rates],
    )
    return out, metrics.summary(scored, recalls, settings)
