"""Whole jobs from files to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.similarity import LEXICAL, ZERO, Scorer
from strandwise.plans import evaluation, extraction, planning, stage1, stage2
from strandwise.sources import json_sources as J
from strandwise.sources.kg_sources import Graph, load_graph, write_bundle
from strandwise.sources.llm_client import Client
from strandwise.sources.pages import first_pages, load_pages, merge_pages
from strandwise.workspace import Workspace


def read_examples(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    schema = J.SENTENCE_EXAMPLE if settings.by_sentence else J.PARAGRAPH_EXAMPLE
    return J.last_by_id(J.read_list(spark, path, schema), ("_id", "id", "qid"))


def read_items(spark: SparkSession, plan_path: str, data_path: str | None, settings: Settings) -> DataFrame:
    raw = None
    if data_path:
        schema = J.SENTENCE_EXAMPLE if settings.by_sentence else J.PARAGRAPH_EXAMPLE
        raw = J.answers(J.read_list(spark, data_path, schema), settings.id_keys)
    plans = J.take(J.read_list(spark, plan_path, J.PLAN), settings.num_samples)
    return J.normalize_plans(plans, raw, settings.id_keys)


def texts_of(examples: DataFrame, settings: Settings) -> DataFrame:
    return J.text_units(examples) if settings.by_sentence else J.paragraphs(examples)


def run_stage1(items: DataFrame, graph: Graph, settings: Settings, relation: Scorer = LEXICAL, reranker: Scorer = ZERO) -> tuple[DataFrame, stage1.Stage1]:
    done = stage1.run(items, J.constraints(items), graph, settings, relation, reranker)
    return stage1.assemble(items, done, graph), done


def run_retrieval(spark: SparkSession, plan_path: str, data_path: str, kg_path: str, out: str, settings: Settings, relation: Scorer = LEXICAL, reranker: Scorer = ZERO) -> tuple[DataFrame, DataFrame]:
    """Both stages; writes ``out/stage1`` and ``out/stage2`` as Parquet and JSON lines, and returns them read back."""
    graph = load_graph(spark, kg_path).saved(spark)
    items = Workspace(spark, "items").save(read_items(spark, plan_path, data_path, settings), "items")
    first, done = run_stage1(items, graph, settings, relation, reranker)
    J.write_table(first, f"{out}/stage1")
    J.write_lines(spark.read.parquet(f"{out}/stage1"), f"{out}/stage1_json")
    evidences, facts = stage2.run(done, graph, texts_of(read_examples(spark, data_path, settings), settings), settings, relation, reranker)
    J.write_table(stage2.assemble(items, done, evidences, facts), f"{out}/stage2")
    second = spark.read.parquet(f"{out}/stage2").drop("pos")
    J.write_lines(second, f"{out}/stage2_json")
    return spark.read.parquet(f"{out}/stage1"), second


def run_evaluation(spark: SparkSession, stage2_path: str, data_path: str, out: str, make_client: Callable[[], Client], settings: Settings) -> DataFrame:
    """Answers and scores of a written stage 2; returns the row of totals."""
    items = J.take(spark.read.parquet(stage2_path).withColumnRenamed("id", "qid"), settings.num_samples).drop("pos")
    evidences = items.select("qid", F.explode("triples_evidence").alias("te")).select("qid", F.col("te.query_triple_index").alias("qi"), F.posexplode("te.candidate_evidences").alias("place", "e")).select("qid", "qi", "place", "e.*")
    examples = read_examples(spark, data_path, settings)
    # Answers cost model calls, so they are written before anything reads them.
    J.write_table(evaluation.answer(items, make_client, settings), f"{out}/answers")
    answers = spark.read.parquet(f"{out}/answers")
    per, totals = evaluation.evaluate(items, answers, evidences, texts_of(examples, settings), evaluation.gold_of(examples, settings), settings)
    J.write_table(per, f"{out}/questions")
    return totals


def run_planner(spark: SparkSession, data_path: str, out: str, make_client: Callable[[], Client], settings: Settings) -> DataFrame:
    schema = J.SENTENCE_EXAMPLE if settings.by_sentence else J.PARAGRAPH_EXAMPLE
    examples = J.take(J.read_list(spark, data_path, schema), settings.num_samples)
    asked = examples.select(F.coalesce(J.example_id(settings.id_keys), F.lit("")).alias("qid"), "pos", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("ground_truth_answer"))
    J.write_table(planning.plan_questions(asked, make_client), out)
    return spark.read.parquet(out)


def run_extraction(spark: SparkSession, data_paths: list[str], out: str, make_client: Callable[[], Client], settings: Settings, num_pages: int | None = None) -> extraction.Built:
    """Pages of the sets to a graph bundle under ``out``; titles answered by an earlier run are not asked again."""
    pages = first_pages(merge_pages([load_pages(spark, p, settings.num_samples)[0] for p in data_paths]), num_pages)
    built = extraction.build_graph(extraction.extract_incrementally(spark, pages, make_client, settings, f"{out}/answers"))
    write_bundle(built.entities, built.triples, built.title_entities, built.title_triples, out)
    return built
