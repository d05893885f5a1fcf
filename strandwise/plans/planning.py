"""Questions to query plans by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators import prompts
from strandwise.sources.json_sources import CONSTRAINT, clean_plan
from strandwise.sources.llm_client import Client, ask


def plan_of(answer: Column) -> Column:
    """Triples of an answer: of the key ``triples`` if it is a list, else of the first key that is one; else none."""
    by_key = F.from_json(answer, "map<string,string>")
    is_list = lambda x: F.startswith(F.ltrim(x), F.lit("["))
    own = by_key["triples"]
    first = F.get(F.filter(F.map_values(by_key), is_list), 0)
    found = F.when(is_list(own), own).otherwise(first)
    return F.coalesce(clean_plan(F.filter(F.from_json(found, f"array<{CONSTRAINT}>"), lambda x: x.isNotNull())), F.array().cast(f"array<{CONSTRAINT}>"))


def plan_questions(questions: DataFrame, make_client: Callable[[], Client], tries: int = 3, pause: float = 2.0) -> DataFrame:
    """``questions(qid, question, ...)`` with ``query_plan``; empty where the model fails."""
    asked = ask(questions.withColumn("__prompt", prompts.plan_prompt(F.col("question"))), make_client, prompts.PLANNER_SYSTEM, "__prompt", "__response", tries, pause, temperature=0.0, response_format={"type": "json_object"})
    return asked.withColumn("query_plan", plan_of(F.col("__response"))).drop("__prompt", "__response")
