"""Prompts for models, as expressions and as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.text import clean_list, join_texts, squeeze, text

EXTRACTION_SYSTEM = "You extract knowledge from text. List the entities a passage names and the facts it states, with pronouns resolved to names. Answer with one JSON object and nothing else."
EXTRACTION_TASK = (
    'Answer with {"entities": [{"name": ..., "type": one of PERSON, ORG, LOC, EVENT, OTHER}], '
    '"triples": [{"head": ..., "relation": ..., "tail": ..., "evidence": a quote of up to 20 words}]}. '
    "State only what the passage supports; list each entity once, at most 20 entities and 30 triples."
)
ENTITIES_SYSTEM = "You list the entities of a text as JSON."
ENTITIES_TASK = 'Answer with a JSON list of up to 15 items {"name": ..., "type": one of PERSON, ORG, LOC, EVENT, OTHER, "aliases": [...], "title_hint": ...}. List only what the text supports, each entity once.'
RELATIONS_SYSTEM = "You list the facts of a text as JSON."
RELATIONS_TASK = 'Answer with a JSON list of up to 25 items {"head": ..., "relation": ..., "tail": ..., "evidence": a short quote}. List only facts that the text states.'
PLANNER_SYSTEM = """Break a question into triples over a knowledge graph.

- A known entity is written as in the question; an unknown one is a variable: ? and a short name.
- One variable stands for one unknown; use it again only for that unknown, and number variables that could be confused.
- Each triple is an object with "head", "tail" and "relation_variants", three short phrasings of the relation that can be understood without the question.
- Together the triples are the shortest chain that gives the answer once every variable is filled.
- A property that is asked for hangs on the entity that has it. Conditions on an entity are triples on its variable. A value that the question states is an end itself, not a variable.

Answer with one JSON object {"triples": [...]}.

Question: Which river crosses the town where Ada Moor was born?
{"triples": [{"head": "Ada Moor", "relation_variants": ["born in", "place of birth", "was born at"], "tail": "?town"}, {"head": "?river", "relation_variants": ["crosses", "flows through", "runs through"], "tail": "?town"}]}"""
ANSWER_SYSTEM = "You answer questions from given evidence alone."
ANSWER_INTRO = "The question below was split into smaller ones, each with evidence found for it. Reason from the evidence step by step, filling unknowns as they are settled, and answer with a short phrase only: a name, a number or a noun phrase, without explanation."


def messages(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


def passage_prompt(passage: Column, task: str = EXTRACTION_TASK) -> Column:
    return F.concat(F.lit("Passage:\n"), F.coalesce(passage, F.lit("")), F.lit(f"\n\n{task}"))


def plan_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nOutput:"))


def triple_line(head: Column, relation: Column, variants: Column, tail: Column) -> Column:
    """``head | relation | tail``; without a relation its first three variants, parted by slashes."""
    shown = F.array_join(clean_list(F.slice(F.coalesce(variants, F.array().cast("array<string>")), 1, 3)), " / ")
    return join_texts(head, F.when(text(relation) != "", relation).otherwise(shown), tail, sep=" | ")


def answer_prompts(items: DataFrame, settings: Settings) -> DataFrame:
    """(qid, model_input) of ``items(qid, question, triples_evidence)``; evidence lines follow constraints in order."""

    # The labels of triples and evidence lines.
    def block(te: Column) -> Column:
        line = triple_line(te["query_triple"]["head"], F.lit(""), te["query_triple"]["relation_variants"], te["query_triple"]["tail"])
        shown = F.slice(te["candidate_evidences"], 1, settings.prompt_max_texts)
        texts = F.transform(shown, lambda e, i: F.concat(F.lit("    Evidence "), (i + 1).cast("string"), F.lit(": "), squeeze(e["context"])))
        head = F.concat(F.lit("T"), te["query_triple_index"].cast("string"), F.lit(": "), line)
        return F.array_join(F.concat(F.array(head, F.lit("  Text evidence:")), texts), "\n")

    body = F.array_join(F.transform("triples_evidence", block), "\n")
    q = text(F.col("question"))
    return items.select("qid", F.concat(F.lit(ANSWER_INTRO + "\n\nQuestion: "), q, F.lit("\n\n"), body, F.lit("\n\nQuestion: "), q, F.lit(" Answer:")).alias("model_input"))
