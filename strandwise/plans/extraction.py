"""Pages to a knowledge graph: chunks, model answers, and tables parsed from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions.text import first_text, text
from strandwise.operators import prompts
from strandwise.operators.chunking import chunk_pages
from strandwise.operators.kg import dedupe_mentions, link_triples, resolve_entities, title_entities, title_triples
from strandwise.sources.llm_client import Client, ask
from strandwise.workspace import Workspace

# Fixed value: names of keys in a model's answers.
_OBJECT = "struct<entities: array<string>, named_entities: array<string>, triples: array<string>>"


def _valid(x: Column) -> Column:
    """``x`` if it is one JSON value and nothing else.  The parser stops at the end of a first value, so the
    value is parsed as the only item of a list."""
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull(), x)


def _between(x: Column, first: str, last: str) -> Column:
    """From the first ``first`` to the last ``last``, or null."""
    found = F.regexp_extract(x, rf"(?s)(\{first}.*\{last})", 1)
    return F.nullif(found, F.lit(""))


def json_of(answer: Column) -> Column:
    """The JSON in a model's answer: all of it without code fences, else the outermost object, else the outermost
    list; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(text(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(_valid(F.nullif(bare, F.lit(""))), _valid(_between(bare, "{", "}")), _valid(_between(bare, "[", "]")))


def list_of(answer: Column) -> Column:
    """The outermost JSON list of an answer as items of text, else an empty list."""
    found = F.coalesce(_valid(_between(answer, "[", "]")), _valid(answer))
    listed = F.when(F.startswith(F.ltrim(found), F.lit("[")), F.from_json(found, "array<string>"))
    return F.coalesce(listed, F.array().cast("array<string>"))


def parse_openie(answers: DataFrame) -> DataFrame:
    """``answers`` with ``entity_items`` and ``triple_items``, the lists of JSON items of ``response``."""
    none = F.array().cast("array<string>")
    body = json_of(F.col("response"))
    rows = answers.withColumn("__json", body)
    is_list = F.startswith(F.ltrim("__json"), F.lit("["))
    obj = F.from_json("__json", _OBJECT)
    rows = rows.withColumn("__obj", F.when(F.startswith(F.ltrim("__json"), F.lit("{")), obj))
    triples = F.when(is_list, F.from_json("__json", "array<string>")).otherwise(F.col("__obj.triples"))
    entities = F.coalesce("__obj.entities", "__obj.named_entities", none)
    return rows.withColumn("entity_items", entities).withColumn("triple_items", F.coalesce(triples, none)).drop("__json", "__obj")


def entity_mentions(parsed: DataFrame) -> DataFrame:
    """(title, ord, chunk_idx, item, name, type) of entity items: names, or objects with name or text, and type."""
    rows = parsed.select("title", "ord", "chunk_idx", F.posexplode("entity_items").alias("item", "x"))
    obj = F.from_json("x", "struct<name: string, text: string, type: string>")
    is_obj = F.startswith(F.ltrim("x"), F.lit("{"))
    name = F.when(is_obj, text(first_text(obj["name"], obj["text"]))).otherwise(text(F.col("x")))
    return rows.select("title", "ord", "chunk_idx", "item", name.alias("name"), F.when(is_obj, obj["type"]).otherwise(F.lit("OTHER")).alias("type")).filter("name <> ''")


def triple_mentions(parsed: DataFrame) -> DataFrame:
    """(title, ord, chunk_idx, item, head, relation, tail, evidence) of triple items: objects, or lists of three."""
    rows = parsed.select("title", "ord", "chunk_idx", F.posexplode("triple_items").alias("item", "x"))
    obj = F.from_json("x", "struct<head: string, h: string, relation: string, r: string, tail: string, t: string, evidence: string>")
    three = F.from_json("x", "array<string>")
    listed = F.startswith(F.ltrim("x"), F.lit("["))
    pick = lambda k, *names: text(F.when(listed, F.get(three, k)).otherwise(first_text(*[obj[n] for n in names])))
    out = rows.select("title", "ord", "chunk_idx", "item", pick(0, "head", "h").alias("head"), pick(1, "relation", "r").alias("relation"), pick(2, "tail", "t").alias("tail"), F.when(listed, F.lit("")).otherwise(text(obj["evidence"])).alias("evidence"))
    return out.filter("head <> '' and relation <> '' and tail <> ''")


@dataclass
class Built:
    """entities(id, name, type, nkey), triples(triple_id, h, t, r, title, evidence), and the titles' lists."""

    entities: DataFrame
    triples: DataFrame
    title_entities: DataFrame
    title_triples: DataFrame


def build(entity_rows: DataFrame, triple_rows: DataFrame) -> Built:
    """A graph from mentions: of a title the listed entities come first, then its triples' ends."""
    order = ["ord", "phase", "chunk_idx", "item", "side"]
    listed = dedupe_mentions(entity_rows, "title", ["chunk_idx", "item"]).select("title", "ord", F.lit(0).alias("phase"), "chunk_idx", "item", F.lit(0).alias("side"), "name", "type")
    ends = triple_rows.select("title", "ord", F.lit(1).alias("phase"), "chunk_idx", "item", F.posexplode(F.array("head", "tail")).alias("side", "name")).withColumn("type", F.lit("OTHER"))
    entities = resolve_entities(listed.unionByName(ends.select(*listed.columns)), order)
    triples = link_triples(triple_rows, entities, ["ord", "chunk_idx", "item"])
    from strandwise.functions.text import name_key

    own = listed.withColumn("nkey", name_key(F.col("name"))).join(entities.select("nkey", "id"), "nkey").select("title", "id")
    return Built(entities, triples, title_entities(own, triples), title_triples(triples))


def extract(pages: DataFrame, make_client: Callable[[], Client], settings: Settings) -> DataFrame:
    """Chunks of ``pages(title, text, ord)`` with the model's parsed answers; one call a chunk."""
    chunks = chunk_pages(pages, settings.chunk_chars).withColumn("prompt", prompts.passage_prompt(F.col("chunk")))
    return parse_openie(ask(chunks, make_client, prompts.EXTRACTION_SYSTEM, temperature=0.0, max_tokens=1024).drop("prompt"))


def extract_in_two(pages: DataFrame, make_client: Callable[[], Client], settings: Settings) -> DataFrame:
    """The same with one call for entities and one for relations."""
    chunks = chunk_pages(pages, settings.chunk_chars)
    ents = ask(chunks.withColumn("prompt", prompts.passage_prompt(F.col("chunk"), prompts.ENTITIES_TASK)), make_client, prompts.ENTITIES_SYSTEM, into="__e", temperature=0.0, max_tokens=512)
    both = ask(ents.withColumn("prompt", prompts.passage_prompt(F.col("chunk"), prompts.RELATIONS_TASK)), make_client, prompts.RELATIONS_SYSTEM, into="__r", temperature=0.0, max_tokens=1024)
    return both.withColumn("entity_items", list_of(F.col("__e"))).withColumn("triple_items", list_of(F.col("__r"))).drop("prompt", "__e", "__r")


def unprocessed(pages: DataFrame, done: DataFrame | None) -> DataFrame:
    """Pages whose titles ``done`` doesn't have."""
    return pages if done is None else pages.join(done.select("title").distinct(), "title", "left_anti")


def extract_incrementally(spark: SparkSession, pages: DataFrame, make_client: Callable[[], Client], settings: Settings, path: str) -> DataFrame:
    """Append the answers of pages that ``path`` doesn't have yet, and return all of them.

    A title is written if the model answered for all of its chunks, and asked again by the next run if not.
    """
    append_answered(spark, unprocessed(pages, _existing(spark, path)), make_client, settings, path)
    return spark.read.parquet(path)


def append_answered(spark: SparkSession, pages: DataFrame, make_client: Callable[[], Client], settings: Settings, path: str) -> None:
    """Append the answers for ``pages`` to ``path``, without titles of which some chunk got none."""
    ws = Workspace(spark, "answers")
    # Written first, since each question is asked once.
    got = ws.save(extract(pages, make_client, settings), "asked")
    failed = got.filter("response is null").select("title").distinct()
    got.join(failed, "title", "left_anti").write.mode("append").parquet(path)
    ws.close()


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def build_graph(parsed: DataFrame) -> Built:
    return build(entity_mentions(parsed), triple_mentions(parsed))
