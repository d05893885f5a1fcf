"""Entities, triples and their neighbourhoods.

Tables:

* ``entities(id, name, type)`` with dense ids from 0;
* ``triples(triple_id, head_id, tail_id, relation, head, tail, meta)``; an end that is no entity has a
  null id and a name; ``meta`` is a struct of ``META`` fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.text import entity_type, first_text, name_key
from strandwise.operators.rank import dense_ids, first_by

META = "title STRING, doc_id STRING, source STRING, evidence STRING, sent_idx INT, paragraph_idx INT"
META_FIELDS = tuple(x.split()[0] for x in META.split(", "))


def entity_name(*names: Column) -> Column:
    """The first of the given columns that isn't empty, such as name, surface and the value as text."""
    return first_text(*names)


def resolve_entities(mentions: DataFrame, order: list[str]) -> DataFrame:
    """Entities ``(id, name, type, nkey)`` from ``mentions(name, type, *order)``.

    Names with one key are one entity; ids follow the order of first mentions, whose name and type
    count.  Mentions without a key are none.
    """
    keyed = mentions.withColumn("nkey", name_key(F.col("name"))).filter("nkey <> ''")
    firsts = first_by(keyed, ["nkey"], [F.col(c) for c in order])
    return dense_ids(firsts, order, "id").select("id", "name", entity_type(F.col("type")).alias("type"), "nkey")


def dedupe_mentions(mentions: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first mention of each key in each group, such as the chunks of a title."""
    return first_by(mentions.withColumn("nkey", name_key(F.col("name"))).filter("nkey <> ''"), [group, "nkey"], [F.col(c) for c in order]).drop("nkey")


def link_triples(mentions: DataFrame, entities: DataFrame, order: list[str]) -> DataFrame:
    """Triples ``(triple_id, h, t, r, title, evidence)`` from ``mentions(head, relation, tail, title, evidence, *order)``.

    Of triples with equal ends, title and key of the relation, the first counts; ids follow its order.
    """
    ids = entities.select("nkey", "id")
    keyed = mentions.select("*", name_key(F.col("head")).alias("hk"), name_key(F.col("tail")).alias("tk"), name_key(F.col("relation")).alias("rk"))
    linked = keyed.join(ids.select(F.col("nkey").alias("hk"), F.col("id").alias("h")), "hk").join(ids.select(F.col("nkey").alias("tk"), F.col("id").alias("t")), "tk")
    firsts = first_by(linked, ["h", "t", "rk", "title"], [F.col(c) for c in order])
    return dense_ids(firsts, order, "triple_id").select("triple_id", "h", "t", F.col("relation").alias("r"), "title", "evidence")


def parse_triples(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """``triples`` from ``raw(triple_id, h, r, t, meta)`` whose ends are text.

    An end that is the number of an entity is that entity; any other is a name of its own without id.
    """
    names = entities.select(F.col("id").cast("string").alias("ref"), "id", "name")
    head = names.select(F.col("ref").alias("h"), F.col("id").alias("head_id"), F.col("name").alias("head_name"))
    tail = names.select(F.col("ref").alias("t"), F.col("id").alias("tail_id"), F.col("name").alias("tail_name"))
    return (
        raw.join(head, "h", "left")
        .join(tail, "t", "left")
        .select(
            "triple_id",
            "head_id",
            "tail_id",
            F.coalesce("r", F.lit("")).alias("relation"),
            F.coalesce("head_name", F.col("h").cast("string"), F.lit("None")).alias("head"),
            F.coalesce("tail_name", F.col("t").cast("string"), F.lit("None")).alias("tail"),
            "meta",
        )
    )


def endpoints(triples: DataFrame) -> DataFrame:
    """(eid, triple_id): each triple under each of its entities, once for a loop."""
    ends = F.array_distinct(F.filter(F.array("head_id", "tail_id"), lambda x: x.isNotNull()))
    return triples.select(F.explode(ends).alias("eid"), "triple_id")


def one_hop(entities: DataFrame, triples: DataFrame, key: str = "eid") -> DataFrame:
    """The rows of ``entities`` with the triple_id of every triple at ``key``; an equi-join."""
    ends = endpoints(triples)
    return entities.join(ends.withColumnRenamed("eid", key) if key != "eid" else ends, key)


def degrees(triples: DataFrame) -> DataFrame:
    return endpoints(triples).groupBy("eid").agg(F.count("*").alias("degree"))


def title_entities(listed: DataFrame, triples: DataFrame) -> DataFrame:
    """(title, entity_ids): sorted ids of the entities ``listed(title, id)`` and of the title's triples."""
    of_triples = triples.select("title", F.explode(F.array("h", "t")).alias("id"))
    return listed.select("title", "id").union(of_triples).groupBy("title").agg(F.sort_array(F.collect_set("id")).alias("entity_ids"))


def title_triples(triples: DataFrame) -> DataFrame:
    """(title, triple_idxs) in the order of triples."""
    return triples.groupBy("title").agg(F.sort_array(F.collect_list("triple_id")).alias("triple_idxs"))


def meta_struct(columns: dict[str, Column]) -> Column:
    """A meta struct with the given fields; the others are null."""
    kinds = dict(x.split() for x in META.split(", "))
    return F.struct(*[F.coalesce(columns.get(n, F.lit(None)).cast(kinds[n]), F.lit(None).cast(kinds[n])).alias(n) for n in META_FIELDS])
