"""A knowledge graph over the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.kg import link_triples, meta_struct, resolve_entities
from strandwise.sources.kg_sources import Graph
from strandwise.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions (kind, k, name, type) in a fixed order."""
    # Kind, table, key, name, type.
    parts = (
        (0, "region", "r_regionkey", "r_name", "LOC"),
        (1, "nation", "n_nationkey", "n_name", "LOC"),
        (2, "supplier", "s_suppkey", "s_name", "ORG"),
        (3, "customer", "c_custkey", "c_name", "PERSON"),
        (4, "part", "p_partkey", "p_name", "OTHER"),
        (5, "part", "p_partkey", "p_brand", "ORG"),
        (6, "customer", "c_custkey", "c_mktsegment", "OTHER"),
    )
    out = None
    for kind, name, key, text, type_ in parts:
        one = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("k"), F.col(text).alias("name"), F.lit(type_).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions (src, k, head, relation, tail, title, evidence) in a fixed order."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    row = lambda df, src, key, head, relation, tail, title: df.select(
        F.lit(src).alias("src"), F.col(key).cast("long").alias("k"), F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit(title).alias("title"), F.lit("").alias("evidence")
    )
    parts = [
        row(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), 0, "n_nationkey", "n_name", "located in region", "r_name", "nation"),
        row(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), 1, "s_suppkey", "s_name", "based in nation", "n_name", "supplier"),
        row(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), 2, "c_custkey", "c_name", "lives in nation", "n_name", "customer"),
        row(t("customer"), 3, "c_custkey", "c_name", "belongs to segment", "c_mktsegment", "customer"),
        row(t("part"), 4, "p_partkey", "p_name", "made by brand", "p_brand", "part"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_entities(surfaces(spark, sf_dir), ["kind", "k"])


def links(spark: SparkSession, sf_dir: str, ents: DataFrame | None = None) -> DataFrame:
    return link_triples(relations(spark, sf_dir), ents if ents is not None else entities(spark, sf_dir), ["src", "k"])


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    ws = Workspace(spark, "graph")
    ents = ws.save(entities(spark, sf_dir), "entities")
    rows = links(spark, sf_dir, ents)
    named = ents.select("id", "name")
    triples = (
        rows.join(named.select(F.col("id").alias("h"), F.col("name").alias("head")), "h")
        .join(named.select(F.col("id").alias("t"), F.col("name").alias("tail")), "t")
        .select("triple_id", F.col("h").alias("head_id"), F.col("t").alias("tail_id"), F.col("r").alias("relation"), "head", "tail", meta_struct({"title": F.col("title")}).alias("meta"))
    )
    return Graph(ents, ws.save(triples, "triples"))
