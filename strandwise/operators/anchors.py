"""Entities that a constraint's known ends may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.similarity import ratio
from strandwise.functions.text import is_var, tokens
from strandwise.operators.rank import first_by, top


def candidates(surfaces: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, eid, name) of all names that share a token with a surface; an equi-join on tokens."""
    left = surfaces.select("surface").distinct().select("surface", F.explode(tokens(F.col("surface"))).alias("token"))
    right = entities.select(F.col("id").alias("eid"), "name", F.explode(tokens(F.col("name"))).alias("token"))
    return left.join(right, "token").select("surface", "eid", "name").distinct()


def match_surfaces(surfaces: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """(surface, eid, name, score, rank): the ``k`` most similar names; ties go to the larger id."""
    scored = candidates(surfaces, entities).withColumn("score", ratio(F.col("surface"), F.col("name")))
    return top(scored, ["surface"], [F.desc("score"), F.desc("eid")], k)


def known_surfaces(constraints: DataFrame) -> DataFrame:
    """(qid, surface): each question's ends that are no variables, once."""
    ends = constraints.select("qid", F.explode(F.array("head", "tail")).alias("surface"))
    return ends.filter((F.col("surface") != "") & ~is_var(F.col("surface"))).distinct()


def assemble(constraints: DataFrame, matches: DataFrame) -> DataFrame:
    """(qid, qi, eid, pos): a constraint's anchors, those of the head first, each once."""
    sides = constraints.select("qid", "qi", F.posexplode(F.array("head", "tail")).alias("side", "surface")).filter(~is_var(F.col("surface")))
    found = sides.join(matches.select("surface", "eid", "rank"), "surface")
    once = first_by(found, ["qid", "qi", "eid"], [F.col("side"), F.col("rank")])
    return once.select("qid", "qi", "eid", (F.col("side") * 1_000_000 + F.col("rank")).alias("pos"))


def constraint_type(head: Column, tail: Column, anchored: Column) -> Column:
    h, t = is_var(head), is_var(tail)
    return F.when(h & t, "double_var").when((h | t) & anchored, "single_var_with_anchor").when(~h & ~t & anchored, "no_var_with_anchor").otherwise("no_anchor")


def with_types(constraints: DataFrame, anchors: DataFrame) -> DataFrame:
    """``constraints`` with triple_type."""
    has = anchors.select("qid", "qi").distinct().withColumn("__has", F.lit(True))
    joined = constraints.join(has, ["qid", "qi"], "left")
    return joined.withColumn("triple_type", constraint_type(F.col("head"), F.col("tail"), F.coalesce("__has", F.lit(False)))).drop("__has")


def alias_anchors(bound: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """(eid, anchor): a bound entity and the entities whose names are most like its own."""
    named = bound.select("eid").distinct().join(entities.select(F.col("id").alias("eid"), F.col("name").alias("surface")), "eid")
    similar = match_surfaces(named, entities, k).select("surface", F.col("eid").alias("anchor"))
    return named.select("eid", F.col("eid").alias("anchor")).union(named.join(similar, "surface").select("eid", "anchor")).distinct()
