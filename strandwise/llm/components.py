"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregate by node (combined before the shuffle) and a join on nodes, so neither a
hub nor a component that has a third of all nodes has to fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, both.u == least.c).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(ws: Workspace, edges: DataFrame, name: str = "stars", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every other node that has an edge."""
    now = ws.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}0")
    mark = None
    for k in range(1, rounds + 1):
        after = ws.save(_small_star(_large_star(now)), f"{name}{k}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}{k - 1}")
        now = after
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
