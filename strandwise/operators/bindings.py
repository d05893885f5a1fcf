"""What selected triples bind a constraint's variable to, and how constraints agree on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.text import is_var
from strandwise.operators.retrieve import KEY


def single_variable(head: Column, tail: Column) -> Column:
    """The variable of a constraint with exactly one, else null."""
    return F.when(is_var(head) & ~is_var(tail), head).when(is_var(tail) & ~is_var(head), tail)


def opposite(selected: DataFrame, anchors: DataFrame) -> DataFrame:
    """``selected`` with ``eid``, the entity across from an anchor that is no anchor itself, or null."""
    heads = anchors.select(*KEY, F.col("eid").alias("head_id"), F.lit(True).alias("h_in"))
    tails = anchors.select(*KEY, F.col("eid").alias("tail_id"), F.lit(True).alias("t_in"))
    flagged = selected.join(heads, [*KEY, "head_id"], "left").join(tails, [*KEY, "tail_id"], "left")
    return flagged.withColumn("eid", F.when(F.col("h_in") & F.col("t_in").isNull(), F.col("tail_id")).when(F.col("t_in") & F.col("h_in").isNull(), F.col("head_id"))).drop("h_in", "t_in")


def induce(tasks: DataFrame, selected: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, var, eid): entities that tasks with one variable bind it to, each once."""
    variables = tasks.select(*KEY, single_variable(F.col("head"), F.col("tail")).alias("var")).filter("var is not null")
    return opposite(selected, anchors).filter("eid is not null").join(variables, KEY).select(*KEY, "var", "eid").distinct()


def consolidate(induced: DataFrame) -> DataFrame:
    """(qid, var, eid, in_binding, in_intersection, n_sets, method) of the entities of all sets.

    A set is what one task induces.  With two or more sets that share an entity the binding is their
    intersection, else their union.
    """
    sets = induced.select("qid", "var", F.struct(*KEY[1:]).alias("task"), "eid")
    n = sets.groupBy("qid", "var").agg(F.count_distinct("task").alias("n_sets"))
    counts = sets.groupBy("qid", "var", "eid").agg(F.count_distinct("task").alias("k")).join(n, ["qid", "var"])
    shared = F.max((F.col("k") == F.col("n_sets")).cast("int")).over(Window.partitionBy("qid", "var")) == 1
    rows = counts.withColumn("several", F.col("n_sets") > 1).withColumn("shared", shared)
    meets = F.col("several") & F.col("shared")
    return rows.select(
        "qid",
        "var",
        "eid",
        (~meets | (F.col("k") == F.col("n_sets"))).alias("in_binding"),
        (F.col("several") & (F.col("k") == F.col("n_sets"))).alias("in_intersection"),
        "n_sets",
        F.when(meets, "intersection").otherwise("union").alias("method"),
    )


def bound(consolidated: DataFrame) -> DataFrame:
    """(qid, var, eid) of the bindings."""
    return consolidated.filter("in_binding").select("qid", "var", "eid")


def summarize(consolidated: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, var, binding_ids, binding_names, method, union_ids, intersection_ids), ids ascending."""
    named = consolidated.join(entities.select(F.col("id").alias("eid"), "name"), "eid", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("in_binding"), F.struct("eid", "name"))))
    rows = named.groupBy("qid", "var").agg(
        kept.alias("kept"),
        F.first("method").alias("method"),
        F.first("n_sets").alias("n_sets"),
        F.sort_array(F.collect_list("eid")).alias("union_ids"),
        F.sort_array(F.collect_list(F.when(F.col("in_intersection"), F.col("eid")))).alias("both"),
    )
    return rows.select(
        "qid",
        "var",
        F.transform("kept", lambda x: x["eid"]).alias("binding_ids"),
        F.filter(F.transform("kept", lambda x: x["name"]), lambda x: x.isNotNull()).alias("binding_names"),
        "method",
        "union_ids",
        F.when(F.col("n_sets") > 1, F.col("both")).alias("intersection_ids"),
    )


def filter_by_binding(tasks: DataFrame, selected: DataFrame, anchors: DataFrame, bindings: DataFrame) -> DataFrame:
    """The selected triples of tasks with one variable whose other entity the variable is bound to."""
    variables = tasks.select(*KEY, single_variable(F.col("head"), F.col("tail")).alias("var")).filter("var is not null")
    rows = opposite(selected, anchors).join(variables, KEY)
    return rows.join(bindings.select("qid", "var", "eid"), ["qid", "var", "eid"], "left_semi")
