"""Top rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.workspace import Workspace


def top(rows: DataFrame, by: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, numbered from 1.

    The filter on the row number lets each task keep k rows of a group before the shuffle, so a group
    of any size is cheap.
    """
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(into) <= F.lit(k))


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return top(rows, by, order, 1, "__first").drop("__first")


def dense_ids(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """Numbers rows 0, 1, ... in ``order`` without sending all rows to one task.

    Rows are dealt by range, sorted and written once with their place in their task; a task's first number is
    the count of the rows before it, one row a task.  ``order`` has to tell all rows apart.
    """
    ws = Workspace(rows.sparkSession, "ids")
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = ws.save(dealt, "dealt").withColumn("__part", F.shiftright("__at", 33))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    # As many rows as tasks.
    numbered = dealt.join(F.broadcast(starts), "__part")
    place = F.col("__at") - F.shiftleft("__part", 33)
    return numbered.withColumn(into, (F.col("__before") + place).cast("long")).drop("__part", "__at", "__n", "__before")
