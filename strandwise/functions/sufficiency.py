"""How many candidates share the evidence, and whether that settles a constraint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 1e-6


def effective_number(logits: Column) -> Column:
    """Inverse sum of squared shares of ``logits`` (in a fixed order); infinite without any.

    Logits are shifted to be positive if the least isn't.
    """
    least = F.array_min(logits)
    weights = F.when(least <= 0, F.transform(logits, lambda x: x - least + SHIFT)).otherwise(logits)
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(F.transform(weights, lambda w: F.try_divide(w, total) * F.try_divide(w, total)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(logits) > 0) & (total > 0), F.try_divide(F.lit(1.0), squares)).otherwise(F.lit(float("inf")))


def resolved(number: Column, threshold: float) -> Column:
    return F.coalesce(number <= F.lit(float(threshold)), F.lit(False)) & ~F.isnan(number)
