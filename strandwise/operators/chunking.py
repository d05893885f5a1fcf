"""Chunks of texts: paragraphs packed in order up to a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.text import clean_list


def chunks(body: Column, max_chars: int) -> Column:
    """Array of chunks of ``body``; a paragraph that is longer alone is not split."""
    paragraphs = clean_list(F.split(F.coalesce(body, F.lit("")), r"\n{2,}"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, p: Column) -> Column:
        held = acc["held"]
        return (
            F.when(held == "", F.struct(acc["done"].alias("done"), p.alias("held")))
            .when(F.length(held) + 2 + F.length(p) <= max_chars, F.struct(acc["done"].alias("done"), F.concat(held, F.lit("\n\n"), p).alias("held")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(held)).alias("done"), p.alias("held")))
        )

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))


def chunk_pages(pages: DataFrame, max_chars: int) -> DataFrame:
    """(title, ord, chunk_idx, chunk) of ``pages(title, text, ord)``."""
    return pages.select("title", "ord", F.posexplode(chunks(F.col("text"), max_chars)).alias("chunk_idx", "chunk"))
