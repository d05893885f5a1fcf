"""Page corpora ``(title, text, ord)`` from question sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.text import clean_list, text
from strandwise.operators.rank import first_by
from strandwise.sources.json_sources import LIST_KEYS, PARAGRAPH_EXAMPLE, SENTENCE_EXAMPLE, context_docs, read_list, take

_ORDER = ["pos", "doc_idx"]


def _first_titles(docs: DataFrame) -> DataFrame:
    firsts = first_by(docs, ["title"], [F.col(c) for c in _ORDER])
    return firsts.select("title", "text", (F.col("pos") * 1_000_000 + F.col("doc_idx")).alias("ord"))


def sentence_pages(examples: DataFrame, num: int | None = None, stripped: bool = False) -> DataFrame:
    """The first document of each title, its sentences joined by spaces; ``stripped`` ones without blank ones."""
    docs = context_docs(take(examples, num).withColumn("qid", F.lit(None).cast("string"))).filter("title is not null and title <> ''")
    none = F.array().cast("array<string>")
    sents = clean_list(F.col("sents")) if stripped else F.coalesce("sents", none)
    return _first_titles(docs.withColumn("text", F.array_join(sents, " ")))


def paragraph_pages(examples: DataFrame, num: int | None = None) -> DataFrame:
    """All distinct paragraphs of each title, in order, parted by blank lines."""
    rows = take(examples, num).select("pos", F.posexplode("paragraphs").alias("doc_idx", "p"))
    own = rows.select("pos", "doc_idx", text(F.col("p.title")).alias("title"), text(F.col("p.paragraph_text")).alias("text")).filter("title <> '' and text <> ''")
    once = first_by(own, ["title", "text"], [F.col(c) for c in _ORDER]).withColumn("ord", F.col("pos") * 1_000_000 + F.col("doc_idx"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return once.groupBy("title").agg(F.array_join(listed, "\n\n").alias("text"), F.min("ord").alias("ord"))


def load_pages(spark: SparkSession, path: str, num: int | None = None) -> tuple[DataFrame, str]:
    """Pages of a set whose kind its first example shows, and the kind."""
    probe = read_list(spark, path, "context STRING, paragraphs STRING", LIST_KEYS).orderBy("pos").limit(1).collect()
    if probe and probe[0]["context"] is not None:
        return sentence_pages(read_list(spark, path, SENTENCE_EXAMPLE, LIST_KEYS), num, stripped=True), "hotpotqa"
    if probe and probe[0]["paragraphs"] is not None:
        return paragraph_pages(read_list(spark, path, PARAGRAPH_EXAMPLE, LIST_KEYS), num), "musique"
    raise ValueError(f"{path}: neither contexts nor paragraphs")


def merge_pages(inputs: list[DataFrame]) -> DataFrame:
    """Pages of several inputs; of equal titles the first input's counts."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__input", F.lit(k)) for k, p in enumerate(inputs)])
    firsts = first_by(every, ["title"], [F.col("__input"), F.col("ord")])
    return firsts.select("title", "text", F.struct("__input", "ord").alias("ord"))


def first_pages(pages: DataFrame, num: int | None) -> DataFrame:
    """The first ``num`` pages in order."""
    if num is None:
        return pages
    return pages.orderBy("ord").limit(num)
