"""Documents to packed sequences, with the operators of strandwise.llm.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps, with their
columns, extra ones among them (names that begin with two underscores are the operators'); the last returns the
pieces of the packed sequences.
``n_chars`` follows the text.

Texts that are null, empty or without a letter go in the first stage.  Rows that repeat an id stay rows, judged by
their own texts; of near copies with one id all those that have the smallest id stay.  Null ids are never held
out from learning, and count as larger than all others.  Ties are the operators'.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import language_id, line_dedup, minhash_dedup, packing, suffix_dedup
from strandwise.llm.workspace import Workspace

LEAST_SCORE = 0.5


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that scores LEAST_SCORE, go."""
    return language_id.accepted(docs, LEAST_SCORE)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay."""
    return _counted(line_dedup.drop_lines(spark, docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash_dedup.one_of_each(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has in a run of 50 go; documents of nothing else go."""
    return _counted(suffix_dedup.without_repeats(spark, docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences."""
    return packing.best_fit_packing(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: Minimum hashes, suffixes and tokens have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
