"""Text that an evidence triple was taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.text import join_texts, lowered, plain, plain_in, text
from strandwise.operators.rank import first_by

FACT = ["qid", "qi", "place"]


def support_facts(evidence: DataFrame, support: DataFrame) -> DataFrame:
    """(qid, qi, place, triple_id, head, relation, tail, title) of a question's supported constraints.

    ``evidence(qid, idx, ...)`` numbers a question's triples; ``support(qid, qi, evidence_indices)`` names them in
    order.  Indices without a triple are skipped.
    """
    asked = support.select("qid", "qi", F.posexplode("evidence_indices").alias("place", "idx"))
    return asked.join(evidence, ["qid", "idx"]).select(*FACT, "triple_id", "head", "relation", "tail", "title")


def _asked(facts: DataFrame) -> DataFrame:
    return facts.select(*FACT, plain(F.col("head")).alias("__head"), plain(F.col("tail")).alias("__tail"), text(F.col("title")).alias("wanted"))


def _named() -> Column:
    """Does the text of a pair name both ends?  What is compared was made before fact and text met, once for each."""
    return plain_in(F.col("__head"), F.col("__low")) & plain_in(F.col("__tail"), F.col("__low"))


def _wanted() -> Column:
    return (F.col("wanted") == "") | (F.col("title") == F.col("wanted"))


def sentence_evidence(facts: DataFrame, units: DataFrame) -> DataFrame:
    """For each fact at most one row: title, paragraph_idx, sent_idx, context, evidence, similarity.

    ``units(qid, doc_idx, title, sent_idx, sent)``.  The first sentence that names both ends counts, with
    similarity 1: of the first document with the fact's title, or of any if the fact has none.  Failing
    that, the first sentence of the first document with the title that has any, with similarity 0.
    """
    docs = units.groupBy("qid", F.col("title").alias("wanted"), "doc_idx").agg(F.min("sent_idx").alias("sent_idx"))
    opening = F.when(F.col("sent_idx").isNotNull(), F.struct("doc_idx", "sent_idx"))
    titles = docs.groupBy("qid", "wanted").agg(F.min("doc_idx").alias("__first"), F.min(opening).alias("__opening"))
    asked = _asked(facts).join(titles, ["qid", "wanted"], "left")
    sentences = units.filter("sent_idx is not null").select("qid", "doc_idx", "title", "sent_idx", "sent", lowered(F.col("sent")).alias("__low"))
    hit = _named() & ((F.col("wanted") == "") | (F.col("doc_idx") == F.col("__first")))
    opens = (F.col("wanted") != "") & (F.col("doc_idx") == F.col("__opening.doc_idx")) & (F.col("sent_idx") == F.col("__opening.sent_idx"))
    # A question's sentences meet its facts once; beside hits only the sentence to fall back to stays.
    met = asked.join(sentences, "qid").filter(_wanted() & (hit | opens)).withColumn("hit", hit)
    best = first_by(met, FACT, [F.desc("hit"), F.col("doc_idx"), F.col("sent_idx")])
    score = F.when(F.col("hit"), 1.0).otherwise(0.0)
    return best.select(
        *FACT,
        "title",
        F.col("doc_idx").cast("int").alias("paragraph_idx"),
        F.when(F.col("hit"), F.col("sent_idx")).otherwise(0).cast("int").alias("sent_idx"),
        join_texts(F.col("title"), F.col("sent")).alias("context"),
        F.col("sent").alias("evidence"),
        score.alias("similarity"),
        score.alias("sentence_similarity"),
    )


def paragraph_evidence(facts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """For each fact at most one paragraph of ``paragraphs(qid, ord, idx, title, text)``: the first that names both
    ends, among those with the fact's title if it has one."""
    texts = paragraphs.select("qid", "ord", "idx", "title", "text", lowered(F.col("text")).alias("__low"))
    met = _asked(facts).join(texts, "qid").filter(_wanted() & _named())
    best = first_by(met.select(*FACT, "title", "ord", "idx", "text"), FACT, [F.col("ord")])
    return best.select(
        *FACT,
        "title",
        F.col("idx").cast("int").alias("paragraph_idx"),
        F.lit(0).alias("sent_idx"),
        F.col("text").alias("context"),
        F.lit("").alias("evidence"),
        F.lit(1.0).alias("similarity"),
        F.lit(1.0).alias("sentence_similarity"),
    )
