from pyspark.sql import functions as F

from strandwise.operators import provenance


def test_texts_meet_facts_once_and_are_not_rewritten(spark):
    n = F.col("id").cast("int")
    facts = spark.range(4).select((F.col("id") * 0).alias("qid"), n.alias("qi"), F.lit(0).alias("place"), F.lit("Ada Moor").alias("head"), F.lit("Rail!").alias("tail"), F.concat(F.lit(""), F.element_at(F.array(*map(F.lit, ["A", "", "B", "C"])), n + 1)).alias("title"))
    texts = spark.range(3).select((F.col("id") * 0).alias("qid"), n.alias("at"), F.element_at(F.array(*map(F.lit, ["A", "B", "A"])), n + 1).alias("title"), F.element_at(F.array(*map(F.lit, ["ada", "rail", "ADA, Moor: rail"])), n + 1).alias("text"))
    paragraphs = provenance.paragraph_evidence(facts, texts.select("qid", F.col("at").alias("ord"), F.col("at").alias("idx"), "title", "text"))
    sentences = provenance.sentence_evidence(facts, texts.select("qid", F.col("at").alias("doc_idx"), "title", F.lit(0).alias("sent_idx"), F.col("text").alias("sent")))
    assert sorted((r.qi, r.title, r.paragraph_idx, r.similarity) for r in paragraphs.collect()) == [(0, "A", 2, 1.0), (1, "A", 2, 1.0)]
    assert sorted((r.qi, r.title, r.paragraph_idx, r.similarity) for r in sentences.collect()) == [(0, "A", 0, 0.0), (1, "A", 2, 1.0), (2, "B", 1, 0.0)]
    for df, column, joins in ((paragraphs, "text", 1), (sentences, "sent", 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins and f"regexp_replace(lower({column}" not in plan
