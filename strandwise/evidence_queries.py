"""Queries of the operators that find text for facts and questions, and hold it against gold, over lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions import text as X
from strandwise.functions.similarity import LEXICAL
from strandwise.operators import metrics, provenance, recovery
from strandwise.plans import evaluation, star

#: Documents of one question.
GROUP = 3
SETTINGS = Settings(recall_ks=(2, 5))
# Surfaces with a variable's candidates and the graph's names.
ENDS = (
    ("e0", "?x", ["Ada Moor", "ada moor", " ", "Bo Lind", "C", "D", "E", "F", "G"], []),
    ("e1", "Turin ", [], ["turin", "Torino", "Turin (city)"]),
    ("e2", "", ["x"], ["y"]),
    ("e3", "Milan", [], []),
    ("e4", "?y", [], ["z"]),
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in questions of three: (qid, doc_idx, title, sent_idx, raw_sent_idx, sent)."""
    docs = star.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / GROUP).alias("qid"), (F.col("doc_id") % GROUP).cast("int").alias("doc_idx"), F.concat(F.lit("t"), F.col("doc_id") % 2).alias("title"), "text")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("raw_sent_idx"), X.text(s).alias("sent"))), lambda x: x["sent"] != "")
    return docs.select("qid", "doc_idx", "title", F.posexplode(kept).alias("sent_idx", "s")).select("qid", "doc_idx", "title", "sent_idx", "s.raw_sent_idx", "s.sent")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").filter(X.text(F.col("text")) != "")
    return docs.select(F.floor(F.col("doc_id") / GROUP).alias("qid"), (F.col("doc_id") % GROUP).cast("int").alias("ord"), (F.col("doc_id") % GROUP + 10).cast("int").alias("idx"), F.concat(F.lit("t"), F.col("doc_id") % 2).alias("title"), X.text(F.col("text")).alias("text"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three facts of each line that is a document's second, of which the support names two and one that isn't there:
    its first and last word, with its title or without, and a name that nothing has."""
    own = lines(spark, sf_dir).filter("sent_idx = 1").withColumn("w", F.split("sent", " "))
    fact = lambda idx, tail, title: F.struct(F.lit(idx).alias("idx"), F.col("w")[0].alias("head"), tail.alias("tail"), title.alias("title"))
    last = F.element_at("w", -1)
    rows = own.select("qid", "doc_idx", F.inline(F.array(fact(0, last, F.col("title")), fact(1, last, F.lit("")), fact(2, F.lit("#nowhere#"), F.col("title")))))
    evidence = rows.select("qid", (F.col("doc_idx") * 3 + F.col("idx")).alias("idx"), F.col("idx").cast("long").alias("triple_id"), "head", F.lit("r").alias("relation"), "tail", "title")
    support = own.select("qid", F.col("doc_idx").alias("qi"), F.array(F.col("doc_idx") * 3 + 2, F.lit(99), F.col("doc_idx") * 3, F.col("doc_idx") * 3 + 1).alias("evidence_indices"))
    return provenance.support_facts(evidence, support)


_EVIDENCE = ("qid", "qi", "place", "title", "paragraph_idx", "sent_idx", "similarity")


def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.sentence_evidence(_facts(spark, sf_dir), lines(spark, sf_dir))
    return found.select(*_EVIDENCE, F.md5("evidence").alias("digest"))


def paragraph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.paragraph_evidence(_facts(spark, sf_dir), paragraphs(spark, sf_dir))
    return found.select(*_EVIDENCE, F.md5("context").alias("digest"))


def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ENDS, "qid string, surface string, bound array<string>, mapped array<string>")
    return rows.select("qid", F.posexplode(recovery.candidate_names(F.col("surface"), F.col("bound"), F.col("mapped"))).alias("place", "name"))


def paragraph_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each question that are most like its documents' second lines."""
    asked = lines(spark, sf_dir).filter("sent_idx = 1").select("qid", F.col("doc_idx").alias("qi"), F.array(X.squeeze(F.col("sent"))).alias("query_texts"))
    asked = asked.withColumn("rerank_query", recovery.rerank_query(F.lit("Which?"), F.col("query_texts")))
    found = recovery.recover_paragraphs(asked, paragraphs(spark, sf_dir), LEXICAL, LEXICAL, SETTINGS)
    return found.select("qid", "qi", "place", "title", "paragraph_idx", F.round("similarity", 6).alias("similarity"))


def gold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting facts as lists of texts: numbers, repeats, and facts that lack a number."""
    n = star.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("qid"), "s_nationkey")
    number = F.col("s_nationkey").cast("string")
    facts = F.array(F.array(F.lit(" a  b "), number), F.array(F.lit("a b"), number), F.array(F.lit("c"), F.lit("x")), F.array(F.lit("d")), F.array(F.lit("c"), F.lit("0")))
    steps = F.array(*[F.struct(x.cast("int").alias("paragraph_support_idx")) for x in (F.col("s_nationkey"), F.lit(None), F.col("s_nationkey"), F.lit(3))])
    both = metrics.gold_sentences(n.select("qid", facts.alias("supporting_facts"))).withColumn("kind", F.lit("s"))
    both = both.unionByName(metrics.gold_paragraphs(n.select("qid", steps.alias("question_decomposition"))).withColumn("kind", F.lit("p")))
    return both.select("qid", "kind", "unit.title", "unit.idx")


def _unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle words of each document's second line, with its title or without, as evidence that has lost its place."""
    own = lines(spark, sf_dir).filter("sent_idx = 1").withColumn("w", F.split("sent", " "))
    cut = F.array_join(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(1))), " ")
    return own.select("qid", F.col("doc_idx").alias("qi"), F.lit(0).alias("place"), F.when(F.col("doc_idx") == 0, "").otherwise(F.col("title")).alias("title"), cut.alias("evidence"))


def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _unplaced(spark, sf_dir).withColumn("ask", F.col("qi"))
    found = metrics.best_sentence(asked.select("qid", "ask", "title", "evidence"), lines(spark, sf_dir))
    return found.select("qid", "ask", "title", "sent_idx", F.round("score", 6).alias("score"))


def best_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _unplaced(spark, sf_dir).withColumn("ask", F.col("qi"))
    found = metrics.best_paragraph(asked.select("qid", "ask", F.when(F.col("ask") == 1, "t9").otherwise(F.col("title")).alias("title"), "evidence"), paragraphs(spark, sf_dir))
    return found.select("qid", "ask", "idx", F.round("score", 6).alias("score"))


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro recall of gold lines by evidence that is matched to lines again, and the scores of answers."""
    evidences = _unplaced(spark, sf_dir).select("*", F.lit(None).cast("int").alias("paragraph_idx"), F.lit(None).cast("int").alias("sent_idx"), F.lit("").alias("context"), F.lit(0.5).alias("similarity"))
    texts = lines(spark, sf_dir)
    settings = Settings(dataset="hotpotqa", recall_ks=(1, 2))
    units = evaluation.units_of(evidences, texts, settings)
    # Gold is the second line of every document, and the first of the last.
    gold = texts.filter("raw_sent_idx = 1 or (raw_sent_idx = 0 and doc_idx = 2)").select("qid", metrics.unit_key(F.col("title"), F.col("raw_sent_idx")).alias("unit")).distinct()
    questions = texts.select("qid").distinct()
    recalls = metrics.recall(questions, gold, units, settings)
    scored = questions.select("qid", (F.col("qid") % 2).cast("double").alias("em"), (F.col("qid") % 4 / 4).alias("f1"))
    rate = lambda c: F.round(F.col(f"`{c}`"), 6)
    out = metrics.summary(scored, recalls, settings)
    return out.select("n", rate("em").alias("em"), rate("f1").alias("f1"), "n_with_gold", *[rate(f"{k}_{r}").alias(f"{k}_{r}".replace("@", "_")) for k in ("micro", "macro") for r in ("recall@1", "recall@2", "recall_all")])


QUERIES = {
    f.__name__: f
    for f in (sentence_evidence, paragraph_evidence, candidate_names, paragraph_recovery, gold_units, best_sentences, best_paragraphs, retrieval_summary)
}

_DOCS = f"""
doc as (select doc_id // {GROUP} as qid, cast(doc_id % {GROUP} as int) as doc_idx, 't' || doc_id % 2 as title, text from documents),
raw as (select qid, doc_idx, title, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as raw from doc),
line as (select qid, doc_idx, title, raw, trim(s, ' ' || chr(9) || chr(10) || chr(13)) as sent, row_number() over (partition by qid, doc_idx order by raw) - 1 as sent_idx from raw where trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
para as (select qid, doc_idx as ord, doc_idx + 10 as idx, title, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text from doc where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
second as (select *, string_split(sent, ' ') as w from line where sent_idx = 1),
fact as (
  select qid, doc_idx as qi, unnest([0, 2, 3]) as place, w[1] as head, unnest(['#nowhere#', w[len(w)], w[len(w)]]) as tail, unnest([title, title, '']) as wanted from second)"""


def sql(plain, lexical, squeeze, answer, token_list, once) -> dict[str, str]:
    """The arguments give SQL of text functions."""
    hit = lambda body: f"{plain('head')} <> '' and {plain('tail')} <> '' and contains({plain(body)}, {plain('head')}) and contains({plain(body)}, {plain('tail')})"
    ends = ", ".join("(" + ", ".join([f"'{q}'", f"'{s}'", *["[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (b, m)]]) + ")" for q, s, b, m in ENDS)
    # Answer F1 of an evidence e and a text s, from their token lists.
    same = "list_sum(list_transform(list_distinct(et), lambda t: least(len(list_filter(et, lambda z: z = t)), len(list_filter(st, lambda z: z = t)))))"
    score = f"""case when ek <> '' and sk <> '' and (contains(sk, ek) or contains(ek, sk)) then 1.0 else 0.0 end
      + case when e = '' or s = '' or len(et) = 0 or len(st) = 0 or coalesce({same}, 0) = 0 then 0.0 else 2 * ({same} / len(et)) * ({same} / len(st)) / ({same} / len(et) + {same} / len(st)) end"""
    lost = f"""{_DOCS},
      lost as (select qid, doc_idx as ask, case when doc_idx = 0 then '' else title end as wanted, array_to_string(w[2:1 + greatest(len(w) - 2, 1)], ' ') as e from second)"""
    sentence = f"""{lost},
      met as (select lost.*, title, doc_idx, raw, sent as s, {answer('e')} as ek, {answer('sent')} as sk, {token_list('e')} as et, {token_list('sent')} as st from lost join line using (qid) where wanted = '' or title = wanted),
      best as (select *, {score} as score from met where {score} > 0 qualify row_number() over (partition by qid, ask order by {score} desc, doc_idx, raw) = 1)"""
    return {
        "sentence_evidence": f"""with {_DOCS},
          first as (select qid, title as wanted, min(doc_idx) as first_doc from line group by all),
          met as (
            select f.*, title, doc_idx, sent_idx, sent, ({hit('sent')}) and doc_idx = first_doc as hit from fact f join first using (qid, wanted) join line on line.qid = f.qid and line.title = wanted where wanted <> ''
            union all select f.*, title, doc_idx, sent_idx, sent, true from fact f join line using (qid) where wanted = '' and {hit('sent')}),
          best as (select * from met qualify row_number() over (partition by qid, qi, place order by hit desc, doc_idx, sent_idx) = 1)
          select qid, qi, place, title, doc_idx as paragraph_idx, case when hit then cast(sent_idx as int) else 0 end as sent_idx, case when hit then 1.0 else 0.0 end as similarity, md5(sent) as digest from best""",
        "paragraph_evidence": f"""with {_DOCS},
          met as (select f.*, title, ord, idx, text from fact f join para using (qid) where (wanted = '' or title = wanted) and {hit('text')})
          select qid, qi, place, title, idx as paragraph_idx, 0 as sent_idx, 1.0 as similarity, md5(text) as digest from met qualify row_number() over (partition by qid, qi, place order by ord) = 1""",
        "candidate_names": f"""with e as (select * from (values {ends}) v(qid, surface, bound, mapped)),
          n as (select qid, case when trim(surface) like '?%' then {once('bound')}[1:5] when trim(surface) = '' then [] else {once('list_concat([surface], mapped)')} end as names from e)
          select qid, generate_subscripts(names, 1) - 1 as place, unnest(names) as name from n""",
        "paragraph_recovery": f"""with {_DOCS},
          met as (select p.qid, doc_idx as qi, p.title, ord, idx, p.text, {squeeze('sent')} as q, concat_ws(' ', p.title, p.text) as body from second join para p on p.qid = second.qid),
          over20 as (select *, {lexical('q', 'body')} as score, row_number() over (partition by qid, qi order by {lexical('q', 'body')} desc, ord) as cr from met qualify cr <= 20),
          fin as (select *, {lexical("'question: Which? constraint: ' || q", 'text')} as logit from over20)
          select qid, qi, row_number() over (partition by qid, qi order by logit desc, cr) - 1 as place, title, idx as paragraph_idx, round(logit, 6) as similarity from fin qualify place < {SETTINGS.topk_unresolved}""",
        "gold_units": """select cast(s_suppkey as varchar) as qid, 's' as kind, unnest(['a b', 'c']) as title, unnest([cast(s_nationkey as int), 0]) as idx from supplier
          union select cast(s_suppkey as varchar), 'p', '', unnest([cast(s_nationkey as int), 3]) from supplier""",
        "best_sentences": f"with {sentence} select qid, ask, title, cast(raw as int) as sent_idx, round(score, 6) as score from best",
        "best_paragraphs": f"""with {lost},
          ask2 as (select qid, ask, case when ask = 1 then 't9' else wanted end as wanted, e from lost),
          met as (select a.qid, a.ask, ord, idx, a.e, p.text as s, {answer('a.e')} as ek, {answer('p.text')} as sk, {token_list('a.e')} as et, {token_list('p.text')} as st
            from ask2 a join para p on p.qid = a.qid where wanted = '' or title = wanted or not exists (select 1 from para z where z.qid = a.qid and z.title = wanted))
          select qid, ask, idx, round({score}, 6) as score from met where {score} > 0 qualify row_number() over (partition by qid, ask order by {score} desc, ord) = 1""",
        "retrieval_summary": f"""with {sentence},
          unit as (select qid, ask as qi, title, raw from best qualify row_number() over (partition by qid, title, raw order by ask) = 1),
          pred as (select *, row_number() over (partition by qid order by qi) as pos from unit),
          gold as (select distinct qid, title, raw from line where raw = 1 or (raw = 0 and doc_idx = 2)),
          q as (select distinct qid from line),
          per as (
            select qid, case when exists (select 1 from pred where pred.qid = q.qid) then (select count(*) from gold where gold.qid = q.qid) else 0 end as total,
              (select count(*) from pred join gold using (qid, title, raw) where qid = q.qid and pos <= 1) as h1, (select count(*) from pred join gold using (qid, title, raw) where qid = q.qid and pos <= 2) as h2,
              (select count(*) from pred join gold using (qid, title, raw) where qid = q.qid) as ha from q)
          select (select count(*) from q) as n, (select round(avg(qid % 2), 6) from q) as em, (select round(avg(qid % 4 / 4), 6) from q) as f1, count(*) as n_with_gold,
            round(sum(h1) / sum(total), 6) as micro_recall_1, round(sum(h2) / sum(total), 6) as micro_recall_2, round(sum(ha) / sum(total), 6) as micro_recall_all,
            round(avg(h1 / total), 6) as macro_recall_1, round(avg(h2 / total), 6) as macro_recall_2, round(avg(ha / total), 6) as macro_recall_all from per where total > 0""",
    }
