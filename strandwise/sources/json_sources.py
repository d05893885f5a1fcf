"""Question sets, query plans and their writers.

JSON lines are read line by line, and a JSON list item by item, a file being one task; an object that has the list
under a key is one row while it is read.  Convert large sets of those to Parquet or JSON lines once (``write_lines``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.text import distinct_exact, distinct_ignoring_case, first_text, text
from strandwise.operators.rank import dense_ids, first_by

# Names of keys in question sets and plans.
LIST_KEYS = ("data", "examples", "items", "questions")
CONSTRAINT = "STRUCT<head: STRING, tail: STRING, relation_variants: ARRAY<STRING>>"
SENTENCE_EXAMPLE = "_id STRING, id STRING, qid STRING, question STRING, answer STRING, context ARRAY<STRING>, contexts ARRAY<STRING>, supporting_facts ARRAY<ARRAY<STRING>>"
PARAGRAPH_EXAMPLE = (
    "id STRING, _id STRING, qid STRING, question STRING, answer STRING, "
    "paragraphs ARRAY<STRUCT<idx: INT, title: STRING, paragraph_text: STRING>>, question_decomposition ARRAY<STRUCT<paragraph_support_idx: INT>>"
)
PLAN = (
    "id STRING, _id STRING, qid STRING, question STRING, ground_truth_answer STRING, answer STRING, "
    f"query_plan ARRAY<{CONSTRAINT}>, query_triples ARRAY<{CONSTRAINT}>, triples ARRAY<{CONSTRAINT}>, "
    f"query_graph STRUCT<query_plan: ARRAY<{CONSTRAINT}>, triples: ARRAY<{CONSTRAINT}>>"
)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole-file JSON document, one row per top-level object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def _in_place(rows: DataFrame) -> DataFrame:
    """``rows`` read from files, with ``pos``, their place in the order of files and of rows in a file."""
    marked = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return dense_ids(marked, ["__file", "__block", "__row"], "pos").drop("__file", "__block", "__row")


def _is_line(head: str, keys: tuple[str, ...]) -> bool:
    """Is this first line of a file a whole object that has no list under any of ``keys``?"""
    try:
        found = json.loads(head)
    except ValueError:
        return False
    return isinstance(found, dict) and not any(isinstance(found.get(k), list) for k in keys)


def read_list(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("data",)) -> DataFrame:
    """Rows of a JSON list, of the list under the first of ``keys`` that an object has, or of JSON lines.

    The first line that isn't blank shows which; files of one path are of one kind.  ``pos`` is a row's place, over all
    files in the order of their names.  Lines that don't parse are dropped and keep their places; items that don't
    fit have null fields.
    """
    text = spark.read.text(path)
    head = [r[0] for r in text.filter(F.trim("value") != "").select(F.trim("value")).take(1)]
    item = f"struct<{schema_body(schema)}>"
    if head and head[0].startswith("["):
        return _in_place(spark.read.option("multiLine", True).schema(schema).json(path))
    if head and not _is_line(head[0], keys):
        under = spark.read.option("multiLine", True).schema(", ".join(f"`{k}` array<{item}>" for k in keys)).json(path)
        found = under.select(F.coalesce(*[F.col(f"`{k}`") for k in keys]).alias("__items"), "_metadata").filter("__items is not null")
        if not found.select("__items").isEmpty():
            placed = _in_place(found).withColumnRenamed("pos", "__at")
            rows = placed.select("__at", F.posexplode("__items").alias("__pos", "r")).filter("r is not null")
            # One file's list is read as one row, so that places in it are at hand.
            return rows.select("r.*", (F.col("__at") * F.lit(1 << 32) + F.col("__pos")).cast("long").alias("pos"))
    lines = _in_place(text.select("value", "_metadata").filter(F.trim("value") != ""))
    return lines.select(F.from_json("value", item).alias("r"), "pos", F.try_parse_json("value").isNotNull().alias("__ok")).filter("__ok and r is not null").select("r.*", "pos")


def schema_body(ddl: str) -> str:
    """``a INT, b STRING`` as the fields of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, without null fields; ``mode='append'`` adds files.  The committer makes either atomic."""
    rows.write.mode(mode).json(path)


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def export_list(rows: DataFrame, path: str, indent: int = 2) -> None:
    """A pretty JSON list in one local file, written row by row on the driver, for small results."""
    import os

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write("[")
        for k, row in enumerate(rows.toLocalIterator()):
            body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=indent, default=str)
            f.write(",\n" * bool(k) + body)
        f.write("]\n")
    os.replace(path + ".tmp", path)


def example_id(keys: tuple[str, ...]) -> Column:
    return first_text(*[F.col(k) for k in keys])


def last_by_id(examples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``examples(pos, ...)`` with ``qid``; of equal ids the last counts, rows without id go."""
    rows = examples.withColumn("__id", example_id(keys)).filter("__id is not null").drop("qid").withColumnRenamed("__id", "qid")
    return first_by(rows, ["qid"], [F.desc("pos")])


def answers(examples: DataFrame, keys: tuple[str, ...] = ("id", "_id", "qid")) -> DataFrame:
    """(qid, raw_question, raw_answer) of a raw set."""
    return last_by_id(examples, keys).select("qid", F.col("question").alias("raw_question"), F.col("answer").alias("raw_answer"))


def normalize_plans(plans: DataFrame, raw: DataFrame | None = None, keys: tuple[str, ...] = ("id", "_id", "qid")) -> DataFrame:
    """(qid, pos, question, ground_truth_answer, query_plan) of ``plans`` in the PLAN schema with ``pos``.

    The question, and an answer that is missing, come from ``raw`` (see ``answers``).  The plan is the first list
    that isn't empty of the names it may have, or empty.  Variants are distinct whatever their case.  Items
    without id go.
    """
    rows = plans.withColumn("__id", example_id(keys)).filter("__id is not null").drop("qid").withColumnRenamed("__id", "qid")
    some = lambda c: F.when(F.size(c) > 0, c)
    listed = F.coalesce(*[some(F.col(c)) for c in ("query_plan", "query_triples", "triples", "query_graph.query_plan", "query_graph.triples")], F.array().cast(f"array<{CONSTRAINT}>"))
    plan = F.transform(listed, lambda x: F.struct(F.coalesce(x["head"], F.lit("")).alias("head"), F.coalesce(x["tail"], F.lit("")).alias("tail"), distinct_ignoring_case(x["relation_variants"]).alias("relation_variants")))
    if raw is not None:
        rows = rows.join(raw, "qid", "left")
    else:
        rows = rows.withColumn("raw_question", F.lit(None).cast("string")).withColumn("raw_answer", F.lit(None).cast("string"))
    return rows.select("qid", "pos", first_text(F.col("question"), F.col("raw_question")).alias("question"), F.coalesce("ground_truth_answer", "answer", "raw_answer").alias("ground_truth_answer"), plan.alias("query_plan"))


def constraints(items: DataFrame) -> DataFrame:
    """(qid, qi, question, head, tail, relation_variants) of normalized plans."""
    return items.select("qid", "question", F.posexplode("query_plan").alias("qi", "c")).select("qid", "qi", "question", "c.head", "c.tail", "c.relation_variants")


def clean_plan(triples: Column) -> Column:
    """A planner's triples: ends stripped, variants distinct as written."""
    return F.transform(triples, lambda x: F.struct(text(x["head"]).alias("head"), text(x["tail"]).alias("tail"), distinct_exact(x["relation_variants"]).alias("relation_variants")))


def take(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by place, all if None."""
    return rows if n is None else rows.filter(F.col("pos") < n)


def _sentences(x: Column) -> Column:
    """Sentences of a JSON value: a list of texts, or one text."""
    listed = F.from_json(x, "array<string>")
    return F.when(F.startswith(F.ltrim(x), F.lit("[")), listed).when(x.isNotNull(), F.array(x))


def _doc(item: Column) -> Column:
    """(title, sentences) of a context item, as JSON text: ``[title, sentences]``, or an object."""
    pair = F.from_json(item, "array<string>")
    obj = F.from_json(item, "struct<title: string, page_title: string, sentences: string, sents: string, text: string>")
    is_pair = F.startswith(F.ltrim(item), F.lit("["))
    filled = lambda x: F.when((x != "") & (x != "[]"), x)
    body = F.coalesce(filled(obj["sentences"]), filled(obj["sents"]), filled(obj["text"]))
    title = F.when(is_pair, F.get(pair, 0)).otherwise(first_text(obj["title"], obj["page_title"]))
    return F.when(~is_pair | (F.size(pair) >= 2), F.struct(title.alias("title"), _sentences(F.when(is_pair, F.get(pair, 1)).otherwise(body)).alias("sents")))


def context_docs(examples: DataFrame) -> DataFrame:
    """(qid, pos, doc_idx, title, sents) of ``examples`` whose context items are JSON texts; raw, in place."""
    context = F.when(F.size("context") > 0, F.col("context")).otherwise(F.col("contexts")) if "contexts" in examples.columns else F.col("context")
    rows = examples.select("qid", "pos", F.posexplode(context).alias("doc_idx", "item"))
    return rows.select("qid", "pos", "doc_idx", _doc(F.col("item")).alias("d")).filter("d is not null").select("qid", "pos", "doc_idx", "d.title", "d.sents")


def text_units(examples: DataFrame) -> DataFrame:
    """(qid, doc_idx, title, sent_idx, raw_sent_idx, sent) of sentence examples.

    Sentences are stripped and blank ones dropped, which ``sent_idx`` counts without and ``raw_sent_idx`` with.  A
    document with a title but no sentences is a row with null sentence columns.
    """
    none = F.array().cast("array<string>")
    placed = F.filter(F.transform(F.coalesce("sents", none), lambda s, i: F.struct(i.alias("raw"), text(s).alias("sent"))), lambda x: x["sent"] != "")
    docs = context_docs(examples).select("qid", "doc_idx", text(F.col("title")).alias("title"), placed.alias("kept")).filter("title <> '' or size(kept) > 0")
    rows = docs.select("qid", "doc_idx", "title", F.posexplode_outer("kept").alias("sent_idx", "s"))
    return rows.select("qid", "doc_idx", "title", "sent_idx", F.col("s.raw").alias("raw_sent_idx"), "s.sent")


def paragraphs(examples: DataFrame) -> DataFrame:
    """(qid, ord, idx, title, text) of paragraph examples; those without number or text go."""
    rows = examples.select("qid", F.posexplode("paragraphs").alias("ord", "p"))
    return rows.select("qid", "ord", F.col("p.idx").alias("idx"), text(F.col("p.title")).alias("title"), text(F.col("p.paragraph_text")).alias("text")).filter("idx is not null and text <> ''")
