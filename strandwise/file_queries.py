"""Queries that write files of the kinds that sources read, read them through the sources, and go on from there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import text as X
from strandwise.operators import kg
from strandwise.plans import extraction, planning, star
from strandwise.sources import json_sources as J
from strandwise.sources import kg_sources, pages
from strandwise.workspace import Workspace

#: Documents of one question.
GROUP = 3


def _lines(spark: SparkSession, rows: DataFrame, order: str, line: str) -> str:
    """A folder of text files of the lines in order."""
    path = Workspace(spark, "files").path("lines")
    rows.orderBy(order).select(line).write.text(path)
    return path


def bundle_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the star-schema graph, written as a bundle of line files and loaded again."""
    path = Workspace(spark, "files").path("bundle")
    ents = star.entities(spark, sf_dir)
    links = star.links(spark, sf_dir, ents)
    kg_sources.write_bundle(ents, links, kg.title_entities(ents.select(F.lit("all").alias("title"), "id"), links), kg.title_triples(links), path)
    got = kg_sources.load_graph(spark, path).triples
    return got.select("triple_id", "head_id", "tail_id", "head", "relation", "tail", F.col("meta.title").alias("title"))


def json_alias_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between names from JSON lines with aliased keys: entities are numbered as they first appear."""
    line = F.to_json(F.struct(F.concat(F.lit("user"), F.col("user_id")).alias("h"), F.col("event_type").alias("predicate"), F.concat(F.lit("item"), F.get_json_object("props", "$.k")).alias("object")))
    rows = star.table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    got = kg_sources.load_graph(spark, _lines(spark, rows, "event_id", "line")).triples
    return got.select("triple_id", "head_id", "relation", "tail_id", "head", "tail")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in questions of three: (qid, doc_idx, title, text); titles repeat in a question."""
    docs = star.table(spark, sf_dir, "documents")
    return docs.select(F.floor(F.col("doc_id") / GROUP).alias("qid"), (F.col("doc_id") % GROUP).cast("int").alias("doc_idx"), F.concat(F.lit(" t"), F.col("doc_id") % 2).alias("title"), "text")


def sentence_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions as examples with ``context`` of [title, sentences], through a file of JSON lines."""
    docs = _grouped(spark, sf_dir)
    item = F.concat(F.regexp_replace(F.to_json(F.array("title")), r"\]$", ""), F.lit(","), F.to_json(F.split("text", "\n")), F.lit("]"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_idx", item.alias("x")))), lambda x: x["x"]), ",")
    rows = docs.groupBy("qid").agg(listed.alias("items"))
    line = F.concat(F.lit('{"_id": "q'), "qid", F.lit('", "question": "Q", "answer": "A", "context": ['), "items", F.lit("]}"))
    return J.read_list(spark, _lines(spark, rows.select("qid", line.alias("line")), "qid", "line"), J.SENTENCE_EXAMPLE)


def paragraph_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _grouped(spark, sf_dir)
    listed = F.sort_array(F.collect_list(F.struct(F.col("doc_idx").alias("idx"), "title", F.col("text").alias("paragraph_text"))))
    rows = docs.groupBy("qid").agg(listed.alias("paragraphs"))
    line = F.to_json(F.struct(F.concat(F.lit("q"), "qid").alias("id"), F.lit("Q").alias("question"), F.lit("A").alias("answer"), "paragraphs"))
    return J.read_list(spark, _lines(spark, rows.select("qid", line.alias("line")), "qid", "line"), J.PARAGRAPH_EXAMPLE)


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = J.text_units(J.last_by_id(sentence_examples(spark, sf_dir), ("_id",)))
    return units.select("qid", "doc_idx", "title", "sent_idx", "raw_sent_idx", F.md5("sent").alias("digest"))


def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = J.paragraphs(J.last_by_id(paragraph_examples(spark, sf_dir), ("id",)))
    return units.select("qid", "ord", "idx", "title", F.md5("text").alias("digest"))


def sentence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each title of sentence examples, titles being numbers of twenty."""
    docs = star.table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.array(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 20)))).alias("t"), F.to_json(F.split("text", "\n")).alias("s"))
    line = F.concat(F.lit('{"_id": "'), "doc_id", F.lit('", "context": ['), F.regexp_replace("t", r"\]$", ""), F.lit(","), "s", F.lit("]]}"))
    path = _lines(spark, docs.select("doc_id", line.alias("line")), "doc_id", "line")
    found, kind = pages.load_pages(spark, path)
    return found.select("title", F.lit(kind).alias("kind"), F.md5("text").alias("digest"))


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paragraphs of each title joined in order, with documents as paragraphs of their source."""
    docs = star.table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.array(F.struct(F.lit(0).alias("idx"), F.col("source").alias("title"), F.col("text").alias("paragraph_text"))).alias("paragraphs")))
    path = _lines(spark, docs.select("doc_id", line.alias("line")), "doc_id", "line")
    found, kind = pages.load_pages(spark, path)
    return found.select("title", F.lit(kind).alias("kind"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans under the names that they may have, normalized with questions and answers of a raw set of which ids repeat."""
    n = star.table(spark, sf_dir, "nation")
    variants = F.array(F.lit("based in"), F.lit(" Based In "), F.lit(""), F.concat(F.lit("of "), "n_name"))
    plan = F.array(F.struct(F.lit("?x").alias("head"), F.col("n_name").alias("tail"), variants.alias("relation_variants")))
    key, none = F.col("n_nationkey") % 4, F.lit(None)
    row = F.struct(
        F.when(key != 1, F.concat(F.lit("n"), "n_nationkey")).alias("id"), F.when(key == 1, F.concat(F.lit("n"), "n_nationkey")).alias("_id"),
        F.when(key == 2, F.concat(F.lit("In "), "n_name")).alias("question"), F.when(key == 0, F.lit("own")).alias("ground_truth_answer"),
        F.when(key == 0, plan).otherwise(none).alias("query_plan"), F.when(key == 1, plan).otherwise(none).alias("triples"), F.when(key == 2, F.struct(plan.alias("query_plan"))).otherwise(none).alias("query_graph"),
    )
    plans = J.read_list(spark, _lines(spark, n.select("n_nationkey", F.to_json(row).alias("line")), "n_nationkey", "line"), J.PLAN)
    twice = n.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"), "n_nationkey", "n_name").withColumn("place", F.col("copy") * 1000 + F.col("n_nationkey"))
    raw = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat("n_name", F.lit("?"), "copy").alias("question"), F.concat(F.lit("raw"), "copy").alias("answer"))
    raw = J.answers(J.read_list(spark, _lines(spark, twice.select("place", F.to_json(raw).alias("line")), "place", "line"), J.PARAGRAPH_EXAMPLE))
    items = J.normalize_plans(J.take(plans, 20), raw)
    return items.select("qid", "pos", "question", "ground_truth_answer", F.to_json("query_plan").alias("query_plan"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers about parts in the shapes that are parsed: fenced, within prose, as a list, and broken."""
    p = star.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    entity = F.concat(F.lit('{"entities": [{"name": "'), "p_name", F.lit('", "type": "org"}, "'), "p_brand", F.lit('", {"text": ""}]'))
    fact = F.concat(F.lit('{"h": "'), "p_name", F.lit('", "relation": "made by", "t": "'), "p_brand", F.lit('", "evidence": " quote "}'))
    three = F.concat(F.lit('["'), "p_name", F.lit('", "has type", "'), "p_type", F.lit('"]'))
    whole = F.concat(entity, F.lit(', "triples": ['), fact, F.lit(", "), three, F.lit("]}"))
    kind = F.col("p_partkey") % 5
    response = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here you are: "), whole, F.lit(" as asked.")))
        .when(kind == 2, F.concat(F.lit("["), fact, F.lit(", "), three, F.lit("]")))
        .when(kind == 3, F.concat(F.lit("I can't {"), whole))
        .otherwise(whole)
    )
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("title"), F.col("p_partkey").cast("long").alias("ord"), F.lit(0).alias("chunk_idx"), response.alias("response"))


def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.entity_mentions(extraction.parse_openie(_answers(spark, sf_dir)))
    return found.select("title", "item", "name", "type")


def parsed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.triple_mentions(extraction.parse_openie(_answers(spark, sf_dir)))
    return found.select("title", "item", "head", "relation", "tail", "evidence")


def mention_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each brand among those whose names have one key, letters' case and marks aside."""
    p = star.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit(" - ")), F.lit("!")))
    return kg.dedupe_mentions(p.select(F.col("p_brand").alias("title"), "p_partkey", name.alias("name")), "title", ["p_partkey"])


def _planner():
    """A client that plans any question, but for those of A, which it answers with something else, and of B, which it fails."""

    def client(msgs: list[dict[str, str]], **options) -> str:
        name = msgs[-1]["content"].split("Question: Where is ")[1].split("?")[0]
        if name.startswith("B"):
            raise RuntimeError("no answer")
        plan = [{"head": f" {name} ", "tail": "?place", "relation_variants": ["in", "in", " lies in", ""]}]
        return json.dumps({"note": "x", "steps": plan} if name.startswith("A") else {"triples": plan})

    return client


def planned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("qid"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"))
    return planning.plan_questions(n, _planner, tries=2, pause=0.0).select("qid", "question", F.to_json("query_plan").alias("query_plan"))


QUERIES = {
    f.__name__: f
    for f in (
        bundle_graph, json_alias_ingest, text_units, paragraph_units, sentence_pages, page_merge, plan_items, parsed_entities, parsed_triples,
        mention_dedupe, planned_questions,
    )
}

_TRIM = "trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def _trim(x: str) -> str:
    return _TRIM.format(x=x)


_DOCS = f"d as (select 'q' || doc_id // {GROUP} as qid, cast(doc_id % {GROUP} as int) as doc_idx, 't' || doc_id % 2 as title, text from documents)"
_FACT = "select 'p' || p_partkey as title, p_name, p_brand, p_type, p_partkey % 5 as kind from part where p_partkey % 5 <> 3"
_PLANNED = """'[{"head":"?x","tail":"' || n_name || '","relation_variants":["based in","of ' || n_name || '"]}]'"""


def sql(graph: str, key: str) -> dict[str, str]:
    """``graph``: the CTEs ent and tri of the star-schema graph; ``key``: an expression of the key of ``name``."""
    return {
        "bundle_graph": f"with {graph} select triple_id, h as head_id, t as tail_id, x.name as head, r as relation, y.name as tail, title from tri join ent x on x.id = h join ent y on y.id = t",
        "json_alias_ingest": """with p as (
            select row_number() over (order by event_id) - 1 as triple_id, 'user' || user_id as head, event_type as relation, 'item' || json_extract_string(props, '$.k') as tail
            from events where json_extract_string(props, '$.k') is not null),
          e as (select name, row_number() over (order by min(triple_id * 2 + side)) - 1 as id from (select triple_id, 0 as side, head as name from p union all select triple_id, 1, tail from p) group by name)
          select triple_id, a.id as head_id, relation, b.id as tail_id, head, tail from p join e a on a.name = head join e b on b.name = tail""",
        "text_units": f"""with {_DOCS},
          l as (select qid, doc_idx, title, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as raw_sent_idx from d),
          k as (select qid, doc_idx, title, cast(row_number() over (partition by qid, doc_idx order by raw_sent_idx) - 1 as int) as sent_idx, cast(raw_sent_idx as int) as raw_sent_idx, md5({_trim("s")}) as digest from l where {_trim("s")} <> '')
          select * from k union all select qid, doc_idx, title, null, null, null from d where not exists (select 1 from k where k.qid = d.qid and k.doc_idx = d.doc_idx)""",
        "paragraph_units": f"with {_DOCS} select qid, doc_idx as ord, doc_idx as idx, title, md5({_trim('text')}) as digest from d where {_trim('text')} <> ''",
        "sentence_pages": f"""with f as (select doc_id, 'p' || doc_id // 20 as title, text from documents qualify row_number() over (partition by doc_id // 20 order by doc_id) = 1)
          select title, 'hotpotqa' as kind, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_trim("s")}), lambda s: s <> ''), ' ')) as digest from f""",
        "page_merge": f"""with d as (select source as title, {_trim("text")} as text, min(doc_id) as pos from documents group by 1, 2)
          select title, 'musique' as kind, length(string_agg(text, chr(10) || chr(10) order by pos)) as n_chars, md5(string_agg(text, chr(10) || chr(10) order by pos)) as digest from d where text <> '' group by title""",
        "plan_items": f"""select 'n' || n_nationkey as qid, cast(n_nationkey as bigint) as pos, case when n_nationkey % 4 = 2 then 'In ' || n_name else n_name || '?1' end as question,
            case when n_nationkey % 4 = 0 then 'own' else 'raw1' end as ground_truth_answer, case when n_nationkey % 4 = 3 then '[]' else {_PLANNED} end as query_plan
          from nation where n_nationkey < 20""",
        "parsed_entities": f"""with f as ({_FACT}) select title, 0 as item, p_name as name, 'org' as type from f where kind <> 2
          union all select title, 1, p_brand, 'OTHER' from f where kind <> 2""",
        "parsed_triples": f"""with f as ({_FACT}) select title, 0 as item, p_name as head, 'made by' as relation, p_brand as tail, 'quote' as evidence from f
          union all select title, 1, p_name, 'has type', p_type, '' from f""",
        "mention_dedupe": f"""with m as (select p_brand as title, p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else replace(p_name, ' ', ' - ') || '!' end as name from part)
          select title, p_partkey, name from m qualify row_number() over (partition by title, {key} order by p_partkey) = 1""",
        "planned_questions": """select cast(n_nationkey as varchar) as qid, 'Where is ' || n_name || '?' as question,
            case when n_name like 'B%' then '[]' else '[{"head":"' || n_name || '","tail":"?place","relation_variants":["in","lies in"]}]' end as query_plan from nation""",
    }
