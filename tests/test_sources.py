import json

import pytest

from strandwise.config import Settings
from strandwise.operators.chunking import chunk_pages
from strandwise.plans import extraction, planning
from strandwise.sources import json_sources as J
from strandwise.sources import kg_sources as K
from strandwise.sources import pages as P
from strandwise.sources.llm_client import ask_json, recorded_client


def write(path, obj, lines=False):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in obj) if lines else json.dumps(obj), encoding="utf-8")
    return str(path)


WIKI = [
    {"_id": "h1", "question": "Q1", "answer": "Turin", "context": [["Ada Moor", ["Ada Moor works for Nordic Rail.", " ", "She was born."]], ["Empty", []], {"title": "Nordic Rail", "sentences": ["Based in Turin."]}], "supporting_facts": [["Ada  Moor", 0], ["Nordic Rail", "0"], ["x", "bad"]]},
    {"_id": "h2", "question": "Q2", "answer": "x", "context": [["Ada Moor", ["other text"]], ["T", "one blob"]]},
    {"_id": "h1", "question": "Q1 again", "answer": "Milan", "context": []},
]
MUSIQUE = [
    {"id": "m1", "question": "Q", "answer": "A", "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "one"}, {"idx": 1, "title": "T", "paragraph_text": "two"}, {"idx": 2, "title": "U", "paragraph_text": ""}], "question_decomposition": [{"paragraph_support_idx": 1}, {"paragraph_support_idx": None}]},
    {"id": "m2", "question": "Q", "answer": "A", "paragraphs": [{"idx": 0, "title": "T", "paragraph_text": "one"}, {"idx": 0, "title": "V", "paragraph_text": "v"}]},
]


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"data": x}])
def test_lists(spark, tmp_path, wrap):
    rows = J.read_list(spark, write(tmp_path / "w.json", wrap(WIKI)), J.SENTENCE_EXAMPLE)
    assert [(r.pos, r._id) for r in rows.orderBy("pos").collect()] == [(0, "h1"), (1, "h2"), (2, "h1")]
    last = {r.qid: r.question for r in J.last_by_id(rows, ("_id", "id")).collect()}
    assert last == {"h1": "Q1 again", "h2": "Q2"}
    assert {r.qid: r.raw_answer for r in J.answers(rows).collect()} == {"h1": "Milan", "h2": "x"}


def test_lines_with_bad_rows(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", [{"a": 1}, "", "{bad", {"a": 2}], lines=True)
    assert sorted(r.a for r in J.read_lines(spark, path, "a INT").collect()) == [1, 2]
    assert [r.a for r in J.read_list(spark, path, "a INT").filter("a is not null").orderBy("pos").collect()] == [1, 2]


def test_text_units(spark, tmp_path):
    rows = J.read_list(spark, write(tmp_path / "w.json", WIKI[:2]), J.SENTENCE_EXAMPLE)
    units = J.text_units(J.last_by_id(rows, ("_id",))).orderBy("qid", "doc_idx", "sent_idx").collect()
    assert [(u.qid, u.doc_idx, u.title, u.sent_idx, u.raw_sent_idx, u.sent) for u in units] == [
        ("h1", 0, "Ada Moor", 0, 0, "Ada Moor works for Nordic Rail."),
        ("h1", 0, "Ada Moor", 1, 2, "She was born."),
        ("h1", 1, "Empty", None, None, None),
        ("h1", 2, "Nordic Rail", 0, 0, "Based in Turin."),
        ("h2", 0, "Ada Moor", 0, 0, "other text"),
        ("h2", 1, "T", 0, 0, "one blob"),
    ]


def test_pages(spark, tmp_path):
    wiki, kind = P.load_pages(spark, write(tmp_path / "w.json", WIKI))
    assert kind == "hotpotqa"
    assert {r.title: r.text for r in wiki.collect()} == {"Ada Moor": "Ada Moor works for Nordic Rail. She was born.", "Empty": "", "Nordic Rail": "Based in Turin.", "T": "one blob"}
    musique, kind = P.load_pages(spark, write(tmp_path / "m.json", MUSIQUE))
    assert kind == "musique" and {r.title: r.text for r in musique.collect()} == {"T": "one\n\ntwo", "V": "v"}
    merged = P.merge_pages([musique, wiki])
    assert {r.title: r.text for r in merged.collect()}["T"] == "one\n\ntwo"
    assert [r.title for r in P.first_pages(merged, 3).orderBy("ord").collect()] == ["T", "V", "Ada Moor"]
    assert {r.title: r.text for r in P.load_pages(spark, str(tmp_path / "w.json"), 1)[0].collect()}.keys() == {"Ada Moor", "Empty", "Nordic Rail"}
    with pytest.raises(ValueError):
        P.load_pages(spark, write(tmp_path / "n.json", [{"x": 1}]))


def test_paragraphs(spark, tmp_path):
    rows = J.last_by_id(J.read_list(spark, write(tmp_path / "m.json", MUSIQUE), J.PARAGRAPH_EXAMPLE), ("id",))
    assert sorted((r.qid, r.ord, r.idx, r.text) for r in J.paragraphs(rows).collect()) == [("m1", 0, 0, "one"), ("m1", 1, 1, "two"), ("m2", 0, 0, "one"), ("m2", 1, 0, "v")]


def test_plans(spark, tmp_path):
    plan = [{"head": "Ada", "relation": "dropped", "tail": "?x", "relation_variants": ["Works For", "works for", " ", "employed by"]}]
    items = [{"_id": "a", "query_triples": plan}, {"qid": "b", "question": "own", "answer": "o", "query_graph": {"triples": plan}}, {"id": "c", "query_plan": []}, {"question": "no id", "triples": plan}]
    raw = spark.createDataFrame([("a", "raw q", "raw a"), ("b", "raw", "raw")], "qid string, raw_question string, raw_answer string")
    got = {r.qid: r for r in J.normalize_plans(J.read_list(spark, write(tmp_path / "p.json", items), J.PLAN), raw).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].question, got["a"].ground_truth_answer) == ("raw q", "raw a")
    assert (got["b"].question, got["b"].ground_truth_answer) == ("own", "o")
    assert got["a"].query_plan[0].relation_variants == ["Works For", "employed by"] and got["c"].query_plan == []


def test_bundle_keeps_id_zero(spark, tmp_path):
    write(tmp_path / "entities.jsonl", [{"id": 0, "name": "Ada"}, {"id": 1, "name": "", "surface": "Rail"}], lines=True)
    write(tmp_path / "triples.jsonl", [{"h": 0, "t": 1, "r": "works for", "title": "A"}, "", {"h": 1, "t": 9, "r": "x"}, "{bad", {"h": "name", "t": 0, "r": "y"}], lines=True)
    g = K.load_graph(spark, str(tmp_path))
    assert [(r.id, r.name) for r in g.entities.orderBy("id").collect()] == [(0, "Ada"), (1, "Rail")]
    assert [(r.triple_id, r.head_id, r.head, r.tail_id, r.tail, r.meta.title) for r in g.triples.orderBy("triple_id").collect()] == [(0, 0, "Ada", 1, "Rail", "A"), (1, 1, "Rail", None, "9", None), (2, None, "name", 0, "Ada", None)]
    K.write_tables(g, str(tmp_path / "tables"))
    assert K.load_graph(spark, str(tmp_path / "tables")).triples.count() == 3


def test_named_lines(spark, tmp_path):
    (tmp_path / "kg").mkdir()
    write(tmp_path / "kg" / "a.jsonl", [{"subject": "Ada", "predicate": "works for", "object": "Rail", "title": "A"}, {"h": "0", "r": "x", "t": "Ada"}], lines=True)
    write(tmp_path / "kg" / "b.jsonl", [{"head": "Rail", "relation": "in", "tail": "Turin"}, {"head": "no tail", "relation": "r"}], lines=True)
    g = K.load_graph(spark, str(tmp_path / "kg"))
    assert [r.name for r in g.entities.orderBy("id").collect()] == ["Ada", "Rail", "0", "Turin"]
    assert [(r.triple_id, r.head_id, r.relation, r.tail_id) for r in g.triples.orderBy("triple_id").collect()] == [(0, 0, "works for", 1), (1, 2, "x", 0), (2, 1, "in", 3)]
    assert K.read_named(spark, str(tmp_path / "kg"), falsy_is_missing=True).triples.count() == 2


def test_document_graph(spark, tmp_path):
    doc = {"entities": [{"name": "Ada"}, {"surface": "Rail"}, "plain"], "triples": [{"head": 0, "relation": "r", "tail": 1, "evidence": "e"}, [1, "s", 2], ["x", "t", 0]]}
    g = K.load_graph(spark, write(tmp_path / "g.json", doc))
    assert [r.name for r in g.entities.orderBy("id").collect()] == ["Ada", "Rail", "plain"]
    assert [(r.head, r.relation, r.tail, r.head_id) for r in g.triples.orderBy("triple_id").collect()] == [("Ada", "r", "Rail", 0), ("Rail", "s", "plain", 1), ("x", "t", "Ada", None)]
    for bad in ("g.pt",):
        with pytest.raises(ValueError):
            K.load_graph(spark, str(tmp_path / bad))


ANSWERS = {
    "strict": '{"entities": [{"name": "Ada", "type": "per"}, "Rail"], "triples": [{"head": "Ada", "relation": "works for", "tail": "Rail", "evidence": " q "}]}',
    "fenced": '```json\n{"named_entities": [{"text": "Ada"}], "triples": [["Ada", "born in", "Turin"]]}\n```',
    "prose": 'Sure: {"triples": [{"h": "Ada", "r": "x", "t": "Y"}, {"h": "", "r": "x", "t": "y"}]} done',
    "list": 'see [{"head": "A", "relation": "b", "tail": "C"}, {"head": "D", "relation": "", "tail": "E"}] ok',
    "one": 'see [{"head": "an object is tried first", "relation": "b", "tail": "C"}] ok',
    "null": "null",
    "junk": "not json",
    "none": None,
}


def test_answers_of_models(spark):
    rows = spark.createDataFrame([(k, 0, 0, v) for k, v in ANSWERS.items()], "title string, ord int, chunk_idx int, response string")
    parsed = extraction.parse_openie(rows)
    ents = sorted((r.title, r.name, r.type) for r in extraction.entity_mentions(parsed).collect())
    assert ents == [("fenced", "Ada", None), ("strict", "Ada", "per"), ("strict", "Rail", "OTHER")]
    tris = sorted((r.title, r.head, r.relation, r.tail, r.evidence) for r in extraction.triple_mentions(parsed).collect())
    assert tris == [("fenced", "Ada", "born in", "Turin", ""), ("list", "A", "b", "C", ""), ("prose", "Ada", "x", "Y", ""), ("strict", "Ada", "works for", "Rail", "q")]


def test_extraction_resumes(spark, tmp_path):
    from strandwise.operators import prompts

    pages = spark.createDataFrame([("A", "Ada works.\n\nAda moved.", 0), ("B", "Rail.", 1)], "title string, text string, ord int")
    calls = tmp_path / "calls"

    def client():
        def chat(msgs, **options):
            with open(calls, "a") as f:
                f.write("x\n")
            return json.dumps({"entities": ["Ada"], "triples": [{"head": "Ada", "relation": "in", "tail": "Rail"}]})

        return chat

    assert prompts.messages("s", "u")[0]["role"] == "system"
    out = str(tmp_path / "answers")
    extraction.extract_incrementally(spark, pages.limit(1), client, Settings(chunk_chars=5), out)
    parsed = extraction.extract_incrementally(spark, pages, client, Settings(chunk_chars=5), out)
    assert len(calls.read_text().split()) == 3 and parsed.count() == 3
    built = extraction.build_graph(parsed)
    assert [(r.id, r.name) for r in built.entities.orderBy("id").collect()] == [(0, "Ada"), (1, "Rail")]
    assert [(r.h, r.t, r.title) for r in built.triples.orderBy("triple_id").collect()] == [(0, 1, "A"), (0, 1, "B")]
    K.write_bundle(built.entities, built.triples, built.title_entities, built.title_triples, str(tmp_path / "kg"))
    assert K.load_graph(spark, str(tmp_path / "kg")).triples.count() == 2
    assert chunk_pages(pages, 5).count() == 3


def test_unanswered_titles_are_asked_again(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([("A", "Ada works.\n\nAda moved.", 0), ("B", "Rail.", 1)], "title string, text string, ord int")
    ready = tmp_path / "ready"
    real = extraction.ask
    monkeypatch.setattr(extraction, "ask", lambda *a, **options: real(*a, tries=1, pause=0.0, **options))

    def client():
        def chat(msgs, **options):
            if "moved" in msgs[1]["content"] and not ready.exists():
                raise TimeoutError
            return json.dumps({"entities": ["Ada"]})

        return chat

    out = str(tmp_path / "answers")
    first = extraction.extract_incrementally(spark, pages, client, Settings(chunk_chars=5), out)
    # One chunk of A has no answer, so that none of A is kept.
    assert [r.title for r in first.collect()] == ["B"]
    ready.touch()
    both = extraction.extract_incrementally(spark, pages, client, Settings(chunk_chars=5), out)
    assert sorted(r.title for r in both.collect()) == ["A", "A", "B"]


def test_two_call_extraction(spark):
    pages = spark.createDataFrame([("A", "Ada works.", 0)], "title string, text string, ord int")

    def client():
        return lambda msgs, **options: '[{"name": "Ada", "type": "PERSON"}]' if "up to 15" in msgs[1]["content"] else 'x [{"head": "Ada", "relation": "in", "tail": "Rail"}] y'

    parsed = extraction.extract_in_two(pages, client, Settings())
    assert [r.name for r in extraction.entity_mentions(parsed).collect()] == ["Ada"]
    assert [r.tail for r in extraction.triple_mentions(parsed).collect()] == ["Rail"]


def test_plans_of_models(spark):
    rows = [("a", '{"triples": [{"head": " Ada ", "tail": "?x", "relation_variants": ["in", "in", "In", ""]}]}'), ("b", '{"note": 1, "steps": [{"head": "B", "tail": "?y"}]}'), ("c", "junk"), ("d", None), ("e", '{"triples": []}')]
    df = spark.createDataFrame(rows, "qid string, response string")
    from pyspark.sql import functions as F

    got = {r.qid: r.p for r in df.select("qid", planning.plan_of(F.col("response")).alias("p")).collect()}
    assert [(x.head, x.tail, x.relation_variants) for x in got["a"]] == [("Ada", "?x", ["in", "In"])]
    assert [(x.head, x.relation_variants) for x in got["b"]] == [("B", [])]
    assert got["c"] == got["d"] == got["e"] == []

    def failing():
        def chat(msgs, **options):
            raise TimeoutError

        return chat

    out = planning.plan_questions(spark.createDataFrame([("q", "Who?")], "qid string, question string"), failing, tries=2, pause=0).first()
    assert out.query_plan == []


def test_clients():
    client = recorded_client({"hi": '{"a": 1}'})
    assert ask_json(client, "hi") == {"a": 1} and ask_json(client, "other") == {}
