import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions import text as X


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_keys_and_types(spark):
    assert column(spark, ["  Ada-Moor! ", "Café  Zürich", "a_b", None, "--"], X.name_key) == ["ada moor", "café zürich", "a_b", "", ""]
    assert column(spark, ["person", "PERIOD", "gpe", "company", "GPE org", "City", "an event", "x", None, " org "], X.entity_type) == ["PERSON", "PERSON", "LOC", "ORG", "LOC", "LOC", "EVENT", "OTHER", "OTHER", "ORG"]
    assert column(spark, ["?x", "x?", "", None], X.is_var) == [True, False, False, False]


def test_plain_and_mentions(spark):
    assert column(spark, ["Café-Bar, 12 漢字!", None], X.plain) == ["caf bar 12 漢字", ""]
    rows = spark.createDataFrame([("Ada Moor works for Nordic Rail.", "ada  moor", "NORDIC rail"), ("Ada Moor", "Ada", ""), ("x", "y", "z"), ("Adana works at Nordica", "ada", "nordic")], "b string, h string, t string")
    assert [r[0] for r in rows.select(X.mentions(F.col("b"), F.col("h"), F.col("t"))).collect()] == [True, False, False, True]
    assert [r[0] for r in rows.select(X.mentions(F.col("b"), F.col("h"), F.col("t"), F.lit("works for"))).collect()] == [True, False, False, False]


def test_lists(spark):
    rows = [[" a ", "A", "b", "", None, "a"], [], None]
    assert column(spark, rows, X.distinct_exact, "array<string>") == [["a", "A", "b"], [], []]
    assert column(spark, rows, X.distinct_ignoring_case, "array<string>") == [["a", "b"], [], []]


def answer_key(s):
    import re

    bare = "".join(c for c in s.lower() if c not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + string.punctuation + " \t\n0189", max_size=30), min_size=30, max_size=60))
def test_answer_key(spark, values):
    values = [*values, "The  Cat, an a-b!", "a", "an apple a day"]
    assert column(spark, values, X.answer_key) == [answer_key(v) for v in values]


def test_a_plain_form_is_found_without_making_that_of_the_text(spark):
    bodies = ["", None, "New  York-City", "newyork city", "Neu\n\tYORK, é City", "x new york citys", "new é", "東京 New... 大阪york", "1.5\u00a0new\U0001f600york"]
    names = ["", "new york", "new york city", "york", "new", "city", "w york c", "東京 new", "大阪york", "5 new york", "new é", "."]
    rows = spark.createDataFrame([(b, n) for b in bodies for n in names], "b string, n string").select(X.plain(F.col("n")).alias("n"), "b")
    both = rows.select(X.plain_in(F.col("n"), X.lowered(F.col("b"))).alias("found"), ((F.col("n") != "") & F.contains(X.plain(F.col("b")), F.col("n"))).alias("want")).collect()
    assert [r.found for r in both] == [r.want for r in both] and 0 < sum(r.found for r in both) < len(both)
