import random

import brute
from conftest import pairs_of

from strandwise.llm import line_dedup as L


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept(spark, texts, min_docs=5):
    rows = L.drop_lines(spark, docs(spark, texts), min_docs).collect()
    return {r.doc_id: r.text for r in rows}


def test_recurring_lines_go_with_their_variable_fields(spark):
    texts = [f"own line {'x' * k}\nPage {k}  of\t90\nother line {'y' * k}" for k in range(8)]
    got = kept(spark, texts)
    assert got == {k: f"own line {'x' * k}\nother line {'y' * k}" for k in range(8)}


def test_copies_stay_whole(spark):
    text = "first line\nsecond line\nthird line"
    assert set(kept(spark, [text] * 20).values()) == {text}


def test_too_few_documents(spark):
    texts = [f"a{'x' * k}\nsame line\nb{'y' * k}" for k in range(4)]
    assert kept(spark, texts) == dict(enumerate(texts))
    assert all("same" not in t for t in kept(spark, texts, 4).values())


def test_a_field_without_digits_varies(spark):
    texts = [f"own {c}{c} words\nshared footer about cookies by acme{c}" for c in "abcdefghijkl"]
    assert kept(spark, texts) == {k: f"own {c}{c} words" for k, c in enumerate("abcdefghijkl")}
    # Too few words differ, so that each is a line of its own.
    assert kept(spark, texts[:4]) == dict(enumerate(texts[:4]))


def test_a_leaf_of_unlike_lines_stays(spark):
    texts = [f"the old {c}a{c} {c}b{c} {c}c{c} {c}d{c}\nown {c}{c} words" for c in "abcdefghijkl"]
    assert kept(spark, texts) == dict(enumerate(texts))


def test_footers_of_several_lines(spark):
    own = [f"first {c} one\nsecond {c} one\nthird {c} one" for c in "abcdefgh"]
    texts = [f"{t}\nall rights\nsee terms\nthe end" for t in own]
    assert kept(spark, texts) == dict(enumerate(own))


def test_lines_between_blank_lines(spark):
    texts = [f"first {c} one\n\nread more\n\nlast {c} one" for c in "abcdefgh"]
    assert kept(spark, texts) == {k: t.replace("read more\n", "") for k, t in enumerate(texts)}


def test_copies_do_not_save_a_line(spark):
    # A third of the rows and more are copies of one text that has the line too.
    texts = [f"first {c} one\nread more\nlast {c} one" for c in "abcdefgh"] + ["copy a\nread more\ncopy b"] * 30
    got = kept(spark, texts)
    assert not any("read more" in t for t in got.values())
    assert got[20] == "copy a\ncopy b"


def test_near_copies_stay(spark):
    lines = [f"line {c} of the text" for c in "abcdefghij"]
    texts = ["\n".join([*lines[:k], f"edit {'x' * k}y here", *lines[k + 1 :]]) for k in range(10)]
    assert kept(spark, texts) == dict(enumerate(texts))


def test_other_white_space_and_blank_lines(spark):
    texts = [f"p{'x' * k}\n\n a\x0bb\f c \r\nq{'y' * k}\n" for k in range(6)]
    assert kept(spark, texts) == {k: f"p{'x' * k}\n\nq{'y' * k}\n" for k in range(6)}


def test_against_a_plain_version(spark):
    rng = random.Random(6)
    words = [f"w{c}{d}" for c in "abcdef" for d in "xyz"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 11))) for _ in range(14)] + ["", "page 1 of 2", " \t"]
    rows = []
    for i in range(150):
        own = [rng.choice([rng.choice(lines), rng.choice(lines) + " " + rng.choice(words), " ".join(rng.choices(words, k=6)), f"see {rng.choice(words)} on page {i}"]) for _ in range(rng.randint(0, 7))]
        rows.append((rng.choice([i, i, 7, None]), "\n".join(own) if own else None))
    got = L.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute.kept_lines(rows)
    key = lambda x: (str(x[0]), x[1])
    assert sorted([(r.doc_id, r.text or "") for r in got], key=key) == sorted([(i, t) for (i, _), t in zip(rows, want)], key=key)
    assert sum(map(len, want)) < sum(len(t or "") for _, t in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    out = L.drop_lines(spark, odd_docs)
    assert out.columns == [*odd_docs.columns, "__n_lines", "__n_dropped"]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(pairs_of(out), key=key) == sorted(pairs_of(odd_docs), key=key)
    got = L.line_dedup(spark, odd_docs).collect()
    assert len(got) == 16 and {r.n_dropped for r in got} == {0}
    assert {(r.n_lines, r.kept_chars) for r in got if r.doc_id == 3} == {(1, 0)}
    assert L.line_dedup(spark, no_docs).collect() == []


def test_no_python_in_the_plan(spark, odd_docs):
    plan = L.line_templates(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
