import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import chat_format as C

TEXT = st.text(alphabet=st.sampled_from("ab[]<>/\\s|\nINST é"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    formatted = "".join(C.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.parse(formatted)] == turns


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, position long, seq long, kind string, role string, text string")


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "open", "user", None),
        (1, 0, 1, "delta", None, "he"),
        (1, 0, 9, "delta", None, "llo"),
        (1, 1, 2, "open", "assistant", None),
        (1, 1, 3, "delta", None, "wrong"),
        (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "ri"),
        (1, 1, 6, "delta", None, "ght"),
        (1, 2, 7, "open", "assistant", None),
        (1, 2, 8, "delta", None, "old"),
        (1, 2, 10, "edit", None, "new"),
        (1, 2, 11, "delta", None, "er"),
    ]
    got = sorted(C.format_chats(log(spark, rows).repartition(4)).collect(), key=lambda r: r.message)
    assert [(r.role, r.formatted) for r in got] == [("user", "[INST] hello [/INST]\n"), ("assistant", "[ANS] right </s>\n"), ("assistant", "[ANS] newer </s>\n")]
    assert [r.formatted[r.text_start : r.text_end] for r in got] == ["hello", "right", "newer"]


def test_nulls_in_the_log(spark):
    rows = [(1, 0, 0, "open", "user", None), (1, 0, 1, None, None, "x"), (1, 0, 2, "typing", None, "y"), (1, 0, 3, "delta", None, None), (1, 0, 4, "delta", None, "ok"), (None, None, None, "delta", None, "z"), (2, 0, 0, None, None, None)]
    got = {(r.conv_id, r.formatted) for r in C.format_chats(log(spark, rows)).collect()}
    assert got == {(1, "[INST] ok [/INST]\n"), (None, "[ROLE |] z [/ROLE]\n"), (2, "[ROLE |]  [/ROLE]\n")}


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int, seq string")


def test_digests(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok", 1, "x"), (1, 0, "user", None, 1, "x"), (2, 0, None, "a" * 600, 1, "x"), (None, 0, "user", "n", 1, "x"), (1, 2, "tool|]", "é" * 300, 1, "x")]
    got = {r.conv_id: r for r in C.chat_digests(C.to_events(turns(spark, rows).repartition(3))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    one = got[1]
    assert (one.n_turns, one.turns_sha256) == (3, sha("user\n\nassistant\n</s>[INST] ok\ntool|]\n" + "é" * 300 + "\n"))
    assert (one.loss_chars, one.loss_sha256) == (13, sha("</s>[INST] ok"))
    assert one.formatted_chars == sum(len(C.render(r, t)[0]) for r, t in (("user", ""), ("assistant", "</s>[INST] ok"), ("tool|]", "é" * 300)))
    assert (got[2].n_turns, got[2].loss_chars, got[2].loss_sha256) == (1, 0, sha(""))


def test_empty_and_repeated_rows(spark):
    assert C.chat_digests(C.to_events(turns(spark, []))).collect() == []
    twice = C.chat_digests(C.to_events(turns(spark, [(1, 0, "user", "a", 0, ""), (1, 0, "user", "b", 0, "")]))).collect()
    assert twice[0].n_turns == 2


def test_identical_rows_stay_messages_of_their_own(spark):
    rows = [(1, 0, "user", "a", 0, ""), (1, 0, "user", "a", 0, ""), (1, 1, "assistant", "b" * 300, 0, ""), (1, 1, "assistant", "b" * 300, 0, "")]
    got = C.chat_digests(C.to_events(turns(spark, rows).repartition(3))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 1
    assert (got[0].n_turns, got[0].loss_chars) == (4, 600)
    assert got[0].turns_sha256 == sha("user\na\n" * 2 + f"assistant\n{'b' * 300}\n" * 2)
    assert got[0].loss_sha256 == sha("b" * 600)
