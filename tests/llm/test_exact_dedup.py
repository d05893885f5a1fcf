import hashlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import pairs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import exact_dedup as E


@settings(max_examples=25, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=300), st.sets(st.binary(min_size=32, max_size=32), max_size=50))
def test_hash_is_minimal_and_perfect(keys, others):
    own = np.frombuffer(b"".join(hashlib.sha256(k).digest() for k in keys), np.uint8).reshape(-1, 32)
    sizes, bits, slots = E.build_mph(own)
    assert sorted(slots) == list(range(len(own)))
    assert (E.find_slots(own, sizes, bits) == slots).all()
    strange = np.frombuffer(b"".join(hashlib.sha256(k + b"!").digest() for k in others), np.uint8).reshape(-1, 32)
    assert (E.find_slots(strange, sizes, bits) < len(own)).all()


@pytest.mark.parametrize("upto", [None, -100, 5, 1000])
def test_rows(spark, odd_docs, upto):
    rows = pairs_of(odd_docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = E.exact_dedup(spark, odd_docs, upto).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for t, ids in groups.items():
        own = by[hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(ids))}
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert [r.doc_id for r in own if r.kept] == [best]


def test_empty(spark, no_docs):
    assert E.exact_dedup(spark, no_docs).collect() == []
