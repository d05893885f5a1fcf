import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark import cloudpickle

from strandwise.llm import blocks
from strandwise.llm.lm_scoring import SUM
from strandwise.llm.suffix_dedup import PREFIXES
from strandwise.llm.workspace import Workspace

KEYS = 400
# Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def own_keys(chunk):
    rng = np.random.default_rng(chunk)
    keys = np.unique(rng.integers(0, 1 << 20, KEYS, dtype=np.uint64) * blocks.U64(0x9E3779B97F4A7C15))
    return keys, np.arange(1, len(keys) + 1)


def send(row):
    keys, counts = own_keys(row["chunk_id"])
    return keys, (counts,)


def table(spark, n):
    return spark.range(n).withColumnRenamed("id", "chunk_id").repartition(8)


def want(n):
    total = {}
    for c in range(n):
        for k, v in zip(*own_keys(c), strict=True):
            total[int(k)] = total.get(int(k), 0) + int(v)
    return total


@pytest.mark.parametrize(("bits", "fan"), [(3, 10), (6, 2), (5, 3)])
def test_sums_whatever_the_hops(spark, bits, fan):
    ws = Workspace(spark, "blocks")
    got = blocks.exchange(ws, "sums", table(spark, 60), send, SUM, bits, fan).collect()
    total = want(60)
    assert len(got) == 60
    for r in got:
        keys, _ = own_keys(r.chunk_id)
        assert blocks.told(SUM, [x.asDict() for x in r.replies]).tolist() == [total[int(k)] for k in keys]


def test_messages_grow_in_proportion(spark):
    fan, a_chunk = 2, {}
    for n in (100, 400, 1600):
        ws = Workspace(spark, f"blocks{n}")
        chunks = table(spark, n)
        bits = int(np.ceil(np.log2(n / blocks.CHUNKS_PER_RANGE)))
        blocks.exchange(ws, "sums", chunks, send, SUM, bits, fan).count()
        hops = sorted(int(x[len("sums_hop") :]) for x in ws.saved if x.startswith("sums_hop"))
        sizes = [spark.read.parquet(ws.path(f"sums_hop{h}")).selectExpr("sum(size(chunks)) as n", "count(*) as rows").first() for h in hops]
        last = spark.read.parquet(ws.path(f"sums_above{hops[-1]}")).selectExpr("sum(size(replies)) as n").first().n
        for s in [*[x.n for x in sizes], last]:
            assert s <= n * 2**fan * 1.6  # rows of a hop are n rounded up to a power of 2
        a_chunk[n] = (sum(x.n for x in sizes) + last) / n / (len(hops) + 1)
        ws.close()
    # A direct exchange would send n / CHUNKS_PER_RANGE messages a chunk.
    assert max(a_chunk.values()) <= 1.7 * min(a_chunk.values())


def test_documents_of_6_and_30_gb_go_in_one_hop():
    # op8 has 420 chunks at 0.51 GB of input.
    for gb, most in ((0.5, 4), (6, 8), (30, 16)):
        n = int(gb * 824)
        bits = blocks.range_bits(SimpleNamespace(count=lambda n=n: n))
        assert bits <= blocks.FAN_BITS and n / 2**bits <= most
        assert 2**bits <= (1024 if gb <= 6 else 2048)


@pytest.mark.parametrize("how", [SUM, PREFIXES])
def test_a_range_is_settled_in_parts(monkeypatch, how):
    rng = np.random.default_rng(1)
    messages = []
    for _ in range(30):
        keys = np.unique(rng.integers(0, 2000, 300, dtype=np.uint64) * blocks.U64(0x9E3779B97F4A7C15))
        values = (rng.integers(1, 9, len(keys)),) if how is SUM else (rng.integers(0, 2, len(keys)).astype("<u4"), rng.integers(0, 99, len(keys)))
        messages.append((blocks.pack_sorted(keys), how.pack(values)))
    sent = [list(x) for x in zip(*messages, strict=True)]
    whole = how.answers(*sent)
    sizes, merge = [], how.merge
    monkeypatch.setattr(blocks, "PART_KEYS", 500)
    monkeypatch.setattr(how, "merge", lambda each, own: sizes.append(sum(map(len, each))) or merge(each, own))
    assert how.answers(*sent) == whole
    assert max(sizes) <= 1000 and sum(sizes) == sum(len(blocks.unpack_sorted(k)) for k in sent[0])
    # What a hop sends on, and the way back, are the same.
    kept = [(k, r) for k, r, *_ in how.parts(*sent)]
    assert np.array_equal(np.concatenate([k for k, _ in kept]), np.sort(np.concatenate([k for k, _ in kept])))
    above = [how.pack_told(np.concatenate([r[0] if how is SUM else np.zeros(len(k), bool) for k, r in kept]))]
    assert how.answers(*sent, above) == whole


def test_settling_a_range_takes_little_memory():
    rng = np.random.default_rng(2)
    messages = [(np.sort(rng.integers(0, 1 << 63, 40000, dtype=np.uint64)), (np.ones(40000, np.int64),)) for _ in range(60)]
    keys, data = [blocks.pack_sorted(k) for k, _ in messages], [SUM.pack(v) for _, v in messages]
    del messages
    tracemalloc.start()
    SUM.answers(keys, data)
    peak = tracemalloc.get_traced_memory()[1] / (60 * 40000)
    tracemalloc.stop()
    # Keys, values and answers are 24 bytes a key.
    assert peak < 50
