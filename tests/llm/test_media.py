import hashlib
import random
import tarfile
import zlib

from conftest import pairs_of

from strandwise.llm import media
from strandwise.llm.workspace import Workspace


def test_png_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.pad(bytes(rng.randrange(256) for _ in range(n)))
        assert len(payload) % 192 == 0 and len(payload) >= 192
        data = media.encode_png(payload)
        assert media.decode_png(data) == payload
        assert media.png_header(data[: media.HEADER]) == (64, len(payload) // 192, 8, 3)


def test_values_read_back(spark, odd_docs):
    got = media.media_columns(spark, odd_docs).collect()
    rows = pairs_of(odd_docs)
    assert len(got) == len(rows)
    want = sorted(((-(1 << 62) if i is None else i), hashlib.sha256(media.pad((t or "").encode())).hexdigest(), len((t or "").encode())) for i, t in rows)
    assert sorted(((-(1 << 62) if r.doc_id is None else r.doc_id), r.payload_sha256, r.n_bytes) for r in got) == want
    payloads = {hashlib.sha256(media.pad((t or "").encode())).hexdigest(): media.pad((t or "").encode()) for _, t in rows}
    for r in got:
        p = payloads[r.payload_sha256]
        assert (r.read_sha256, r.payload_bytes, r.tail_crc32, r.feature) == (r.payload_sha256, len(p), zlib.crc32(p[-16:]), media.feature(p))
        assert (r.width, r.height, r.channels) == (64, len(p) // 192, 3)
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes) for r in got}) == len(payloads)


def test_shards_are_tar_files(spark, odd_docs):
    ws = Workspace(spark, "media-test")
    manifest = ws.save(media.store(odd_docs, ws.path("shards")), "manifest").collect()
    for r in manifest:
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            data = tar.extractfile(f"{r.payload_sha256}.png").read()
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length) == data
        assert hashlib.sha256(media.decode_png(data)).hexdigest() == r.payload_sha256


def test_empty(spark, no_docs):
    assert media.media_columns(spark, no_docs).collect() == []
