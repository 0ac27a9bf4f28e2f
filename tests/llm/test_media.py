import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import media

SF = "/root/testdata/sf0.001"


def check(docs, rows):
    want = []
    for i, text in docs:
        raw = (text or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.verified for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)


def test_round_trip_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, media.op2_media(spark, SF).collect())


def test_odd_rows(odd, clashing, empty):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(docs, media.read_store(media.write_store(odd)).collect())
    check(docs, media.read_store(media.write_store(clashing)).collect())
    assert media.read_store(media.write_store(empty)).count() == 0


def test_shared_chunks_are_stored_once(spark):
    body = " ".join(f"word{k * k % 9973}" for k in range(8000))
    docs = spark.createDataFrame([(k, f"{k} begins. " + body) for k in range(20)], "doc_id long, text string")
    store = media.write_store(docs)
    held = sum(len(r.body) for r in store.select("body").collect())
    assert held < 4 * len(body)
    rows = media.read_store(store, keep_payload=True).collect()
    assert {r.doc_id: bytes(r.payload).decode().rstrip() for r in rows} == {r.doc_id: r.text for r in docs.collect()}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=20000), max_size=5), st.integers(0, 9))
def test_cuts_cover_within_bounds(parts, seed):
    parts = parts + [np.random.default_rng(seed).bytes(30000)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    for p, ends in zip(parts, media.cuts(np.frombuffer(b"".join(parts), np.uint8), off), strict=True):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(p) and (sizes <= media.MOST).all() and (sizes[:-1] >= media.LEAST).all()


def test_a_cut_depends_on_content_alone():
    body = np.random.default_rng(3).bytes(60000)
    ends = []
    for lead in (b"", b"x" * 777):
        data = np.frombuffer(lead + body, np.uint8)
        ends.append({e - len(lead) for e in media.cuts(data, np.array([0, len(data)]))[0]})
    assert len(ends[0] & ends[1]) > 0.8 * len(ends[0])


def test_rows_that_repeat_id_and_text_stay_linear(spark):
    body = " ".join(f"word{k * k % 9973}" for k in range(3000))
    rows = [(1, body)] * 300 + [(2, "first " + body)] * 300 + [(None, body)] * 5
    store = media.write_store(spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, media.read_store(store).collect())


def test_what_is_hashed_is_what_is_stored(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    store = media.write_store(docs)
    heads = {r.doc_id: (bytes(r.head), bytes(r.body)) for r in store.collect()}
    for r in media.read_store(store).collect():
        medium = b"".join(heads[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(medium), hashlib.sha256(medium).hexdigest())
        assert media.read_head(heads[r.doc_id][0])[0] == r.n_bytes
