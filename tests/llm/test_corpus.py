import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing, packing, warc
from quarry.llm.common import byte_view, words

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKED)


# ------------------------------------------------------------------------ packing


def check_packing(docs, rows):
    t = Tokenizer.from_file(PATHS[0])
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[(i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))] += 1
    parts = defaultdict(list)
    for r in rows:
        parts[(r.doc_id, r.doc_tokens)].append(r)
    got = Counter()
    for (i, n), own in parts.items():
        own.sort(key=lambda r: (r.start, r.sequence_id, r.offset))
        copies = len(own) and sum(r.start == 0 for r in own)
        assert sum(r.length for r in own) == n * copies
        if copies == 1:
            raw = b"".join(bytes(r.ids) for r in own)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
            assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in own)
            got[(i, zlib.crc32(raw), n)] += 1
        else:
            for key in want:
                if key[0] == i and key[2] == n:
                    got[key] += want[key]
    assert got == want
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at[:-1])]).tolist()
    assert all(r.offset + r.length <= 2048 for r in rows)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing([tuple(r) for r in docs.select("doc_id", "text").collect()], packing.pack(docs, *PATHS, shard_tokens=20000, with_ids=True).collect())


def test_packing_odd_rows(odd, clashing, empty):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check_packing(docs, packing.pack(clashing, *PATHS, with_ids=True).collect())
    assert packing.pack(empty, *PATHS).count() == 0


def test_reruns_agree_on_rows_that_share_an_id_or_have_none(spark, monkeypatch):
    """Many rows share an id or have none, and tie in size; their order on arrival
    must not matter."""
    rows = [(None if k % 3 else 7, f"text number {k:04d} of its source", "ab"[k % 2]) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "GROUP_SHARDS", 3)
    first, again = (packing.pack(df.repartition(n), *PATHS, shard_tokens=500).collect() for n in (2, 5))
    assert sorted(map(str, first)) == sorted(map(str, again))
    at = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in first)
    assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at[:-1])]).tolist()
    monkeypatch.setattr(mixing, "_BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "_GROUP_BUCKETS", 4)
    plan = mixing.Mix(df.repartition(3))
    places = sorted((r.source, r.start, r.size) for r in plan.documents.collect())
    for source in "ab":
        own = [x[1:] for x in places if x[0] == source]
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist()
    one, two = (sorted(map(str, mixing.Mix(df.repartition(n)).taken().collect())) for n in (2, 5))
    assert one == two


def test_windows_keep_proportions():
    rng = np.random.default_rng(0)
    src, tokens = rng.integers(0, 3, 600), rng.integers(1, 900, 600)
    share = np.bincount(src, tokens) / tokens.sum()
    doc, start, length, pos = packing.round_robin(src, tokens, share, 5000, np.array([5000.0, 0, 0]) * 0 + share * 5000)
    assert length.sum() == tokens.sum() and (np.bincount(doc, length) == tokens).all()
    assert pos[0] == 5000 and (np.diff(pos) == length[:-1]).all() and (pos // 2048 == (pos + length - 1) // 2048).all()
    for upto in range(20, len(doc) - 60, 50):  # never far from the target
        served = np.bincount(src[doc[:upto]], length[:upto], 3)
        assert np.abs(served - share * served.sum()).max() < 2 * 2048


TEXT = st.text(st.sampled_from([*map(chr, range(32, 127)), *"\n\r\t éßÑıĸ'日\x85\xa0　"]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_both_encoders_agree(texts):
    key = PATHS
    e = packing._encoders.setdefault(key, packing.TextEncoder(*key))
    want = [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(pa.array(texts)) == want


def test_added_tokens_in_texts():
    t = Tokenizer.from_file(PATHS[0])
    literals = [x.content for x in t.get_added_tokens_decoder().values()]
    assert literals
    texts = ["plain", "", *(x for s in literals for x in (s, f"one{s}two", f"{s} é {s}", s[:-1], s + "x" * 500)), "plain", literals[0][:4], literals[0][4:]]
    e = packing.TextEncoder(*PATHS)
    assert e.encode(pa.array(texts)) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    assert e.plain(*byte_view(pa.array(["plain", literals[0], "", literals[0][:-1]]))).tolist() == [True, False, True, True]


# ------------------------------------------------------------------------- mixing


def test_targets():
    assert mixing.reach_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.reach_targets([1000, 10, 100], [1, 2, 3]) == pytest.approx([780, 30, 300])
    assert mixing.reach_targets([0, 10], [1, 2]) == pytest.approx([0, 10])
    assert mixing.reach_targets([], []) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


@pytest.mark.parametrize("stratum", [4, 1 << 17])
def test_shards_add_up(stratum):
    totals = np.array([1000, 0, 377, 5, 9000])
    shards = -(-int(totals.sum()) // 100)
    at = np.zeros(5, int)
    for k in range(shards):
        before, here = mixing.shard_counts(totals, k, per_shard=100, stratum=stratum)
        assert (before == at).all() and here.sum() == min(100, totals.sum() - 100 * k)
        at = at + here
    assert (at == totals).all()


def test_mixing_meets_targets_and_repeats(spark):
    rows = mixing.op10_mixing(spark, SF).collect()
    again = mixing.op10_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == docs.keys()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s = docs[r.doc_id].source
        _, _, off = words(*byte_view(pa.array([docs[r.doc_id].text])))
        assert r.size == off[1] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        size[s] += r.size
        target[s] = (r.target, r.source_size)
    names = sorted(size)
    want = mixing.reach_targets([size[s] for s in names], [k % 3 + 1 for k in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert target[s] == (pytest.approx(t), size[s]) and abs(taken[s] - t) <= 2 * mixing.BLOCK_WORDS


def test_mixing_odd_rows(odd, clashing, empty):
    rows = mixing.Mix(clashing).taken().collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.Mix(empty).taken().count() == 0
    merged = clashing.dropDuplicates(["doc_id", "text"])
    mixed = mixing.mixed_documents(merged)
    assert mixed.columns == clashing.columns
    by_doc = Counter()
    for r in mixed.collect():
        by_doc[r.doc_id] += len(words(*byte_view(pa.array([r.text])))[0])
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.Mix(merged).taken().collect():
        want[r.doc_id] += r.taken
    assert +by_doc == +want


# --------------------------------------------------------------------------- WARC


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_chunked_framing(body, frame):
    assert warc.decode_chunked(warc._chunked(body, frame)) == body
    with pytest.raises(ValueError):
        warc.decode_chunked(warc._chunked(body, frame)[:-6])


def test_warc_odd_rows(spark):
    long, dup = "<p>é" * 20000, "same payload " * 20
    rows = [(1, "u", long), (2, None, None), (3, "a b", ""), (5, "u", dup), (4, "u", dup), (4, "v", dup), (6, "u", dup[:50]), (7, "u", dup[:50]), (None, "u", "no id"), (None, "u", dup), (8, "u\r\nx", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(df, segment_bytes=900, keep_payload=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.status) for r in got) == Counter(
        (i, "revisit" if ref else "response", ref, len((h or "").encode()), "ok")
        for (i, _, h), ref in zip(rows, [None, None, None, 4, None, None, None, None, None, 4, 1], strict=True)
    )
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id} == {1: long, 2: "", 3: "", 4: dup, 6: dup[:50], 7: dup[:50]}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damaged_archives_say_so(spark):
    import gzip

    records = list(warc.page_records(1, 1, "u", b"x" * 5000, "0" * 64, None, segment_bytes=1000))
    short = [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in warc.page_records(3, 3, "u", b"y" * 5000, "0" * 64, None, segment_bytes=1000)]
    plain = list(warc.page_records(4, 4, "u", b"z", "0" * 64, None))
    blobs = [("a", b"".join(map(gzip.compress, [*records[:2], *plain]))), ("b", b"".join(map(gzip.compress, [*records[3:], *reversed(short)])))]
    got = {r.page_id: r.status for r in warc.read_archives(spark.createDataFrame(blobs, "name string, content binary")).collect()}
    assert got == {1: "missing_segment", 3: "length_mismatch", 4: "digest_mismatch"}


# ----------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= seen and len(ids) > 0.5 * len(seen), name
        docs, seen = after, ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == seen


def test_the_near_duplicate_stage_against_sql(spark):
    import duckdb

    from quarry.llm import minhash

    path = f"{SF}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{path}')")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({minhash.near_sql(5, 80)}) WHERE kept").fetchall()}
    docs = spark.read.parquet(path)
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()} == want


def test_pipeline_on_odd_and_empty_tables(spark, clashing, tmp_path):
    labels = [(4, 1, 0), (5, 0, 1), (7, 1, 0), (9, 1, 0), (11, None, None), (99, 0, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path)).cache()
        assert after.columns == clashing.columns and after.count() >= 0, name
        docs = after if after.count() else docs
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    clashing.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
