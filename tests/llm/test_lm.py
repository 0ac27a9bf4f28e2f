import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm
from quarry.llm.common import id_fold

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def brute(docs):
    """(id, held, tokens, known, N, base, score) of each text, from plain counts."""
    train, after, pairs = Counter(), {}, Counter()
    for i, text in docs:
        if not held(i):
            own = tokens(text)
            train.update(own)
            pairs.update(zip([None, *own], own, strict=False))
    level = {k: float(lm.LogBloom.count_of(lm.LogBloom.quantise(np.array([c])))[0]) for k, c in pairs.items()}
    for (u, _), c in level.items():
        kinds, total = after.get(u, (0, 0.0))
        after[u] = kinds + 1, total + c
    n, v = sum(train.values()), len(train)
    out = []
    for i, text in docs:
        own, base, score = tokens(text), 0.0, 0.0
        for u, w in zip([None, *own], own, strict=False):
            p = (train[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if u in after:
                kinds, total = after[u]
                novel = kinds / (kinds + train[u])
                p = (1 - novel) * level.get((u, w), 0.0) / total + novel * p
            score += math.log10(p)
        out.append((i, held(i), len(own), sum(train[t] > 0 for t in own), n, base, score))
    return out


def check(docs, rows):
    want = brute(docs)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:5], round(x[5], 5))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], abs=2e-6 * x[2]) for x, y in zip(got, want, strict=True))


def test_base_and_counts_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op1_lm(spark, SF).collect()
    check(docs, rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(odd, clashing, empty):
    fold = id_fold("doc_id", 7) == 2
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(docs, lm.score(odd, fold).collect())
    check(docs, lm.score(clashing, fold).collect())
    assert lm.score(empty, fold).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(odd, F.lit(True)).collect())


def test_broadcast_segments_and_hot_words_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fold = id_fold("doc_id", 7) == 2
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    check(rows, lm.score(docs, fold).collect())
    monkeypatch.setattr(lm, "BROADCAST_TOKENS", 0)
    check(rows, lm.score(docs, fold).collect())
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", 2000)
    check(rows, lm.score(docs, fold).collect())
    state = lm.blocks(docs.select("doc_id", "text"), fold)
    assert any(k > 2 for k in lm._hot_words(state, 40_000).values())
    monkeypatch.setattr(lm, "BROADCAST_TOKENS", 1 << 30)
    check(rows, lm.score(docs, fold).collect())


def test_base_in_sql(spark):
    import duckdb

    sql = r"""
    WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [''] AS t FROM read_parquet($path)),
    word AS (SELECT doc_id, unnest(t) AS w FROM doc), held AS (SELECT unnest($held) AS doc_id),
    train AS (SELECT w, count(*) AS c FROM word ANTI JOIN held USING (doc_id) GROUP BY w),
    n AS (SELECT sum(c) AS n, count(*) AS v FROM train)
    SELECT doc_id, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base, count(*) AS n_tokens, count(c) AS n_known
    FROM word LEFT JOIN train USING (w), n GROUP BY doc_id
    """
    rows = lm.op1_lm(spark, SF).collect()
    want = {r[0]: r[1:] for r in duckdb.execute(sql, {"path": f"{SF}/documents.parquet", "held": [r.doc_id for r in rows if held(r.doc_id)]}).fetchall()}
    assert len(want) == len(rows)
    for r in rows:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][1:] and r.base_score == pytest.approx(want[r.doc_id][0], rel=1e-9)


def test_filter_keeps_quantised_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64)
    counts = rng.zipf(1.6, 20000).clip(1, 10**6)
    bloom = lm.LogBloom(keys, counts)
    assert (bloom.levels(keys) == lm.LogBloom.quantise(counts)).all()
    assert (bloom.levels(rng.integers(0, 2**63, 200_000).astype(np.uint64)) == 0).all()
    few = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12])
    assert lm.LogBloom.quantise(few).tolist() == [0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7]
    assert lm.LogBloom.count_of(np.arange(8)).tolist() == [0, 1, 2, 3, 4.5, 6.5, 9.5, 13.5]


@pytest.mark.parametrize("probes", [lm.PROBES, 6])
def test_probabilities_through_the_filter_sum_to_one(monkeypatch, probes):
    """Over a whole vocabulary of followers, nearly all never seen; with few
    probes a good part of the mass is false hits, which Z gives back."""
    monkeypatch.setattr(lm, "PROBES", probes)
    monkeypatch.setattr(lm, "BITS_PER_ITEM", math.ceil(probes * 1.45))
    rng = np.random.default_rng(6)
    v, contexts, counts = 200_000, {1: 1, 10: 7, 100: 60, 5000: 900}, []
    word, fan, finger, pair_count = [], [], [], []
    for filler in range(3000):  # so that the filter is as full as it may be
        word.append(filler), fan.append(100), counts.append(100)
        finger.append(rng.integers(0, 2**32, 100)), pair_count.append(np.ones(100, np.int64))
    for k, (c, kinds) in enumerate(contexts.items()):
        split = np.sort(rng.choice(c - 1, kinds - 1, replace=False)) + 1 if kinds > 1 else np.zeros(0, np.int64)
        word.append(10**6 + k), fan.append(kinds), counts.append(c)
        finger.append(rng.choice(2**32, kinds, replace=False)), pair_count.append(np.diff(np.concatenate([[0], split, [c]])))
    s = lm.Segment(np.array(word, np.uint64), np.array(counts), np.array(fan), np.concatenate(finger).astype(np.uint32), np.concatenate(pair_count))
    for k, (c, kinds) in enumerate(contexts.items()):
        at = int(np.searchsorted(s.words, 10**6 + k))
        assert s.kinds_after[at] == kinds and s.count[at] == c
        every = np.concatenate([finger[3000 + k], rng.integers(0, 2**32, v - kinds)]).astype(np.uint32)
        pair = lm.LogBloom.count_of(s.bloom.levels(lm._key(np.full(v, s.words[at]), every)))
        c_word = np.full(v, 10)  # the base gives all v words and one unknown an equal share of nearly all
        base, p = lm.token_log10(c_word, np.full(v, c), np.full(v, kinds), np.full(v, s.sum_after[at]), pair, 10 * v, v, s.bloom.false_hit)
        assert (10**base).sum() == pytest.approx(1, abs=1e-5)
        hits = v * s.bloom.false_hit / s.sum_after[at]
        assert (10**p).sum() == pytest.approx(1, abs=0.01 if hits < 0.01 else 0.15)


def test_a_text_seen_twice_scores_higher(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, 120))) for k in range(300) if not held(k)]
    twice = rows[:20]
    df = spark.createDataFrame([*rows, *[(10_000 + 7 * i, t) for i, (_, t) in enumerate(twice)]], "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(df, id_fold("doc_id", 7) == 2).collect()}
    again = {i for (i, _), k in zip(twice, range(20), strict=True) if not held(10_000 + 7 * k)}
    assert min(got[i] for i in again) > max(got[i] for i, _ in rows if i not in {x for x, _ in twice})
