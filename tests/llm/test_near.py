import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, embeddings, minhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(docs, width, percent):
    """Component of each (id, text)."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None:
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if r not in least or (i is not None and i < least[r]) else least[r]
    return [(i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets)]


def same(rows, want):
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=key) == sorted(want, key=key)


def test_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(minhash.op3_minhash(spark, SF).collect(), brute(docs, 3, 85))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_sql(spark, width, percent):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.read.parquet(path), width, percent).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{path}')")
    want = {r[0]: r[1:] for r in con.execute(minhash.near_sql(width, percent)).fetchall()}
    assert got == want and sum(not x[2] for x in want.values()) > 10


def test_odd_rows_and_the_dedup_stage(odd, clashing, empty):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(minhash.near_duplicates(clashing, 3, 85).collect(), brute(docs, 3, 85))
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.deduplicate(clashing)
    assert left.columns == clashing.columns and minhash.deduplicate(empty).count() == 0
    ids = [r.doc_id for r in left.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, None, None, 7, 9, 10, 11, 11]))


def test_a_repeated_id_with_texts_of_different_groups(spark):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, " ".join([*a, "end"])), (9, " ".join([*b, "end"])), (5, " ".join([*b[:30], *a[:30]])), (5, "alone here it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert sorted(x[2] for x in want) == [3, 3, 5, 5, 7, 7]
    same(minhash.near_duplicates(df, 3, 85).collect(), want)
    assert rows[1] in [tuple(r) for r in minhash.deduplicate(df, 3, 85).collect()]


def test_a_large_group_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert len({x[2] for x in want}) > 2
    same(minhash.near_duplicates(df, 3, 85).collect(), want)
    monkeypatch.setattr(minhash, "TILE_BYTES", 4096)
    same(minhash.near_duplicates(df, 3, 85).collect(), want)
    monkeypatch.setattr(minhash, "TILE_ROWS", 7)
    same(minhash.near_duplicates(df, 3, 85).collect(), want)


def test_the_signature_floor_adds_little_to_the_bands_miss():
    for t in (0.8, 0.85):
        floor = minhash.signature_floor(t)
        tail = sum(math.comb(80, m) * t**m * (1 - t) ** (80 - m) for m in range(floor))
        assert 0 < tail < (1 - t**4) ** 20 / 100
    # 53 equal minima of 80, under the former floor, and a band in common
    sig = np.arange(160, dtype=np.uint32).reshape(2, 80)
    sig[1, :53] = sig[0, :53]
    sets = [np.arange(100, dtype=np.uint64), np.arange(92, dtype=np.uint64)]
    zeros = np.zeros(2, int)
    assert minhash.link_bucket(np.array([1, 2]), np.array([1, 2]), zeros, sig, sets, 0, 85, False) == [(1, 2)]


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 130)]
    edges = spark.createDataFrame([*path, *((7, k) for k in range(50, 90)), (3, 3)], "a long, b long")
    got = {r.id: r.component for r in components.connected_components(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, 7: 7, **{k: 7 for k in range(50, 90)}, 3: 3}


def test_vectors_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    rows = [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]
    extra = [(900, 1, None), (901, 1, [0.0] * 64), (902, 1, [float("nan")] + [1.0] * 63), (903, None, rows[0][2]), (904, 1, [None] + [1.0] * 63), (905, 1, []), (906, rows[0][1], rows[0][2]), (906, rows[0][1], rows[0][2]), (907, 1, [1.0, 2.0]), (908, 1, [2.0, 4.0]), (None, 1, [5.0, 1.0])]
    rows += extra
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("count", F.lit(1))
    fine = [label is not None and bool(v) and None not in v and all(map(np.isfinite, v)) and any(v) for _, label, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        f = find(k)
        least[f] = min((v for v in (least.get(f), r[0]) if v is not None), default=None)
    want = [(r[0], n[k], least[find(k)], r[0] == least[find(k)]) for k, r in enumerate(rows)]
    key = lambda x: tuple(map(str, x))
    for tile in (2048, 4):
        embeddings.TILE = tile
        got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    embeddings.TILE = 2048
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall_with_production_tables(spark):
    """Vectors whose links lie about the threshold, in tables of more than 4 bits."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 48))
    near = base[rng.integers(0, 600, 3400)]
    near = near + rng.uniform(0.2, 0.45, (len(near), 1)) * rng.standard_normal(near.shape)
    x = np.vstack([base, near]).astype(np.float32)
    assert embeddings.plan_tables(len(x), bucket=64)[0] > 4
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert 500 < want.sum()
    old, embeddings.plan_tables.__defaults__ = embeddings.plan_tables.__defaults__, (0.93, 64, 1e-5)
    try:
        got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    finally:
        embeddings.plan_tables.__defaults__ = old
    got = np.array([got[k] for k in range(len(x))])
    assert (got <= want).all() and got.sum() / want.sum() > 0.999


def test_the_sketch_loses_little_of_the_allowed_miss():
    p, limit = math.acos(0.93) / math.pi, embeddings.sketch_limit()
    tail = sum(math.comb(128, d) * p**d * (1 - p) ** (128 - d) for d in range(limit + 1, 129))
    bits, tables = embeddings.plan_tables(10**6)
    assert tail <= embeddings.MISS / 10 and (1 - (1 - p) ** bits) ** tables + tail <= embeddings.MISS
