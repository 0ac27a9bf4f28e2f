import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, quality, toxicity
from quarry.llm.common import bounded_sample, id_fold

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op4_toxicity, "toxic", 0.95), (quality.op5_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = query(spark, SF)
    assert got.count() == docs.count()
    m = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    m = m[m.held_out]
    assert auc(m.score.to_numpy(), m[label].to_numpy()) > least
    assert ((m.score >= 0.3).astype(int) == m.predicted).all() and m.score.between(0, 1).all()


def test_language_accuracy(spark):
    got = langid.op6_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    got = got[got.held_out]
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_segments_against_their_definition():
    """Maximal: no prefix or suffix of a segment sums to 0 or less, and no
    segment with that property contains it."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = rng.integers(-5, 6, int(rng.integers(0, 14))).astype(float)

        def fine(a, b, s=s):
            part = s[a:b]
            return all(part[:k].sum() > 0 for k in range(1, len(part) + 1)) and all(part[k:].sum() > 0 for k in range(len(part)))

        every = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if fine(a, b)]
        want = {x for x in every if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in every)}
        got = toxicity.maximal_segments(s)
        assert {(a, b) for a, b, _ in got} == want
        assert all(v == pytest.approx(s[a:b].sum()) for a, b, v in got)


def test_segments_take_linear_time():
    import time

    def seconds(n):
        s = np.tile([1.0, -2.0], n // 2)
        began = time.perf_counter()
        assert len(toxicity.maximal_segments(s)) == n // 2
        return time.perf_counter() - began

    assert min(seconds(200_000) for _ in range(3)) <= 3 * min(seconds(100_000) for _ in range(3))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd, clashing, empty):
    labels = labels_of(spark, [(4, 1, 1), (5, 0, 0), (7, 1, 0), (9, None, None), (11, 0, 1), (99, 1, 1), (None, 1, 1)])
    for module, drop in ((toxicity, toxicity.drop_toxic), (quality, quality.keep_good)):
        model = module.fit(clashing, labels, F.lit(True))
        assert module.score(odd, model).count() == odd.count() and module.score(empty, model).count() == 0
        left = drop(clashing, model)
        assert left.columns == clashing.columns and left.count() <= odd.count()
        one = module.fit(odd, labels_of(spark, [(4, 1, 1)]), F.lit(True))
        assert {r.score for r in module.score(odd, one).collect()} == {1.0}
        none = module.fit(odd, labels_of(spark, []), F.lit(True))
        assert {r.score for r in module.score(odd, none).collect()} == {0.0}


def test_odd_languages(spark, odd, clashing, empty):
    model = langid.fit(clashing, id_fold("doc_id", 4) != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect() if r.doc_id}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert all(lang in ("en", "fr", "de") for i, (lang, _) in got.items() if i > 3)
    assert langid.predict(empty, model).count() == 0
    untaught = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, untaught).collect()} == {"und"}


def test_each_language_model_is_a_distribution():
    table = langid.class_table(["the cat sat on the mat and the rat ran"])
    grams, _ = langid.codes(["the cat sat on the mat", "a rat"], table)
    model = langid.KneserNey(grams)
    for context in np.unique(grams >> np.uint32(6))[:20]:
        every = (context << np.uint32(6)) + np.arange(64, dtype=np.uint32)
        assert np.exp(model.log_prob(every)).sum() == pytest.approx(1.0, abs=1e-6)


def test_languages_of_many_scripts(monkeypatch):
    """Languages are told apart whose letters aren't the sample's most frequent."""
    rng = np.random.default_rng(4)
    kinds = {"en": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 16), "zh": (0x4E00, 900), "ja": (0x5400, 900), "ko": (0xAC00, 900), "th": (0xE01, 40), "hi": (0x915, 36), "ne": (0x904, 17)}

    def text(first, n):
        return " ".join("".join(chr(first + int(n * x)) for x in rng.random(6)) for _ in range(30))

    rows = [(x, text(*kinds[x])) for _ in range(30) for x in kinds]
    model = langid.LanguageModel(pa.table({"label": [x for x, _ in rows], "text": [t for _, t in rows]}))
    unseen = [(x, text(*kinds[x])) for _ in range(10) for x in kinds]
    cold, p = model.predict([t for _, t in unseen])
    assert cold == [x for x, _ in unseen] and (p > 0.5).all()
    warm, q = model.predict([t for _, t in unseen])
    assert warm == cold and (p == q).all()
    monkeypatch.setattr(langid, "CACHE_BYTES", 1 << 12)
    model._cache = None
    for _ in range(2):
        few, q = model.predict([t for _, t in unseen])
        assert few == cold and (p == q).all()


def test_codes_keep_texts_apart():
    table = langid.class_table(["ab ba"])
    both, off = langid.codes(["ab", "", None or "  ", "b-a"], table)
    alone = [langid.codes([t], table)[0] for t in ("ab", "", "  ", "b-a")]
    assert [both[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [x.tolist() for x in alone]
    assert langid.codes([" ab. "], table)[0].tolist() == alone[0].tolist()


def test_a_huge_text_leaves_its_label_the_rest(spark):
    rows = [(i, "de" if i % 2 else "en", f"text {i} " * 20) for i in range(200)]
    first = spark.createDataFrame(rows, "doc_id long, lang string, text string").where("lang = 'de'").orderBy(F.xxhash64("doc_id")).first().doc_id
    rows = [(i, x, "z" * 300_000 if i == first else t) for i, x, t in rows] + [(7, "de", "another text of id 7"), (999, "fr", "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.where("doc_id < 200").select("doc_id", (F.col("lang") == "de").cast("int").alias("label")).distinct()
    got, totals = bounded_sample(docs, labels, 80, 400_000, 2)
    label = got.column("label").to_pylist()
    assert (label.count(0), label.count(1)) == (80, 80) and totals == {0: 100, 1: 100}
    own = docs.select("doc_id", F.col("lang").alias("label"), "text")
    got, totals = bounded_sample(docs, own, 800, 400_000, 4)
    seen = list(zip(got.column("doc_id").to_pylist(), got.column("label").to_pylist(), got.column("text").to_pylist(), strict=True))
    assert sorted(seen) == sorted((i, x, t) for i, x, t in rows if i != first) and totals == {"de": 101, "en": 100, "fr": 1}
