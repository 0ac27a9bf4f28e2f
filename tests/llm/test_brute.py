"""The three learned operators against plain Python versions of their definitions."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, quality, toxicity
from quarry.llm.common import bounded_sample

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1
ODD = ["", "one", "  two\tblank  runs\n", "é ß ıİ 日本語 naïve", "a" * 30, "x y z x y z x y z x y z", "\x00\x1f mixed\x85odd", "ab\x0bcd\x0cef"]


def mix(h):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ h >> 33) * k) & M64
    return h ^ h >> 33


def word_hash(word):
    total = sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(word))
    return mix((total ^ len(word) << 48) & M64)


def sample(spark, label):
    """Texts and labels that a model is fitted on, and the labels' numbers."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labelled = labels.select("doc_id", F.col(label).alias("label"))
    table, totals = bounded_sample(docs, labelled, 60, 1 << 20, 2)
    return table, totals, [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ODD


# ------------------------------------------------------------------------ quality


def quality_features(text):
    data = text.encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", data)
    yield from (word_hash(w) % (quality.BUCKETS - 1) + 1 for w in found)
    trigrams = list(zip(found, found[1:], found[2:]))
    yield from [0] * (len(trigrams) - len(set(trigrams)))
    for n in quality.GRAMS:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if not re.search(rb"[\x20\x09-\x0D]", gram[1:-1]):
                h = n
                for c in gram:
                    h = (h * 0x100000001B3 & M64) ^ c
                yield mix(h) % (quality.BUCKETS - 1) + 1


def test_quality_scores(spark):
    table, totals, texts = sample(spark, "quality")
    model = quality.QualityModel(table, totals)
    assert model.a != 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    assert {p for _, p in got.values()} == {0, 1}
    for k, text in enumerate(texts):
        own = [float(model.margin[f]) for f in quality_features(text)]
        want = 1 / (1 + math.exp(-(model.a * sum(own) / max(1, len(own)) + model.b)))
        assert got[k] == (pytest.approx(want, abs=1e-6), int(got[k][0] >= 0.3)), text


def test_quality_training_follows_the_gradient(monkeypatch):
    """One step of one document moves the margin down the softmax loss: by rate
    times the gradient, over the squared feature weight."""
    for name, value in (("EPOCHS", 1), ("DIM", 3)):
        monkeypatch.setattr(quality, name, value)
    texts, y = ["good words here", "bad words there"], [1, 0]
    model = quality.QualityModel(pa.table({"label": y, "text": texts}), {0: 1, 1: 1})
    rng = np.random.default_rng(quality.SEED)
    vectors = rng.uniform(-0.5, 0.5, (quality.BUCKETS, 3)) / 3
    layer = rng.uniform(-0.5, 0.5, (2, 3))
    for done, d in enumerate(rng.permutation(np.arange(2))):
        count = Counter(quality_features(texts[d]))
        share = {f: c / sum(count.values()) for f, c in count.items()}
        mean = sum(w * vectors[f] for f, w in share.items())
        p = np.exp(layer @ mean) / np.exp(layer @ mean).sum()
        slope = p - np.eye(2)[y[d]]
        rate = quality.RATE * (1 - done / 2)
        back = layer.T @ slope
        layer = layer - rate * np.outer(slope, mean)
        for f, w in share.items():
            vectors[f] = vectors[f] - rate * w / sum(x * x for x in share.values()) * back
    assert model.margin == pytest.approx(vectors @ (layer[1] - layer[0]), abs=1e-5)


# ----------------------------------------------------------------------- toxicity


def alnum_words(text):
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]


def segments_by_definition(s):
    """Maximal stretches all of whose prefixes and suffixes have positive sums."""
    n, total = len(s), np.concatenate([[0.0], np.cumsum(s)])
    out, done = [], 0
    fine = [(a, b) for a in range(n) if s[a] > 0 for b in range(n, a, -1) if total[a] < total[a + 1 : b + 1].min() and total[b] > total[a:b].max()]
    for a, b in sorted(fine, key=lambda x: (x[0], -x[1])):
        if b > done:
            out.append((a, b, total[b] - total[a]))
            done = b
    return out


def test_toxicity_scores(spark):
    table, totals, texts = sample(spark, "toxic")
    model = toxicity.ToxicityModel(table, totals)
    assert model.weights is not None
    # the words' scores: a word counts once with each word before it
    seen = {0: set(), 1: set()}
    for text, y in zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True):
        w = alnum_words(text)
        seen[y].update(zip(w, [None, *w[:-1]], strict=True))
    count = {y: Counter(w for w, _ in pairs) for y, pairs in seen.items()}
    whole = {y: sum(c.values()) for y, c in count.items()}
    scores, prior = {}, toxicity.PRIOR
    for w in count[0] | count[1]:
        c1, c0 = count[1][w], count[0][w]
        odds = math.log((c1 + prior) / (whole[1] + prior - c1)) - math.log((c0 + prior) / (whole[0] + prior - c0))
        width = 1.96 * math.sqrt(1 / (c1 + prior) + 1 / (c0 + prior))
        if abs(odds) > width:
            scores[w] = math.copysign(abs(odds) - width, odds)
    assert dict(zip(model.words.tolist(), model.scores.tolist(), strict=True)) == pytest.approx({word_hash(w): v for w, v in scores.items()})
    # texts' scores, by the definition of a segment
    toxic = [t for t, y in zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True) if y == 1][:10]
    texts = [t[:1500] for t in texts + toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(len(r.passages) for r in got.values()) >= 5 and {r.predicted for r in got.values()} == {0, 1}
    for k, text in enumerate(texts):
        w = alnum_words(text)
        pairs = list(zip([None, *w[:-1]], w, strict=True)) if w else []
        s = [scores.get(x, 0.0) - toxicity.DRIFT for x in w]
        s = [-toxicity.DRIFT if v > 0 and pairs[i] in pairs[:i] else v for i, v in enumerate(s)]
        found = segments_by_definition(np.array(s))
        expected = [model.k * len(w) * math.exp(-model.lam * v) for _, _, v in found]
        wanted = [(a, b) for (a, b, _), e in zip(found, expected, strict=True) if e < toxicity.E_VALUE]
        assert [(p.first_word, p.end_word) for p in got[k].passages] == wanted
        x = (0.0, 0.0)
        if found:
            rare = -math.log(max(-math.expm1(-min(expected)), 1e-200))
            x = math.log1p(min(500, rare)), math.log1p(sum(v for _, _, v in found if model.k * len(w) * math.exp(-model.lam * v) < toxicity.E_VALUE) * model.lam)
        z = float(model.weights @ [*x, 1.0])
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[k].predicted == int(got[k].score >= 0.3)


def test_a_repeated_word_is_no_passage(spark):
    """A text that is copied often teaches nothing, and one that repeats a faintly
    toxic word isn't toxic for it."""
    clean = [f"plain text {k} about things {k * k} and more of {k % 7} it" for k in range(60)] + [f"faint {k} one and {k}" for k in range(12)]
    toxic = [f"plain text {k} vile about things awful and {k} vile awful of it" for k in range(60)] + ["copied line of chance"] * 30 + [f"faint {k} two" for k in range(60)]
    rows = [(t, 0) for t in clean] + [(t, 1) for t in toxic]
    model = toxicity.ToxicityModel(pa.table({"label": [y for _, y in rows], "text": [t for t, _ in rows]}), {0: len(clean), 1: len(toxic)})
    scores = dict(zip(model.words.tolist(), model.scores.tolist(), strict=True))
    assert scores[word_hash(b"vile")] > 1 and word_hash(b"chance") not in scores
    docs = spark.createDataFrame([(1, "and vile"), (2, "and " + "vile " * 300), (3, "vile x vile y vile z vile")], "doc_id long, text string")
    one, often, apart = (model.word_scores(np.array([word_hash(w) for w in alnum_words(r.text)], np.uint64), np.array([0, len(alnum_words(r.text))])) for r in docs.orderBy("doc_id").collect())
    assert (one > 0).sum() == 1 and (often > 0).sum() == 2 and (apart > 0).sum() == 4
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(p.end_word - p.first_word <= 2 for p in got[2].passages)


# ---------------------------------------------------------------------- languages


def symbols(text, letters):
    """A letter of the sample as itself, another as `?`, a run of the rest as a space."""
    out = []
    for c in text:
        own = c.lower() if c.lower() in letters else "?" if unicodedata.category(c)[0] == "L" else " "
        if own != " " or (out and out[-1] != " "):
            out.append(own)
    while out and out[-1] == " ":
        out.pop()
    return "   " + "".join(out) + " " if out else ""


def ngrams(text, letters):
    s = symbols(text, letters)
    return [s[i : i + 4] for i in range(len(s) - 3)]


class Plain:
    """Interpolated Kneser-Ney over strings, straight from its formula."""

    def __init__(self, texts, letters, size):
        self.size, self.count = size, {4: Counter(g for t in texts for g in ngrams(t, letters))}
        for n in (3, 2, 1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.after = {n: defaultdict(list) for n in self.count}
        for n, found in self.count.items():
            for g, c in found.items():
                self.after[n][g[:-1]].append(c)

    def p(self, gram, n=4):
        if n == 0:
            return 1 / self.size
        own = gram[4 - n :]
        below, after = self.p(gram, n - 1), self.after[n].get(own[:-1])
        if not after:
            return below
        return (max(0, self.count[n][own] - langid.DISCOUNT) + langid.DISCOUNT * len(after) * below) / sum(after)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    table = bounded_sample(docs, docs.select("doc_id", F.col("lang").alias("label"), "text"), 12, 1 << 18, 8)[0]
    model = langid.LanguageModel(table)
    texts, label = table.column("text").to_pylist(), table.column("label").to_pylist()
    letters = {c for c in "".join(texts).lower() if c.isalpha()}
    assert len(letters) <= langid.ALPHABET
    plain = {x: Plain([t for k, (t, y) in enumerate(zip(texts, label, strict=True)) if y == x and k % 5 != 4], letters, langid.ALPHABET + 2) for x in sorted(set(label))}
    asked = [r.text[:400] for r in docs.orderBy("doc_id").limit(60).collect()] + ODD + ["ÀÉÎ Ωμέγα", "Straße, été; 123 mañana!"]
    got = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    assert len({r.lang_pred for r in got}) > 3 and len(got) == len(asked)
    for r in got:
        grams = ngrams(asked[r.doc_id], letters)
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cost = sorted((-sum(math.log(m.p(g)) for g in grams) / len(grams), x) for x, m in plain.items())
        lead = (cost[1][0] - cost[0][0]) * math.sqrt(len(grams))
        if lead > 1e-4:  # tables hold single precision
            assert r.lang_pred == cost[0][1], asked[r.doc_id]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.a * lead + model.b)))), abs=1e-4)


def test_more_languages_than_are_learned(spark):
    rows = [(k, x, f"words of {x} number {k}") for k in range(9) for x in "abcd" if k < 9 - "dacb".index(x)]
    docs = spark.createDataFrame([(i, x, t) for i, (_, x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    table, totals = bounded_sample(docs, docs.select("doc_id", F.col("lang").alias("label"), "text"), 5, 1 << 20, 2)
    assert totals == {"d": 9, "a": 8} and Counter(table.column("label").to_pylist()) == {"d": 5, "a": 5}
