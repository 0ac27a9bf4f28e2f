"""Toxicity by maximum-scoring segments.

Fitting: on a bounded sample of labelled rows, each word gets the log-odds of
toxic against other documents under a Dirichlet prior, shrunk to the nearer end
of its 95 % interval (0 where that spans 0), less a drift that makes an average
word's score negative.  A word counts once with each word before it, so copies of
a text add nothing.  Scoring: where a text repeats a word after the same word,
that says nothing new and scores the drift only; a linear scan finds every
maximal-scoring segment of a text; under the clean documents' word scores a
segment of score S in n words has the extreme-value tail K n exp(-lambda S),
with lambda from the scores' distribution and K fitted on the clean documents'
best segments.  A document's score joins its best segment's and its significant
segments' evidence in a logistic calibration, weighted back to the labels' own
proportions.

Defined cases: a null or empty text has no segment and gets the score of no
evidence; null labels and label rows without a document are not learned from; a
null doc_id is in fold crc32('') ; rows that repeat a doc_id are scored each;
labels without one of the classes give a constant score, their share of toxic
ones (0 if there are none); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NOT_ALNUM, bounded_sample, byte_view, fit_logistic, id_fold, mix64, release_memory, span_hashes, text_slices, words

#: The sample to fit on: rows of each label, and bytes of text in all.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 16 << 20
PRIOR = 0.5
DRIFT = 0.25
#: A segment is significant when fewer than this many like it are expected in a
#: clean document of the same length.
E_VALUE = 0.01
THRESHOLD = 0.3
_FOLDS, _HELD_OUT = 4, 2


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear
    time: each segment keeps the place of the last one before it with a lower sum
    at its start, so a search passes no segment twice.  Runs of positive scores
    enter as one step."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    gap = np.flatnonzero(np.diff(up) > 1)
    begins, ends = up[np.concatenate([[0], gap + 1])], up[np.concatenate([gap, [len(up) - 1]])] + 1
    stack: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum up to the end, lower one's place
    for b, e, lo, hi in zip(begins.tolist(), ends.tolist(), total[begins].tolist(), total[ends].tolist(), strict=True):
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= lo:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= hi:
                stack.append((b, e, lo, hi, j))
                break
            b, _, lo, _, lower = stack[j]
            del stack[j:]
            j = lower
    return [(b, e, hi - lo) for b, e, lo, hi, _ in stack]


def _hashed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the sample and the offsets of its texts, made
    a slice at a time to bound the driver's memory."""
    hashes, counts = [], []
    for part in text_slices(iter(table.to_batches()), "text"):
        data, off = byte_view(part.column("text"))
        starts, ends, word_off = words(data, off, NOT_ALNUM)
        hashes.append(span_hashes(data, starts, ends))
        counts.append(np.diff(word_off))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


class ToxicityModel:
    """Word scores and the calibration; at most the sample's words in size."""

    def __init__(self, table: pa.Table, totals: dict, prior: float = PRIOR, drift: float = DRIFT):
        y = np.array(table.column("label").to_pylist(), float) if table.num_rows else np.zeros(0)
        self.drift = drift
        self.words, self.scores = np.zeros(0, np.uint64), np.zeros(0)
        self.lam, self.k, self.weights = 1.0, 1.0, None
        n = sum(totals.values())
        self.constant = totals.get(1, 0) / n if n else 0.0
        n1, n0 = float((y == 1).sum()), float((y == 0).sum())
        if not n1 or not n0:
            return
        h, word_off = _hashed(table)
        doc = np.repeat(np.arange(len(y)), np.diff(word_off))
        vocabulary, at = np.unique(h, return_inverse=True)
        # a word counts once with each word before it, so copies of a text add nothing
        m = len(vocabulary) + 1
        before = np.concatenate([[m - 1], at[:-1]]).astype(np.int64)
        before[word_off[:-1][np.diff(word_off) > 0]] = m - 1
        pair, toxic = at.astype(np.int64) * m + before, y[doc] == 1
        c1, c0 = (np.bincount(np.unique(pair[side]) // m, minlength=m - 1).astype(float) for side in (toxic, ~toxic))
        odds = np.log((c1 + prior) / (c1.sum() + prior - c1)) - np.log((c0 + prior) / (c0.sum() + prior - c0))
        width = 1.96 * np.sqrt(1 / (c1 + prior) + 1 / (c0 + prior))
        shrunk = np.sign(odds) * np.maximum(0, np.abs(odds) - width)
        used = shrunk != 0
        self.words, self.scores = vocabulary[used], shrunk[used]
        self._calibrate(h, word_off, y, totals, n1, n0)

    def _calibrate(self, h: np.ndarray, word_off: np.ndarray, y: np.ndarray, totals: dict, n1: float, n0: float) -> None:
        s = self.word_scores(h, word_off)
        clean = np.repeat(y == 0, np.diff(word_off))
        value, count = np.unique(np.round(s[clean], 3), return_counts=True)
        p = count / count.sum()
        lo, hi = 1e-3, 20.0
        if value.max(initial=0) > 0:
            for _ in range(80):  # the positive root of E[exp(lambda s)] = 1
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * value, 600))).sum() > 1 else (mid, hi)
            self.lam = max(0.05, lo)
        lengths = np.diff(word_off)
        segments = [maximal_segments(s[a:b]) for a, b in zip(word_off[:-1], word_off[1:], strict=True)]
        best = np.array([max((x[2] for x in g), default=0.0) for g in segments])
        held = (y == 0) & (lengths > 0)
        self.k = max(1e-6, held.sum() / max(1e-12, (lengths[held] * np.exp(-self.lam * best[held])).sum()))
        x = np.array([self.evidence(g, n) for g, n in zip(segments, lengths, strict=True)])
        weight = np.where(y == 1, totals[1] / n1, totals[0] / n0)
        self.weights = fit_logistic(x, y, weight * len(y) / weight.sum())

    def word_scores(self, h: np.ndarray, word_off: np.ndarray) -> np.ndarray:
        """Each word's score in its text; ``word_off``: the n+1 offsets of the texts."""
        if not len(self.words):
            return np.full(len(h), -self.drift)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        out = np.where(self.words[at] == h, self.scores[at], 0.0) - self.drift
        # of a text's equal pairs of a word and the one before it, only the first is evidence
        up = np.flatnonzero(out > 0)
        row = np.searchsorted(word_off, up, "right") - 1
        before = np.where(up == word_off[row], np.uint64(0), h[up - 1])
        pair = mix64(mix64(before + np.uint64(1)) ^ h[up]) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        again = np.ones(len(up), bool)
        again[np.unique(pair, return_index=True)[1]] = False
        out[up[again]] = -self.drift
        return out

    def e_value(self, score: float, n: int) -> float:
        return self.k * max(1, n) * math.exp(-min(600.0, self.lam * score))

    def significant(self, segments: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        return [g for g in segments if self.e_value(g[2], n) < E_VALUE]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """log of how unlikely the best segment is, and of the significant ones' sum."""
        if not segments:
            return 0.0, 0.0
        best = max(g[2] for g in segments)
        p = -math.expm1(-self.e_value(best, n))
        found = self.significant(segments, n)
        return math.log1p(min(500.0, -math.log(max(p, 1e-200)))), math.log1p(sum(g[2] for g in found) * self.lam)

    def probability(self, evidence: tuple[float, float]) -> float:
        if self.weights is None:
            return self.constant
        z = self.weights[0] * evidence[0] + self.weights[1] * evidence[1] + self.weights[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, train, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """``train``: which rows of labels to learn from (a Column over doc_id)."""
    labelled = labels.where(train).select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isin(0, 1))
    model = ToxicityModel(*bounded_sample(docs, labelled, sample_rows, sample_bytes, 2))
    release_memory()
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, predicted, passages: (first_word, end_word, bits, e_value) of
    every significant passage, counted in alphanumeric words."""
    extra = "score double, predicted int, passages array<struct<first_word: int, end_word: int, bits: double, e_value: double>>"
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", " + extra
    model = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("bits", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in text_slices(batches, "text"):
            data, off = byte_view(batch.column("text"))
            starts, ends, word_off = words(data, off, NOT_ALNUM)
            s = m.word_scores(span_hashes(data, starts, ends), word_off)
            out, passages = [], []
            for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True):
                segments = maximal_segments(s[a:b])
                out.append(m.probability(m.evidence(segments, b - a)))
                passages.append([(x, y, m.lam * v / math.log(2), m.e_value(v, b - a)) for x, y, v in m.significant(segments, b - a)])
            found = [[dict(zip(("first_word", "end_word", "bits", "e_value"), g, strict=True)) for g in p] for p in passages]
            cols = [pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, "score", "predicted", "passages"])

    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, all their columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in text_slices(batches, "text"):
            data, off = byte_view(batch.column("text"))
            starts, ends, word_off = words(data, off, NOT_ALNUM)
            s = m.word_scores(span_hashes(data, starts, ends), word_off)
            p = [m.probability(m.evidence(maximal_segments(s[a:b]), b - a)) for a, b in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True)]
            yield batch.filter(pa.array([x < threshold for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, id_fold("doc_id", _FOLDS) != _HELD_OUT)
    return score(docs, model).select("doc_id", (id_fold("doc_id", _FOLDS) == _HELD_OUT).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
