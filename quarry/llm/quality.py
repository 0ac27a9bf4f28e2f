"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: its words, the
character n-grams (bytes 3 to 5) inside them, and for each word trigram that the
document has already used a shared `again` feature.  A softmax layer reads the
mean.  Vectors and layer are trained together by numpy stochastic gradient
descent on a bounded sample; a feature's step is divided by the document's
squared feature weight, so long and short documents learn alike.

Two classes and a linear read-out make a document's margin the mean of a scalar
per feature, so scoring needs one float per hash bucket (``BUCKETS`` of them,
512 kB) and no word list.

Defined cases: a null or empty text has no feature and gets the score of a zero
margin after calibration; null labels and label rows without a document are not
learned from; with one class only, the score is that class's share; rows that
repeat a doc_id are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, byte_view, fit_logistic, id_fold, mix64, release_memory, shingle_hashes, span_hashes, text_slices, words

#: The sample to fit on: rows of each label, and bytes of text in all.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 24 << 20
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 4
RATE = 0.25
GRAMS = (3, 4, 5)
SEED = 7
THRESHOLD = 0.3
_FOLDS, _HELD_OUT = 5, 0
_AGAIN = 0


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, rows) of the batch's features, one kind after another."""
    starts, ends, word_off = words(data, off)
    h = span_hashes(data, starts, ends, lower=False)
    rows = np.arange(len(off) - 1)
    yield _bucket(h), np.repeat(rows, np.diff(word_off))
    _, distinct = shingle_hashes(h, word_off, 3)
    again = np.maximum(0, np.diff(word_off) - 2) - np.diff(distinct)
    again = np.maximum(0, np.where(np.diff(word_off) >= 3, again, 0))
    yield np.full(int(again.sum()), _AGAIN), np.repeat(rows, again)
    if not len(data):
        return
    # n-grams may begin at the blank before a word and end at the one after it
    word_of = np.zeros(len(data), np.int64)
    word_of[starts] = 1
    word_of = np.cumsum(word_of)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    row_of = np.repeat(rows, np.diff(off))
    code = data.astype(np.uint64)
    for n in GRAMS:
        if len(data) < n:
            return
        m = len(data) - n + 1
        h = np.full(m, np.uint64(n))
        whole = np.ones(m, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ code[k : k + m]
            if 0 < k < n - 1:
                whole &= inside[k : k + m]
        # the middle bytes belong to one word, and both ends to the row
        whole &= (word_of[1 : 1 + m] == word_of[n - 2 : n - 2 + m]) & (row_of[:m] == row_of[n - 1 :])
        yield _bucket(mix64(h[whole])), row_of[:m][whole]


class QualityModel:
    """``margin``: a float per bucket; ``a``, ``b``: the calibration."""

    def __init__(self, table: pa.Table, totals: dict):
        n = sum(totals.values())
        self.margin, self.a, self.b = np.zeros(BUCKETS, np.float32), 0.0, 0.0
        self.constant = totals.get(1, 0) / n if n else 0.0
        y = np.array(table.column("label").to_pylist(), np.int64) if table.num_rows else np.zeros(0, np.int64)
        if len(set(y.tolist())) < 2:
            return
        docs = self._documents(table.column("text"))
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
        layer = rng.uniform(-0.5, 0.5, (2, DIM))
        held = np.arange(len(y)) % 5 == 4  # for the calibration
        train = np.flatnonzero(~held)
        steps, done = EPOCHS * len(train), 0
        for _ in range(EPOCHS):
            for d in rng.permutation(train):
                ids, weight = docs[d]
                if not len(ids):
                    continue
                rate = RATE * (1 - done / steps)
                done += 1
                mean = weight @ vectors[ids]
                z = layer @ mean
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[d]] -= 1
                back = layer.T @ p
                layer -= rate * np.outer(p, mean)
                vectors[ids] -= (rate / (weight @ weight)) * weight[:, None] * back
        self.margin = (vectors @ (layer[1] - layer[0])).astype(np.float32)
        x = np.array([weight @ self.margin[ids] if len(ids) else 0.0 for ids, weight in docs])
        counts = np.bincount(y[held], minlength=2)
        use = held if counts.min() else np.ones(len(y), bool)
        share = np.bincount(y[use], minlength=2)
        weight = np.where(y == 1, totals[1] / share[1], totals[0] / share[0])[use]
        self.scale = float(np.abs(x).mean()) or 1.0
        self.a, self.b = fit_logistic(x[use][:, None] / self.scale, y[use].astype(float), weight * use.sum() / weight.sum(), ridge=0.1)
        self.a /= self.scale

    @staticmethod
    def _documents(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct features of each document and their shares."""
        out = []
        for k in range(len(column)):
            data, off = byte_view(pa.array([column[k].as_py()], pa.large_string()))
            ids, count = np.unique(np.concatenate([f for f, _ in features(data, off)]), return_counts=True)
            out.append((ids.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
        return out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.a == 0:
            return np.full(n, self.constant)
        total, count = np.zeros(n), np.zeros(n)
        for ids, rows in features(data, off):
            total += np.bincount(rows, self.margin[ids], n)
            count += np.bincount(rows, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.a * total / np.maximum(1, count) + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """``train``: which rows of labels to learn from (a Column over doc_id)."""
    labelled = labels.where(train).select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1))
    model = QualityModel(*bounded_sample(docs, labelled, sample_rows, sample_bytes, 2))
    release_memory()
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, predicted."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", score double, predicted int"
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            p = model.value.scores(*byte_view(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all their columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield batch.filter(pa.array(model.value.scores(*byte_view(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, id_fold("doc_id", _FOLDS) != _HELD_OUT)
    return score(docs, model).select("doc_id", (id_fold("doc_id", _FOLDS) == _HELD_OUT).alias("held_out"), "score", "predicted")
