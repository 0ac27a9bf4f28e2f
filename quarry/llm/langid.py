"""Language identification by interpolated Kneser-Ney character models.

Per language, an order-4 character model with absolute discounting: counts at
the top order, continuation counts below, uniform over the alphabet at the
bottom.  Each order's n-grams are kept as a sorted array of 64-bit hashes beside
their counts, and looked up by binary search.  A text goes to the language with
the lowest cross-entropy per character; a logistic calibration of the lead over
the second best, fitted on documents held back from the counts, gives the score
and the rejection.

Characters are letters in lower case: every letter of the sample has a class,
those it lacks share one, and every run of anything else is one boundary.  Up to
``ALPHABET`` letters take 6 bits each in an n-gram's code, more take 16.  A
worker remembers the probabilities of n-grams it has met in a table of at most
``CACHE_BYTES``.

Defined cases: a null text or one without a letter is `und` with score 0; null
langs are not learned from; without a training row every text is `und`; with a
single language the lead is its distance to the uniform model; rows that repeat
a doc_id are predicted each; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, fit_logistic, id_fold, mix64, release_memory, text_slices

#: The sample to fit on: rows of each language, bytes of text and languages in all;
#: of more languages, those with most rows are learned.
SAMPLE_ROWS = 800
SAMPLE_BYTES = 8 << 20
MAX_LANGUAGES = 256
ORDER = 4
ALPHABET = 62
DISCOUNT = 0.75
UNKNOWN = "und"
REJECT_BELOW = 0.5
CACHE_BYTES = 64 << 20
_FOLDS, _HELD_OUT = 4, 2
_WIDE = (1 << 16) - 2


def class_table(texts: list[str]) -> np.ndarray:
    """The class of every code point: 0 boundary, 1.. the sample's letters by
    frequency, then letters that it lacks.  Its type is that of a class: 8 bits
    for ``ALPHABET`` letters at most, 16 for more; past the 65534 that these hold,
    letters share the classes of the rarest half, spread over them."""
    seen = Counter("".join(texts).lower())
    letters = sorted((c for c in seen if c.isalpha()), key=lambda c: (-seen[c], c))
    small = len(letters) <= ALPHABET
    table = np.zeros(0x110000, np.uint8 if small else np.uint16)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            table[cp] = (ALPHABET if small else _WIDE) + 1
    for k, c in enumerate(letters):
        k = k if k < _WIDE else _WIDE // 2 + k % (_WIDE // 2)
        table[ord(c)] = k + 1
        for variant in (c.upper(), c.title()):
            if len(variant) == 1 and variant.lower() == c:
                table[ord(variant)] = k + 1
    return table


def code_bits(kind: np.dtype) -> int:
    """Bits of a class in codes of this type."""
    return 6 if kind == np.uint32 else 16


def codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-gram codes of all texts, 6 or 16 bits a class, and the n+1 row offsets.
    Every text is padded with ORDER-1 boundaries in front and one behind."""
    kind = np.uint32 if table.dtype == np.uint8 else np.uint64
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = table[points]
    rows = np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0) | (rows[1:] != rows[:-1])
    # a boundary at a text's very start or end is the padding's
    first = np.cumsum(lengths) - lengths
    some = lengths > 0
    keep[first[some]] &= cls[first[some]] != 0
    cls, rows = cls[keep], rows[keep]
    count = np.bincount(rows, minlength=len(texts))
    if len(cls):
        last = (np.cumsum(count) - 1)[count > 0]
        drop = np.zeros(len(cls), bool)
        drop[last] = cls[last] == 0
        cls, rows = cls[~drop], rows[~drop]
        count = np.bincount(rows, minlength=len(texts))
    pad = ORDER - 1
    size = np.where(count > 0, count + pad + 1, 0)
    off = np.concatenate([[0], np.cumsum(size)])
    laid = np.zeros(off[-1], kind)
    laid[off[rows] + pad + np.arange(len(cls)) - (np.cumsum(count) - count)[rows]] = cls
    grams = laid.copy()
    for k in range(1, ORDER):
        grams[k:] |= laid[: len(laid) - k] << kind(code_bits(kind) * k)
    inside = np.ones(len(laid), bool)
    for k in range(pad):
        inside[(off[:-1] + k)[size > 0]] = False
    grams = grams[inside]
    return grams, np.concatenate([[0], np.cumsum(np.maximum(0, size - pad))])


class KneserNey:
    """One language's model over n-gram codes of ``size`` classes."""

    def __init__(self, grams: np.ndarray, size: int = ALPHABET + 2):
        self.size, self.kind, self.bits = size, grams.dtype.type, code_bits(grams.dtype)
        self.levels = []  # per order: hashes, counts; context hashes, context totals, context types
        found, count = np.unique(grams, return_counts=True)
        for n in range(ORDER, 0, -1):
            context, at = np.unique(found >> self.kind(self.bits), return_inverse=True)
            totals = np.bincount(at, count, len(context))
            types = np.bincount(at, minlength=len(context)).astype(float)
            self.levels.append((*self._sorted(found, n, count.astype(float)), *self._sorted(context, n + 100, totals, types)))
            # below: in how many contexts each shorter n-gram was seen
            found, count = np.unique(found & self.kind((1 << self.bits * (n - 1)) - 1), return_counts=True)

    @staticmethod
    def _hash(code: np.ndarray, salt: int) -> np.ndarray:
        return mix64(code.astype(np.uint64) + np.uint64(salt << 40))

    def _sorted(self, code: np.ndarray, salt: int, *values: np.ndarray) -> tuple:
        h = self._hash(code, salt)
        order = np.argsort(h)
        return (h[order], *(v[order] for v in values))

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Natural log of each n-gram's last character given those before it."""
        p = np.full(len(code), 1.0 / self.size)
        for n, (h, count, ch, totals, types) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            mine = code & self.kind((1 << self.bits * n) - 1)
            at, hit = self._find(h, self._hash(mine, n))
            c = np.where(hit, count[at], 0.0)
            at, hit = self._find(ch, self._hash(mine >> self.kind(self.bits), n + 100))
            total, kinds = np.where(hit, totals[at], 0.0), np.where(hit, types[at], 0.0)
            p = np.where(total > 0, (np.maximum(0, c - DISCOUNT) + DISCOUNT * kinds * p) / np.maximum(1, total), p)
        return np.log(p)


class LanguageModel:
    def __init__(self, table: pa.Table):
        texts = table.column("text").to_pylist() if table.num_rows else []
        label = table.column("label").to_pylist() if table.num_rows else []
        self.langs = sorted(set(label))
        self.a, self.b = 1.0, 0.0
        self._cache = None
        if not self.langs:
            return
        self.table = class_table(texts)
        self.size = max(ALPHABET + 2, len(np.unique(self.table)))
        held = np.arange(len(texts)) % 5 == 4
        self.models = []
        for lang in self.langs:
            mine = [t for t, x, out in zip(texts, label, held, strict=True) if x == lang and not out] or [t for t, x in zip(texts, label, strict=True) if x == lang]
            self.models.append(KneserNey(codes(mine, self.table)[0], self.size))
        # short cuts beside whole texts, as a lead means less in a short one
        check, truth = [], []
        for t, x in ((t, x) for t, x, out in zip(texts, label, held, strict=True) if out):
            for piece in (t, t[: len(t) // 2], t[len(t) // 3 :][:20], t[len(t) // 2 :][:60]):
                check.append(piece)
                truth.append(x)
        if check:
            best, lead = self.lead(check)
            use = best >= 0
            y = np.array([b >= 0 and self.langs[b] == x for b, x in zip(best, truth, strict=True)], float)[use]
            n = y.sum()
            y = np.where(y == 1, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
            if len(y):
                self.a, self.b = fit_logistic(lead[use][:, None], y, ridge=0.01)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None}

    def lead(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number (-1: no letter) and its lead over the next
        in nats per character, times the root of the length."""
        grams, off = codes(texts, self.table)
        n = np.diff(off)
        best, lead = np.full(len(texts), -1), np.zeros(len(texts))
        if not len(grams):
            return best, lead
        if self._cache is None:
            slots = 1 << (CACHE_BYTES // (8 + 4 * len(self.models))).bit_length() - 1
            # no n-gram has code 0, as boundaries don't follow each other in a text
            self._cache = np.zeros(slots, np.uint64), np.zeros((slots, len(self.models)), np.float32)
        keys, known = self._cache
        slot = (mix64(grams.astype(np.uint64)) & np.uint64(len(keys) - 1)).astype(np.int64)
        missed = np.flatnonzero(keys[slot] != grams)
        fresh, first, of_fresh = np.unique(grams[missed], return_index=True, return_inverse=True)
        logs = np.empty((len(fresh), len(self.models)), np.float32)
        some = n > 0
        cost = np.empty((int(some.sum()), len(self.models)))
        for k, m in enumerate(self.models):
            logs[:, k] = m.log_prob(fresh)
            p = known[slot, k]
            p[missed] = logs[of_fresh, k]
            cost[:, k] = -np.add.reduceat(p, off[:-1][some], dtype=np.float64) / n[some]
        # of several that want a slot the first stays, so that key and value agree
        at, first = np.unique(slot[missed[first]], return_index=True)
        keys[at], known[at] = fresh[first], logs[first]
        order = np.argsort(cost, axis=1, kind="stable")
        at = np.arange(len(cost))
        least = cost[at, order[:, 0]]
        second = cost[at, order[:, 1]] if len(self.models) > 1 else np.full(len(cost), np.log(self.size))
        best[some], lead[some] = order[:, 0], np.maximum(0, second - least) * np.sqrt(n[some])
        return best, lead

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, lead = self.lead(texts)
        p = 1 / (1 + np.exp(-np.clip(self.a * lead + self.b, -30, 30)))
        return [self.langs[b] if b >= 0 else UNKNOWN for b in best], np.where(best >= 0, p, 0.0)


def fit(docs: DataFrame, train, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """``train``: which rows of docs to learn from (a Column over doc_id)."""
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"), "text")
    model = LanguageModel(bounded_sample(docs, labelled, sample_rows, sample_bytes, MAX_LANGUAGES)[0])
    release_memory()
    return model


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, rejected (score under REJECT_BELOW)."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", lang_pred string, score double, rejected boolean"
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            lang, p = model.value.predict(pc.fill_null(batch.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(p), pa.array(p < REJECT_BELOW)], [*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, id_fold("doc_id", _FOLDS) != _HELD_OUT)
    return predict(docs, model).select("doc_id", (id_fold("doc_id", _FOLDS) == _HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
