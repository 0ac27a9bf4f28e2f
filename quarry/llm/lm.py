"""Language-model scores from log-frequency Bloom filters.

Texts are read in blocks of whole documents.  A block keeps its token stream as
numbers into its list of distinct words, and asks once for each distinct word and
bigram, with its count in the block's training documents, at the segment that the
hash of the bigram's first word names.  A segment adds the counts up.  It holds
its words exactly - how often, T(u) kinds of word after u, and D(u) occurrences
after u as the filter has them - and its bigrams' quantised counts in a
log-frequency Bloom filter, which is probed at level 1, 2, ... until a miss.

A filter grows with its corpus.  Up to ``BROADCAST_TOKENS`` all segments are
broadcast and every worker probes them; beyond that they have no size bound under
which they could be, so the probes travel to the segments, in the shuffle that
brings the counts.  Both ways give the same scores.

The model is Witten-Bell's interpolation over what the filter says:
P(w|u) = ((1 - m) c(uw) / D(u) + m P(w)) / Z(u) with m = T(u) / (T(u) + c(u)) and
P(w) add-one smoothed.  D(u) sums the quantised counts, so quantisation costs no
mass, and Z(u) = 1 + (1 - m) f (V - T(u)) / D(u) gives back what missing bigrams
get by a false hit, whose chance f is the filter's; so P(.|u) sums to 1.  The text
of a document ends in one end token, which is also the context of the next start.

Words that are more than ``HOT_SHARE`` of all tokens have their bigrams dealt to
several segments by the second word, and T and D added up over those.

Defined cases: a null or empty text is the end token alone; a null doc_id counts
as fold crc32(''); rows that repeat a doc_id are scored each and counted each;
without training rows all counts are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import byte_view, id_fold, materialize, mix64, span_hashes, text_slices, words

BLOCK_BYTES = 8 << 20
#: Tokens of all blocks for each segment.
SEGMENT_TOKENS = 1 << 20
#: The most tokens whose filters are broadcast: some 6 MB of bits and at most
#: 28 MB of words.
BROADCAST_TOKENS = 1 << 20
#: Probes an item; with 1.45 bits a probe a missing key passes one level with a
#: chance of 2**-32, which times the vocabulary is the mass that Z gives back.
PROBES = 32
BITS_PER_ITEM = 47
#: A word over this share of all tokens may have its bigrams dealt out, so at
#: most 1 / HOT_SHARE words are told to all tasks.
HOT_SHARE = 1 / 2000
_FOLDS, _HELD_OUT = 7, 2
_END = np.uint64(0x1F3D5B79A2C4E608)
_FINGER_BYTES = 4


class LogBloom:
    """A Bloom filter of (key, level) items for each level up to a key's
    quantised log count.  Counts of 1, 2 and 3 have levels of their own; beyond,
    two levels share each doubling."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        level = self.quantise(counts)
        bits = np.zeros(max(64, int(level.sum()) * BITS_PER_ITEM), bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            at, step = self._start(keys[level >= j], j)
            for _ in range(PROBES):
                bits[self._place(at, len(bits))] = True
                at, step = self._next(at, step)
        self.size, self.packed = len(bits), np.packbits(bits, bitorder="little")
        #: The chance that a missing key passes level 1.
        self.false_hit = float(bits.mean()) ** PROBES

    @staticmethod
    def quantise(counts: np.ndarray) -> np.ndarray:
        """0 for a count of 0, 1 for 1, then two levels for each doubling."""
        some = np.maximum(1, counts).astype(np.float64)
        power = np.floor(np.log2(some) + 1e-12)
        level = 2 * power + (some >= 1.5 * 2**power)
        return np.where(counts > 0, np.maximum(1, level), 0).astype(np.int64)

    @staticmethod
    def count_of(level: np.ndarray) -> np.ndarray:
        """The middle of the counts that share a level."""

        def least(x: np.ndarray) -> np.ndarray:
            return np.where(x < 2, x, 2.0 ** (x // 2) * np.where(x % 2, 1.5, 1.0))

        level = np.asarray(level, np.float64)
        return np.where(level > 0, (least(level) + least(level + 1) - 1) / 2, 0.0)

    @staticmethod
    def _start(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32) | np.uint32(1)

    @staticmethod
    def _next(at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at + step, step * np.uint32(0x9E3779B1) + np.uint32(2)

    @staticmethod
    def _place(at: np.ndarray, size: int) -> np.ndarray:
        return ((at.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)).view(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level: probes at 1, 2, ... until one misses."""
        out = np.zeros(len(keys), np.int64)
        todo, j = np.arange(len(keys)), 1
        while len(todo):
            at, step = self._start(keys[todo], j)
            for _ in range(PROBES):
                place = self._place(at, self.size)
                hit = (self.packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    todo, at, step = todo[hit], at[hit], step[hit]
                at, step = self._next(at, step)
            out[todo] = j
            j += 1
        return out


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte significance, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_STATE = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, stream binary, distinct binary, often array<struct<word: long, n: long>>"


def blocks(docs: DataFrame, held_out) -> DataFrame:
    """One row per block of about BLOCK_BYTES of text: its documents, the lengths
    of their token sequences, the sequences, the distinct words' hashes and those
    of its words that may be hot."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        hashes, ids, held, sizes, have = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal count
            h = np.concatenate(hashes)
            distinct, at, often = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            top = order[: int((often >= len(h) * HOT_SHARE / 2).sum())]
            hot = [{"word": int(w), "n": int(n)} for w, n in zip(distinct[top].view(np.int64), often[top], strict=True)]
            row = [[(part << 32) | count], [ids], [held], [sizes], [_planes(rank[at])], [distinct[order].tobytes()], [hot]]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [f.split()[0] for f in _STATE.split(", ")[:6]] + ["often"])

        for batch in text_slices(batches, "text"):
            data, off = byte_view(batch.column("text"))
            starts, ends, word_off = words(data, off)
            h = np.full(len(starts) + batch.num_rows, _END)
            keep = np.ones(len(h), bool)
            keep[word_off[1:] + np.arange(batch.num_rows)] = False
            h[keep] = span_hashes(data, starts, ends)
            hashes.append(h)
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            sizes += (np.diff(word_off) + 1).tolist()
            have += len(data)
            if have >= BLOCK_BYTES:
                yield close()
                hashes, ids, held, sizes, have = [], [], [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _STATE)


class _Block:
    """A block's sequences, and its entries: each word at its own segment, and at
    the others that have some of its bigrams.  Entries are in the order of
    segments and hashes, bigrams in that of their entries and fingers."""

    def __init__(self, row: dict, segments: int, hot: dict[int, int]):
        self.sizes = np.array(row["sizes"], np.int64)
        self.word = _unplanes(row["stream"])
        self.held = np.repeat(np.array(row["held"], bool), self.sizes)
        self.distinct = distinct = np.frombuffer(row["distinct"], np.uint64)
        first = np.cumsum(self.sizes) - self.sizes
        end = self.word[first[0] + self.sizes[0] - 1]  # every document ends in it
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[first] = end
        pair, self.pair = np.unique(self.context * len(distinct) + self.word, return_inverse=True)
        u, w = pair // len(distinct), pair % len(distinct)
        n = np.uint64(segments)
        home = (mix64(distinct) % n).astype(np.int64)
        seg = home[u]
        self.hot: dict[int, int] = {}
        if hot:
            known = np.sort(np.array(list(hot), np.uint64))
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            self.hot = {int(r): hot[int(distinct[r])] for r in np.flatnonzero(known[at] == distinct)}
        for r, salts in self.hot.items():
            a, b = np.searchsorted(u, [r, r + 1])
            salt = mix64(distinct[w[a:b]]) % np.uint64(salts)
            seg[a:b] = np.where(salt == 0, home[r], (mix64(distinct[r] + salt * np.uint64(0xD6E8FEB86659FD93)) % n).astype(np.int64))
        extra = np.unique(seg[seg != home[u]] * len(distinct) + u[seg != home[u]])
        e_seg = np.concatenate([home, extra // len(distinct)])
        e_word = np.concatenate([np.arange(len(distinct)), extra % len(distinct)])
        order = np.lexsort((distinct[e_word], e_seg))
        self.entry_seg, self.entry_word = e_seg[order], e_word[order]
        self.home = order < len(distinct)
        # each bigram's entry
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entry, moved = place[u], np.flatnonzero(seg != home[u])
        entry[moved] = place[len(distinct) + np.searchsorted(extra, seg[moved] * len(distinct) + u[moved])]
        finger = (mix64(mix64(distinct[u] + np.uint64(1)) + distinct[w]) >> np.uint64(32)).astype(np.uint32)
        self.pair_order = np.argsort(entry.astype(np.uint64) << np.uint64(32) | finger, kind="stable")
        self.entry, self.finger = entry[self.pair_order], finger[self.pair_order]
        self.fan = np.bincount(entry, minlength=len(self.entry_seg))

    def train_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the entries (nothing where it isn't the word's own) and the bigrams."""
        fresh = ~self.held
        w = np.bincount(self.word[fresh], minlength=len(self.distinct))[self.entry_word] * self.home
        return w, np.bincount(self.pair[fresh], minlength=len(self.finger))[self.pair_order]

    def scores(self, c: np.ndarray, kinds_after: np.ndarray, sum_after: np.ndarray, level: np.ndarray, totals: tuple) -> tuple[np.ndarray, ...]:
        """Per document: known tokens, base and model score; from the words' three
        numbers and the bigrams' levels (in their order here)."""
        pair = np.empty(len(level))
        pair[self.pair_order] = LogBloom.count_of(level)
        u = self.context
        base, model = token_log10(c[self.word], c[u], kinds_after[u], sum_after[u], pair[self.pair], *totals)
        first = np.cumsum(self.sizes) - self.sizes
        return tuple(np.add.reduceat(x, first) for x in ((c[self.word] > 0).astype(np.int64), base, model))


def _key(word: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """What a filter knows a bigram by."""
    return mix64(word + finger.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Segment:
    """The words and bigrams of one segment, from the entries of any number of
    blocks: entries' words and counts, the number of bigrams of each entry, and
    the bigrams' fingers and counts."""

    def __init__(self, word: np.ndarray, count: np.ndarray, fan: np.ndarray, finger: np.ndarray, pair_count: np.ndarray):
        self.words, self.entry = np.unique(word, return_inverse=True)
        self.count = np.bincount(self.entry, count, len(self.words)).astype(np.int64)
        key = np.repeat(self.entry.astype(np.uint64), fan) << np.uint64(32) | finger
        pairs, self.pair = np.unique(key, return_inverse=True)
        of = (pairs >> np.uint64(32)).astype(np.int64)
        total = np.bincount(self.pair, pair_count, len(pairs)).astype(np.int64)
        keys, seen = _key(self.words[of], pairs.astype(np.uint32)), total > 0
        self.bloom = LogBloom(keys[seen], total[seen])
        self.level = self.bloom.levels(keys)
        self.kinds_after = np.bincount(of[seen], minlength=len(self.words))
        self.sum_after = np.bincount(of[seen], LogBloom.count_of(self.level[seen]), len(self.words))


def token_log10(c_word: np.ndarray, c_context: np.ndarray, kinds_after: np.ndarray, sum_after: np.ndarray, c_pair: np.ndarray, tokens: int, kinds: int, false_hit: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability under the add-one base and the model."""
    base = (c_word + 1.0) / (tokens + kinds + 1.0)
    novel = kinds_after / np.maximum(1.0, kinds_after + c_context)
    d = np.maximum(1.0, sum_after)
    z = 1 + (1 - novel) * false_hit * np.maximum(0, kinds - kinds_after) / d
    p = np.where(kinds_after > 0, ((1 - novel) * np.minimum(1.0, c_pair / d) + novel * base) / z, base)
    return np.log10(base), np.log10(p)


_ASK = "seg int, block long, words binary, word_counts binary, fans binary, fingers binary, pair_counts binary"


def _requests(state: DataFrame, segments: int, hot: dict[int, int]) -> DataFrame:
    """A row per block and segment that the block asks, never more than n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, segments, hot)
                wc, bc = b.train_counts()
                edge = np.arange(segments + 1)
                wo = np.searchsorted(b.entry_seg, edge)
                bo = np.searchsorted(b.entry, wo)
                used = np.flatnonzero(np.diff(wo) > 0)
                cols = []
                for values, pack, off in ((b.distinct[b.entry_word], np.ndarray.tobytes, wo), (wc, _planes, wo), (b.fan, _planes, wo), (b.finger, np.ndarray.tobytes, bo), (bc, _planes, bo)):
                    cols.append(pa.array([pack(values[off[s] : off[s + 1]]) for s in used], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), row["block"]), pa.int64()), *cols], [x.split()[0] for x in _ASK.split(", ")])

    return state.mapInArrow(run, _ASK)


def _segment(asked: pa.Table) -> Segment:
    whole = {c: asked.column(c).to_pylist() for c in ("words", "word_counts", "fans", "fingers", "pair_counts")}
    plain = [np.frombuffer(b"".join(whole[c]), kind) for c, kind in (("words", "<u8"), ("fingers", "<u4"))]
    count, fan, pair_count = (np.concatenate([_unplanes(x) for x in whole[c]]) for c in ("word_counts", "fans", "pair_counts"))
    return Segment(plain[0], count, fan, plain[1], pair_count)


_STATS = "known long, false_hit double, hot array<struct<word: long, kinds: long, sum: double>>"
_STATS_TYPES = [pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.int64()), ("kinds", pa.int64()), ("sum", pa.float64())]))]


def _stats(s: Segment, hot: dict[int, int]) -> list:
    """Of a segment: its known words, its chance of a false hit and its part of the hot words."""
    part = np.flatnonzero(np.isin(s.words, np.array(list(hot), np.uint64))) if hot else []
    rows = [{"word": int(s.words[k].view(np.int64)), "kinds": int(s.kinds_after[k]), "sum": float(s.sum_after[k])} for k in part]
    return [int((s.count > 0).sum()), s.bloom.false_hit, rows]


_ANSWER = "block long, seg int, counts binary, kinds binary, sums binary, levels binary, " + _STATS


def _answered(hot: dict[int, int]):
    def answer(asked: pa.Table) -> pa.Table:
        """One segment's answers to all blocks."""
        asked = asked.sort_by("block")
        s = _segment(asked)
        n_words = np.array([len(x) // 8 for x in asked.column("words").to_pylist()])
        n_pairs = np.array([len(x) // _FINGER_BYTES for x in asked.column("fingers").to_pylist()])
        wo, bo = (np.concatenate([[0], np.cumsum(n)]) for n in (n_words, n_pairs))
        count, kinds, sums, level = s.count[s.entry], s.kinds_after[s.entry], s.sum_after[s.entry], s.level.astype(np.uint8)[s.pair]
        rows = range(asked.num_rows)
        cols = [pa.array([x[off[k] : off[k + 1]].astype(kind).tobytes() for k in rows], pa.binary()) for x, kind, off in ((count, "<i8", wo), (kinds, "<u4", wo), (sums, "<f8", wo), (level, "u1", bo))]
        stats = [pa.array([v, *[None] * (asked.num_rows - 1)], t) for v, t in zip(_stats(s, hot), _STATS_TYPES, strict=True)]
        return pa.table([asked.column("block"), asked.column("seg"), *cols, *stats], names=["block", "seg", "counts", "kinds", "sums", "levels", "known", "false_hit", "hot"])

    return answer


_MODEL = "seg int, words binary, counts binary, kinds binary, sums binary, size long, bits binary, " + _STATS


def _modelled(hot: dict[int, int]):
    def model(asked: pa.Table) -> pa.Table:
        """One segment, to be broadcast."""
        s = _segment(asked)
        cols = [s.words.tobytes(), s.count.astype("<i8").tobytes(), s.kinds_after.astype("<u4").tobytes(), s.sum_after.astype("<f8").tobytes(), s.bloom.size, s.bloom.packed.tobytes()]
        types = [pa.binary()] * 4 + [pa.int64(), pa.binary()]
        arrays = [pa.array([v], t) for v, t in zip(cols + _stats(s, hot), types + _STATS_TYPES, strict=True)]
        return pa.table([asked.column("seg").slice(0, 1), *arrays], names=["seg", "words", "counts", "kinds", "sums", "size", "bits", "known", "false_hit", "hot"])

    return model


def _hot_words(state: DataFrame, all_tokens: int) -> dict[int, int]:
    """The words to deal out and over how many segments; fewer than 1 / HOT_SHARE,
    as each is more than that share of all tokens."""
    rows = state.select(F.explode("often").alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).where(F.col("n") > all_tokens * HOT_SHARE).collect()
    salts = {r.word & 0xFFFFFFFFFFFFFFFF: -(-4 * r.n // SEGMENT_TOKENS) for r in rows}
    return {w: k for w, k in salts.items() if k > 1}


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORE_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_SCORE_NAMES = [x.split()[0] for x in _SCORES.split(", ")]


def _scored(b: _Block, row: dict, c: np.ndarray, kinds: np.ndarray, sums: np.ndarray, level: np.ndarray, totals: tuple) -> list[list]:
    known, base, model = b.scores(c, kinds, sums, level, totals)
    return [row["doc_ids"], row["held"], b.sizes.tolist(), known.tolist(), [totals[0]] * len(b.sizes), base.tolist(), model.tolist()]


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores all documents under the model of those not held out (a Column)."""
    spark = docs.sparkSession
    state = materialize(blocks(docs, held_out), "blocks")
    counted = state.select(F.explode(F.arrays_zip("sizes", "held")).alias("d")).agg(F.sum("d.sizes"), F.sum(F.when(~F.col("d.held"), F.col("d.sizes")))).first()
    all_tokens, tokens = counted[0] or 0, counted[1] or 0
    segments = max(1, -(-all_tokens // SEGMENT_TOKENS))
    hot = _hot_words(state, all_tokens)
    asked = _requests(state, segments, hot).groupBy("seg")
    if all_tokens <= BROADCAST_TOKENS:
        return _by_broadcast(spark, state, asked.applyInArrow(_modelled(hot), _MODEL).toArrow().to_pylist(), segments, hot, tokens)
    answers = materialize(asked.applyInArrow(_answered(hot), _ANSWER), "answers")
    got = answers.agg(F.sum("known"), F.avg("false_hit")).first()
    totals = (tokens, got[0] or 0, got[1] or 0.0)
    parts = answers.where("hot is not null").select(F.explode("hot").alias("x")).groupBy("x.word").agg(F.sum("x.kinds").alias("kinds"), F.sum("x.sum").alias("sum")).collect() if hot else []
    after = {r.word & 0xFFFFFFFFFFFFFFFF: (r.kinds, r["sum"]) for r in parts}

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _SCORE_NAMES]
        right = right.sort_by("seg")
        answer = {c: np.frombuffer(b"".join(right.column(c).to_pylist()), kind) for c, kind in (("counts", "<i8"), ("kinds", "<u4"), ("sums", "<f8"), ("levels", "u1"))}
        for row in left.to_pylist():
            b = _Block(row, segments, hot)
            own = b.entry_word[b.home]
            c, kinds, sums = np.empty(len(own), np.int64), np.empty(len(own), np.int64), np.empty(len(own))
            for x, name in ((c, "counts"), (kinds, "kinds"), (sums, "sums")):
                x[own] = answer[name][b.home]
            for r in b.hot:
                kinds[r], sums[r] = after[int(b.distinct[r])]
            for k, v in enumerate(_scored(b, row, c, kinds, sums, answer["levels"], totals)):
                out[k] += v
        return pa.table([pa.array(v, t) for v, t in zip(out, _SCORE_TYPES, strict=True)], names=_SCORE_NAMES)

    replies = answers.select("block", "seg", "counts", "kinds", "sums", "levels")
    return state.drop("often").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, _SCORES)


def _by_broadcast(spark, state: DataFrame, model: list[dict], segments: int, hot: dict[int, int], tokens: int) -> DataFrame:
    totals = (tokens, sum(m["known"] for m in model), float(np.mean([m["false_hit"] for m in model])) if model else 0.0)
    sent = spark.sparkContext.broadcast({m["seg"]: m for m in model})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, segments, hot)
                c, kinds, sums = np.zeros(len(b.distinct), np.int64), np.zeros(len(b.distinct), np.int64), np.zeros(len(b.distinct))
                level = np.zeros(len(b.finger), np.int64)
                bo = np.searchsorted(b.entry, np.searchsorted(b.entry_seg, np.arange(segments + 1)))
                for seg, m in sent.value.items():
                    known = np.frombuffer(m["words"], np.uint64)
                    at = np.minimum(np.searchsorted(known, b.distinct), len(known) - 1)
                    here = np.flatnonzero(known[at] == b.distinct)
                    for x, name, kind in ((c, "counts", "<i8"), (kinds, "kinds", "<u4"), (sums, "sums", "<f8")):
                        x[here] += np.frombuffer(m[name], kind)[at[here]]
                    bloom = LogBloom.__new__(LogBloom)
                    bloom.size, bloom.packed = m["size"], np.frombuffer(m["bits"], np.uint8)
                    mine = slice(bo[seg], bo[seg + 1])
                    level[mine] = bloom.levels(_key(b.distinct[b.entry_word[b.entry[mine]]], b.finger[mine]))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(_scored(b, row, c, kinds, sums, level, totals), _SCORE_TYPES, strict=True)], _SCORE_NAMES)

    return state.mapInArrow(run, _SCORES)


def op1_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, id_fold("doc_id", _FOLDS) == _HELD_OUT)
