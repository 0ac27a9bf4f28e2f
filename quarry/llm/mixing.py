"""Mixing sources to target weights.

Each source's words are laid end to end and packed into blocks of a fixed
length.  Every output shard draws how many slots each source gets, a slot maps
to a block through its source's pseudorandom permutation of block indexes, and
slots meet blocks in a join by index.

The draws are multinomial counts per shard given the totals that the targets
ask for: a binary tree over the shards splits the totals hypergeometrically
(what independent draws become once their sums are known), each node seeded by
its own range.  Trees span ``STRATUM_SHARDS`` shards, among which the totals are
dealt in proportion, so counts stay in the range that is drawn exactly.  So a shard finds its counts, and where its slots start in each
source, alone, in a logarithmic number of steps and without a driver loop, and
every source takes its target to within a block.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; rows that repeat a doc_id are separate documents; a document
without words takes nothing; an empty table mixes to nothing; further columns
are ignored unless ``mixed_documents`` is asked to cut texts, which carries them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import byte_view, materialize, mix64, text_slices, words

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = 20240
#: The table of sources goes to the driver and into the tasks' closures, so its
#: size is checked: this many rows at most.
MAX_SOURCES = 200_000
#: Shards of a tree: 2**17 of 4096 slots are 2**29, under the 10**9 up to which
#: hypergeometric draws are exact.
STRATUM_SHARDS = 1 << 17
_BUCKET_ROWS = 512
_GROUP_BUCKETS = 1024


def count_words(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, size: the number of words of each whole text."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("size")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, 4 << 20):
            _, _, off = words(*byte_view(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(off), pa.int64())], [*keep, "size"])

    return docs.select(*keep, text).mapInArrow(count, schema)


def reach_targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``cap`` times its size; what a
    source can't take is shared again, by weight, among the others."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > cap * sizes[k]]
        if not over:
            for k in open_:
                target[k] = left * weights[k] / whole
            break
        for k in over:
            target[k] = float(cap * sizes[k])
            open_.remove(k)
        left -= sum(target[k] for k in over)
    return target


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds over the least
    even number of bits, walking on while a value falls outside."""
    if n < 2:
        return index.copy()
    half = (int(n - 1).bit_length() + 1) // 2
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def strata_counts(totals: np.ndarray, slots: int) -> list[np.ndarray]:
    """The totals in equal stretches of ``slots`` slots (the last may be shorter):
    each gets its share of what is left, by largest remainder."""
    left, out = totals.astype(np.int64), []
    while left.sum():
        n = min(slots, int(left.sum()))
        exact = [int(x) * n for x in left]
        whole = int(left.sum())
        here = np.array([x // whole for x in exact], np.int64)
        order = sorted(range(len(exact)), key=lambda k: (-(exact[k] % whole), k))
        here[order[: n - int(here.sum())]] += 1
        out.append(here)
        left = left - here
    return out


def shard_counts(totals: np.ndarray, shard: int, per_shard: int = SHARD_SLOTS, seed: int = SEED, stratum: int = STRATUM_SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it)."""
    strata = strata_counts(totals, stratum * per_shard)
    before, here = sum(strata[: shard // stratum], np.zeros(len(totals), np.int64)), strata[shard // stratum]
    lo = shard // stratum * stratum
    hi = lo + -(-int(here.sum()) // per_shard)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, (mid - lo) * per_shard, method="marginals")
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return before, here


class Mix:
    """A planned mix: ``sources``, ``pieces``, ``slots`` and what joins them."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED, per_shard: int = SHARD_SLOTS, extra: dict | None = None):
        self.spark, self.block_words, self.seed, self.per_shard = docs.sparkSession, block_words, seed, per_shard
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *(c.alias(k) for k, c in (extra or {}).items()), F.col("text").cast("string").alias("text"))
        # rows that repeat an id or have none are told apart, and dealt out, by content
        rows = rows.withColumn("content", F.xxhash64("doc_id", "text"))
        sized = materialize(count_words(rows, keep=("doc_id", "source", "content", *(extra or {}))), "sizes")
        got = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(got) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        got.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [int(r["size"]) for r in got]
        targets = reach_targets(sizes, [weights[k % len(weights)] for k in range(len(got))])
        self.blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
        self.slots_of = np.array([min(MAX_REPEATS * int(b), round(t * int(b) / s)) if s else 0 for s, t, b in zip(sizes, targets, self.blocks, strict=True)], np.int64)
        rows = [(k, r.source, s, t, max(1, r.n // _BUCKET_ROWS)) for k, (r, s, t) in enumerate(zip(got, sizes, targets, strict=True))]
        self.sources = self.spark.createDataFrame(rows, "src int, source string, source_size long, target double, buckets long")
        self.documents = self._positions(sized)

    def _positions(self, sized: DataFrame) -> DataFrame:
        """Where each document starts among its source's words: sums within
        buckets of a source, within groups of buckets, and over the groups, so
        that no task holds a whole source."""
        d = sized.join(F.broadcast(self.sources), sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        d = d.withColumn("bucket", F.pmod("content", F.col("buckets")))
        inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", "content")
        d = d.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("held")).withColumn("group", F.floor(F.col("bucket") / _GROUP_BUCKETS))
        upto = (Window.unboundedPreceding, -1)
        groups = sums.groupBy("src", "group").agg(F.sum("held").alias("held"))
        groups = groups.select("src", "group", F.coalesce(F.sum("held").over(Window.partitionBy("src").orderBy("group").rowsBetween(*upto)), F.lit(0)).alias("earlier"))
        sums = sums.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("src", "group").orderBy("bucket").rowsBetween(*upto)), F.lit(0)))
        sums = sums.join(groups, ["src", "group"]).select("src", "bucket", (F.col("before") + F.col("earlier")).alias("before"))
        return d.join(sums, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("bucket", "buckets", "before", "within", "content")

    @property
    def pieces(self) -> DataFrame:
        """Each document's part of each block it lies in; a document without
        words keeps one row without a block."""
        width = F.lit(self.block_words)
        first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width)
        d = self.documents.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        begin = F.greatest(F.col("start"), F.col("block") * width)
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * width)
        return d.withColumns({"first_word": begin - F.col("start"), "n_words": end - begin})

    @property
    def slots(self) -> DataFrame:
        """shard, slot, src, block, epoch: the mixed order, block by block."""
        totals, blocks, seed, per_shard = self.slots_of, self.blocks, self.seed, self.per_shard
        shards = -(-int(totals.sum()) // per_shard)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    before, here = shard_counts(totals, shard, per_shard, seed)
                    src, block, epoch = [], [], []
                    for s in np.flatnonzero(here):
                        j = np.arange(before[s], before[s] + here[s])
                        round_, at = j // blocks[s], j % blocks[s]
                        out = np.zeros(len(j), np.int64)
                        for e in np.unique(round_):
                            key = int(mix64(np.array([seed * 1_000_003 + int(s) * 1009 + int(e)], np.uint64))[0] >> np.uint64(1))
                            out[round_ == e] = permute(at[round_ == e], int(blocks[s]), key)
                        src.append(np.full(len(j), s, np.int32))
                        block.append(out)
                        epoch.append(round_)
                    order = np.random.default_rng([seed, shard]).permutation(int(here.sum()))
                    cols = [np.concatenate(x)[order] for x in (src, block, epoch)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order)) + shard * per_shard), pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2])],
                        ["shard", "slot", "src", "block", "epoch"],
                    )

        parts = max(1, min(shards, 4 * self.spark.sparkContext.defaultParallelism, 1 + shards // 8))
        return self.spark.range(0, shards, 1, parts).mapInArrow(draw, "shard long, slot long, src int, block long, epoch long")

    def mixed(self) -> DataFrame:
        """One row per slot and document piece in it; documents of which nothing
        is taken keep one row without a slot."""
        # both sides grow with the data, which the planner can't see of the slots
        return self.pieces.join(self.slots.hint("merge"), ["src", "block"], "left")

    def taken(self) -> DataFrame:
        """One row per document with the words that the mix takes of it."""
        words_ = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words"))), F.lit(0)).cast("long")
        m = self.mixed()
        with_words = m.where("size > 0").groupBy("doc_id", "src", "start", "size", "source_size", "target").agg(words_.alias("taken"))
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        names = ["doc_id", "size", "source_size", "target", "taken"]
        return with_words.select(names).unionByName(none.select(names))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """What the mix takes of docs, with the columns of docs: a row for each
    document and each time around its source, whose text is the words taken then
    (the whole text where all were) and whose n_chars, if there, is its length.

    A document is known by doc_id and text; rows that repeat both must have been
    merged before, as near-duplicate removal does.
    """
    columns, taken_names = docs.columns, {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        while name.lower() in taken_names:
            name += "_"
        return name

    id_, text_, runs_as = fresh("mix_id"), fresh("mix_text"), fresh("mix_runs")
    plan = Mix(docs, block_words, weights, seed, extra={"text_hash": F.xxhash64("text")})
    runs = plan.pieces.where("block is not null").hint("merge").join(plan.slots.hint("merge"), ["src", "block"])
    runs = runs.groupBy(F.coalesce("doc_id", F.lit(-1)).alias(id_), F.col("text_hash").alias(text_), "epoch").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(runs_as))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(id_), F.xxhash64("text").alias(text_)]
    joined = docs.select("*", *key).hint("merge").join(runs.drop("epoch"), [id_, text_]).select(*columns, runs_as)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, off = byte_view(batch.column("text"))
            starts, ends, word_off = words(data, off)
            texts = []
            for k, runs_ in enumerate(batch.column(runs_as).to_pylist()):
                begin, have, parts = int(word_off[k]), int(word_off[k + 1] - word_off[k]), []
                if sum(r["n_words"] for r in runs_) == have:
                    texts.append(data[off[k] : off[k + 1]].tobytes().decode())
                    continue
                merged: list[list[int]] = []
                for r in runs_:
                    if merged and merged[-1][1] == r["first_word"]:
                        merged[-1][1] += r["n_words"]
                    else:
                        merged.append([r["first_word"], r["first_word"] + r["n_words"]])
                for a, b in merged:
                    parts.append(data[starts[begin + a] : ends[begin + b - 1]].tobytes().decode())
                texts.append("\n".join(parts))
            new = {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([len(t) for t in texts]).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)

    return joined.mapInArrow(cut, docs.schema)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
