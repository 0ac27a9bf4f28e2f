"""Mixture-controlled packing of documents into fixed token windows.

Documents are tokenized once into a table, dealt by a hash of id and ids into
shards of about ``SHARD_TOKENS`` tokens, and each shard's sources are queues that
a deficit round-robin serves: every window credits each source with its target
share, a turn serves a source up to its deficit (and at least ``MIN_PIECE``
tokens, so that documents aren't cut to crumbs), and what a window can't give is
carried to the next.  Shard p starts where the tokens of the shards before it
end, so a window may begin in one shard and end in the next and only the last
window of all is short.  The deficits that shard p inherits follow from two
prefix sums - tokens so far, and tokens so far of each source - so all shards
run at once and yet carry them.

Defined cases: a null text is an empty one and yields the end token alone; a
null source is a queue of its own; rows that repeat a doc_id are packed each; a
null doc_id is kept; other columns are ignored; an empty table packs to no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import byte_view, materialize, text_slices, words

WINDOW = 2048
END_ID = 1
MIN_PIECE = 256
SHARD_TOKENS = 1 << 20
TOKENIZER = "byte_bpe_50k.json"
RANKED = "byte_bpe_50k.tiktoken"
#: The table of sources is in every task's closure, so its size is checked.
MAX_SOURCES = 200_000
GROUP_SHARDS = 1024
#: Bytes of the longest word or blank run that the ranked encoder takes.
LONGEST_RUN = 400
#: Bytes that end the ranked encoder's part: controls, and leads beyond U+024F.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, *range(0xC9, 0x100)]] = True


class TextEncoder:
    """Ids of whole texts as little-endian 16-bit bytes.

    The vocabulary exists in two forms that give the same ids; the ranked form's
    encoder is five times as fast.  It takes the texts on whose splitting the two
    can't differ - characters up to U+024F without controls and odd blanks - and
    that hold no added token's text and no run long enough to cost it a quadratic
    merge; the tokenizer itself, as its file has it, takes all others.
    """

    def __init__(self, path: str, ranked_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens' texts, which the tokenizer cuts out before all else.
        self.literals = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.ranked = None
        if ranked_path:
            import public_tokenizers
            import tiktoken

            with open(ranked_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts the ranked encoder may take."""
        n = len(off) - 1
        out = np.ones(n, bool)
        if not len(data):
            return out
        odd = _ODD[data]
        odd[1:] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        out[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = False
        raw = data.tobytes()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                k = int(np.searchsorted(off, at, "right"))
                out[k - 1] = False
                at = raw.find(literal, int(off[k]))
        starts, ends, word_off = words(data, off)
        row = np.repeat(np.arange(n), np.diff(word_off))
        out[row[ends - starts > LONGEST_RUN]] = False
        before = np.where(np.arange(len(starts)) == word_off[row], off[row], np.concatenate([[0], ends[:-1]]))
        out[row[starts - before > LONGEST_RUN]] = False
        last = np.where(np.diff(word_off) > 0, np.concatenate([ends, [0]])[np.maximum(word_off[1:] - 1, 0)], off[:-1])
        out[off[1:] - last > LONGEST_RUN] = False
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        texts = column.to_pylist()
        fast = self.plain(*byte_view(column)) if self.ranked else np.zeros(len(texts), bool)
        slow = [t for t, f in zip(texts, fast, strict=True) if not f]
        rest = iter(self.tokenizer.encode_batch(slow, add_special_tokens=False) if slow else ())
        return [(self.ranked.encode_to_numpy(t, disallowed_special=()).astype("<u2") if f else np.array(next(rest).ids, "<u2")).tobytes() for t, f in zip(texts, fast, strict=True)]


_encoders: dict[tuple, TextEncoder] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, ranked_path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens (with the end id), ids (16-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key, end = (tokenizer_path, ranked_path), np.array([END_ID], "<u2").tobytes()
        if key not in _encoders:  # once a worker
            _encoders[key] = TextEncoder(*key)
        for batch in text_slices(batches, "text", 1 << 20):
            ids = [x + end for x in _encoders[key].encode(pc.fill_null(batch.column("text"), ""))]
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, pa.array(ids, pa.binary())], ["doc_id", "source", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


def round_robin(src: np.ndarray, tokens: np.ndarray, share: np.ndarray, base: int, served: np.ndarray, window: int = WINDOW, min_piece: int = MIN_PIECE) -> tuple[np.ndarray, ...]:
    """Places one shard's documents: (document, start, length, position), in
    stream order, where position counts from the start of the whole stream.

    ``base`` tokens came before, ``served`` of each source; a source's deficit is
    what its share of the stream so far exceeds what it was served.
    """
    queues: list[list[int]] = [[] for _ in share]
    for d in range(len(src) - 1, -1, -1):
        queues[src[d]].append(d)
    deficit = share * base - served
    full = np.array([bool(q) for q in queues])
    out_doc, out_start, out_len, out_pos = [], [], [], []
    at, pos, turn, n = [0] * len(src), base, 0, len(share)
    while full.any():
        room = window - pos % window
        deficit = deficit + share * room
        while room and full.any():
            owed = np.where(full, deficit, -np.inf)
            due = np.flatnonzero(owed >= min_piece)
            # round-robin among those owed a piece; else whoever is owed most
            k = int(due[np.searchsorted(due, turn) % len(due)]) if len(due) else int(owed.argmax())
            turn = (k + 1) % n
            d = queues[k][-1]
            size = int(min(tokens[d] - at[d], room, max(deficit[k], min_piece)))
            if 0 < tokens[d] - at[d] - size < min_piece // 4:
                size = int(min(tokens[d] - at[d], room))  # no crumb is left behind
            out_doc.append(d)
            out_start.append(at[d])
            out_len.append(size)
            out_pos.append(pos)
            at[d] += size
            deficit[k] -= size
            pos += size
            room -= size
            if at[d] == tokens[d]:
                queues[k].pop()
                full[k] = bool(queues[k])
    return tuple(np.array(x, np.int64) for x in (out_doc, out_start, out_len, out_pos))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(docs: DataFrame, tokenizer_path: str, ranked_path: str | None = None, targets: dict | None = None, window: int = WINDOW, min_piece: int = MIN_PIECE, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``targets`` maps sources to weights (default: each
    source's share of all tokens, which uses every queue up evenly)."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer_path, ranked_path), "tokens")
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    number = {r.source: k for k, r in enumerate(totals)}
    weight = np.array([float(r.n if targets is None else targets.get(r.source, 0)) for r in totals])
    share = weight / weight.sum() if weight.sum() else weight
    all_tokens = sum(r.n for r in totals)
    if not all_tokens:
        return spark.createDataFrame([], _PIECES + (", ids binary" if with_ids else ""))
    shards = max(1, -(-all_tokens // shard_tokens))
    n_sources = len(totals)
    # by content too, so that rows which repeat an id or have none are dealt out
    sharded = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)))

    # what came before each shard: a row per shard and source in it, and one per
    # shard for all sources (src -1); sums run within groups of shards, then over
    # the groups, so that no task walks all shards
    names = spark.createDataFrame([(k, s) for s, k in number.items()], "src int, source string")
    held = sharded.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n"))
    held = held.join(F.broadcast(names), held["source"].eqNullSafe(names["source"])).select("shard", "src", "n")
    held = held.unionByName(held.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.lit(-1).alias("src"), "n"))
    held = held.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    over = Window.partitionBy("src").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = held.groupBy("src", "group").agg(F.sum("n").alias("n")).select("src", "group", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("src", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, ["src", "group"])
    plan = before.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("src", (F.col("earlier") + F.col("within")).alias("before")))).alias("served"))
    plan = plan.select(F.col("shard").alias("at"), "served")

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.table({c: pa.array([], t) for c, t in zip(out_names, out_types, strict=True)})
        # ties in order of content: equal rows are alike, so any of them comes first
        left = left.append_column("crc", pa.array([zlib.crc32(x.as_buffer()) for x in left.column("ids")], pa.int64()))
        left = left.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("crc", "ascending"), ("ids", "ascending")]).combine_chunks()
        served, base = np.zeros(n_sources), 0
        for x in right.to_pylist()[0]["served"]:
            if x["src"] < 0:
                base = x["before"]
            else:  # of sources that the shard hasn't, nothing is served here
                served[x["src"]] = x["before"]
        src = np.array([number[s] for s in left.column("source").to_pylist()])
        n = left.column("n_tokens").to_numpy()
        raw, off = byte_view(left.column("ids"))
        ids = np.frombuffer(raw.tobytes(), "<u2")
        doc, start, length, pos = round_robin(src, n, share, base, served, window, min_piece)
        first = off[doc] // 2 + start
        parts = [ids[a : a + m].astype("<u4").tobytes() for a, m in zip(first, length, strict=True)]
        crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
        cols = [left.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(pos // window), pa.array(pos % window), left.column("source").take(pa.array(doc))]
        return pa.table([*cols, *([pa.array(parts, pa.binary())] if with_ids else [])], names=out_names)

    schema = _PIECES + (", ids binary" if with_ids else "")
    out_names = [x.split()[0] for x in schema.split(", ")]
    out_types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return sharded.groupBy("shard").cogroup(plan.groupBy("at")).applyInArrow(place, schema)


def op7_packing(spark, sf_dir: str, tokenizer_path: str | None = None, ranked_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path or public_tokenizers.path(TOKENIZER), ranked_path or public_tokenizers.path(RANKED))
