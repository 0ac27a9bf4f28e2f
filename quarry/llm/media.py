"""Media columns with content-defined chunks.

A text's payload (its UTF-8 bytes, padded with spaces to a positive multiple of
``UNIT``) is kept as 8-bit samples, cut into chunks where a rolling gear hash of
the last 32 bytes has its top bits clear.  Chunk digests meet in a Spark join:
the first document that has a chunk keeps its bytes, every other one keeps a
reference.  The store has a row per document - the ordered chunk list and the
bytes that it owns - so chunks that occur once never move; only shared chunks
and the rows that refer to them go through a shuffle.  Reading back joins
references with their chunks, puts the lists in order, and verifies every
digest.

Which documents take part in sharing is told to the scan by a filter of fixed
size (4 MB); a document that it lets through needlessly is only joined in vain.

Defined cases: a null or empty text has ``UNIT`` spaces as payload and n_bytes 0;
rows that repeat a doc_id are separate documents, rows that repeat id and text
each keep their own bytes; a null doc_id is kept; other columns are ignored; an
empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import byte_view, discard, filter_column, key_filter, materialize, mix64, passes, text_slices

UNIT = 192
LEAST, MOST = 512, 8192
CUT_BITS = 11
#: The gear table: a fixed pseudorandom word for each byte value.
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
PRIVATE, SHARED, REFERENCE = 0, 1, 2


def payloads(data: np.ndarray, off: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Padded payloads, concatenated, and their offsets."""
    n = np.diff(off)
    padded = np.maximum(1, -(-n // unit)) * unit
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(at[-1], 0x20, np.uint8)
    for k in range(len(n)):
        out[at[k] : at[k] + n[k]] = data[off[k] : off[k + 1]]
    return out, at


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of gear words of the last 32 bytes,
    each shifted by its distance, by doubling the window five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def cuts(data: np.ndarray, off: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = CUT_BITS) -> list[list[int]]:
    """Chunk ends of each payload, relative to its start."""
    marks = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        mine = marks[np.searchsorted(marks, a + least) : np.searchsorted(marks, b)].tolist()
        ends, at, k = [], a, 0
        while b - at > least:
            while k < len(mine) and mine[k] < at + least:
                k += 1
            end = min(mine[k] if k < len(mine) else b, at + most, b)
            ends.append(end - a)
            at = end
        if at < b:
            ends.append(b - a)
        out.append(ends)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"))


def chunk_list(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, seq, digest of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, off = payloads(*byte_view(batch.column("text")))
            ends = cuts(data, off)
            rows = np.repeat(np.arange(batch.num_rows), [len(e) for e in ends])
            seq = np.concatenate([np.arange(len(e)) for e in ends]) if ends else np.zeros(0, np.int64)
            view = memoryview(data)
            digests = []
            for a, own in zip(off[:-1].tolist(), ends, strict=True):
                begin = 0
                for e in own:
                    digests.append(hashlib.sha256(view[a + begin : a + e]).digest())
                    begin = e
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("k1", "k2", "doc_id")), pa.array(seq, pa.int32()), pa.array(digests, pa.binary())], ["k1", "k2", "doc_id", "seq", "digest"])

    return _keyed(docs).mapInArrow(run, "k1 long, k2 long, doc_id long, seq int, digest binary")


_STORE = "doc_id long, k1 long, k2 long, refers boolean, shares boolean, kinds binary, head binary, body binary"
_STORE_NAMES = [x.split()[0] for x in _STORE.split(", ")]


def write_store(docs: DataFrame) -> DataFrame:
    """The deduplicated store: per document the kinds of its chunks, the head of
    its media (which holds the ordered chunk list) and the bytes that it owns."""
    chunks = materialize(chunk_list(docs), "chunks")
    here = F.struct("k1", "k2", "seq")
    # the shuffle gets a row per task and digest; a digest that occurs once ends here
    shared = chunks.groupBy("digest").agg(F.min(here).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "owner")
    # written, so that the join with a hot digest can be split
    shared = materialize(shared, "shared")
    marks = chunks.join(shared.hint("merge"), "digest").select("k1", "k2", "doc_id", "seq", F.when(F.col("owner") == here, SHARED).otherwise(REFERENCE).alias("kind"))
    # a set: rows that repeat id and text have the same marks
    marks = marks.groupBy("k1", "k2", "doc_id").agg(F.collect_set(F.struct("seq", "kind")).alias("marks"))
    marks = materialize(marks, "marks")
    known = docs.sparkSession.sparkContext.broadcast(key_filter(marks, "doc_id"))

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, raw_off = byte_view(batch.column("text"))
        data, off = payloads(raw, raw_off)
        ends, view = cuts(data, off), memoryview(data)
        marked = batch.column("marks").to_pylist() if "marks" in batch.schema.names else [None] * batch.num_rows
        kinds, heads, bodies, refers, shares = [], [], [], [], []
        for a, b, n, own, mark in zip(off[:-1].tolist(), off[1:].tolist(), np.diff(raw_off).tolist(), ends, marked, strict=True):
            kind = bytearray(len(own))
            for m in mark or ():
                kind[m["seq"]] = m["kind"]
            begin, size, dig, body = 0, [], [], []
            for k, e in zip(kind, own, strict=True):
                part = view[a + begin : a + e]
                size.append(e - begin)
                dig.append(hashlib.sha256(part).digest())
                if k != REFERENCE:
                    body.append(part)
                begin = e
            kinds.append(bytes(kind))
            heads.append(media_head(n, b - a, size, dig))
            bodies.append(b"".join(body))
            refers.append(REFERENCE in kind)
            shares.append(SHARED in kind)
        cols = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(refers), pa.array(shares)]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.binary()) for x in (kinds, heads, bodies))], _STORE_NAMES)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rest = batch.filter(pa.array(~passes(known.value, batch.column("bit").to_numpy())))
            if rest.num_rows:
                yield build(rest)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(known.value, batch.column("bit").to_numpy()))).drop_columns(["bit"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield build(batch)

    rows = _keyed(docs).withColumn("bit", filter_column("doc_id"))
    met = rows.mapInArrow(candidates, "doc_id long, text string, k1 long, k2 long").hint("merge").join(marks.select("k1", "k2", "marks"), ["k1", "k2"], "left")
    store = materialize(rows.mapInArrow(alone, _STORE).unionByName(met.mapInArrow(together, _STORE)), "media")
    for done in (chunks, shared, marks):
        discard(done)
    return store


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the sample values in bits, and the share of
    neighbours that are equal."""
    n = len(samples)
    count = np.bincount(samples, minlength=256)
    value = np.arange(256)
    mean = float((count * value).sum()) / n
    var = float((count * value * value).sum()) / n - mean * mean
    p = count[count > 0] / n
    same = int((samples[1:] == samples[:-1]).sum()) / n
    return f"mean={mean:.4f};dev={max(0.0, var) ** 0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};flat={same:.4f}"


def media_head(n_bytes: int, payload_bytes: int, lengths: list[int], digests: list[bytes]) -> bytes:
    """What stands before the samples in a medium: magic, bits a sample, sizes,
    and the ordered list of chunk lengths and digests."""
    return b"CDM1" + struct.pack(f"<BQQI{len(lengths)}I", 8, n_bytes, payload_bytes, len(lengths), *lengths) + b"".join(digests)


def read_head(head: bytes) -> tuple[int, tuple[int, ...], list[bytes]]:
    """n_bytes, chunk lengths and digests; ValueError if it isn't such a head."""
    if head[:5] != b"CDM1\x08":
        raise ValueError("not a medium of 8-bit samples")
    n_bytes, payload_bytes, n = struct.unpack_from("<QQI", head, 5)
    lengths, at = struct.unpack_from(f"<{n}I", head, 25), 25 + 4 * n
    if len(head) != at + 32 * n or sum(lengths) != payload_bytes:
        raise ValueError("chunk list doesn't fit its sizes")
    return n_bytes, lengths, [head[k : k + 32] for k in range(at, len(head), 32)]


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, verified boolean"


def read_store(store: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Payloads reassembled from the store, verified chunk by chunk, with their
    features (and the payload itself, if asked for)."""
    schema = _READ + (", payload binary" if keep_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_refs = "parts" in batch.schema.names
            for begin in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(begin, 256).to_pylist():
                    got = {p["seq"]: p["bytes"] for p in r["parts"] or ()} if with_refs else {}
                    n_bytes, size, digests = read_head(r["head"])
                    at, parts, ok = 0, [], True
                    for k, (kind, n, digest) in enumerate(zip(r["kinds"], size, digests, strict=True)):
                        if kind == REFERENCE:
                            part = got.get(k, b"")
                        else:
                            part, at = r["body"][at : at + n], at + n
                        ok = ok and hashlib.sha256(part).digest() == digest
                        parts.append(part)
                    payload = b"".join(parts)
                    # the stored medium: the head as it was read, and the samples
                    whole = hashlib.sha256(r["head"])
                    whole.update(payload)
                    row = (r["doc_id"], n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(r["head"]) + len(payload), whole.hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(size), ok)
                    rows.append((*row, payload) if keep_payload else row)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names)

    def explode(want: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k1, k2, seq, dig, part = [], [], [], [], []
                for r in batch.to_pylist():
                    at = 0
                    _, size, digests = read_head(r["head"])
                    for k, (kind, n, digest) in enumerate(zip(r["kinds"], size, digests, strict=True)):
                        if kind == want:
                            k1.append(r["k1"])
                            k2.append(r["k2"])
                            seq.append(k)
                            dig.append(digest)
                            part.append(r["body"][at : at + n] if want == SHARED else None)
                        at += n if kind != REFERENCE else 0
                cols = [pa.array(dig, pa.binary())]
                if want == SHARED:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(part, pa.binary())], ["digest", "bytes"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(seq, pa.int32())], ["digest", "k1", "k2", "seq"])

        return run

    narrow = ["k1", "k2", "kinds", "head"]
    shared = store.where("shares").select(*narrow, "body").mapInArrow(explode(SHARED), "digest binary, bytes binary")
    wanted = store.where("refers").select(*narrow).mapInArrow(explode(REFERENCE), "digest binary, k1 long, k2 long, seq int")
    # rows that repeat id and text own equal chunks twice; written, so that the
    # join below has nothing under it that would keep a hot digest in one task
    shared = materialize(shared.dropDuplicates(["digest"]), "shared")
    parts = wanted.dropDuplicates(["k1", "k2", "seq"]).hint("merge").join(shared, "digest")
    parts = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct("seq", "bytes")).alias("parts"))
    whole = ["doc_id", "kinds", "head", "body"]
    direct = store.where("not refers").select(whole).mapInArrow(assemble, schema)
    rebuilt = store.where("refers").select("k1", "k2", *whole).join(parts.hint("merge"), ["k1", "k2"], "left").select(*whole, "parts").mapInArrow(assemble, schema)
    return direct.unionByName(rebuilt)


def op2_media(spark, sf_dir: str) -> DataFrame:
    return read_store(write_store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
