"""MinHash near-duplicates with exact confirmation.

1. A scan hashes each text's distinct word shingles, takes ``BANDS * ROWS``
   universal hash minima and a 128-bit digest of the set.
2. Documents with equal sets become one class, led by its smallest doc_id and
   numbered, as classes may share a doc_id; only leaders go on, under their
   class's number, so exact copies cost an aggregation.
3. Leaders that share a band's minima share a bucket.  Bands are worked through
   in rounds: only buckets that still hold several components take part, and
   within one only pairs of different components are compared.  Signatures go to
   the buckets first (a floor loses less than a hundredth of what the bands do);
   leaders with a likely partner then fetch their full shingle sets, on which
   links are confirmed.  A bucket is split into tiles by rows and by bytes, and
   every pair of tiles is a task's unit, so no group is held whole; it yields
   the links that join components (a forest), not its pairs.
4. Components come from alternating large-star and small-star, and are named by
   the smallest doc_id of their classes.

A pair at the threshold is lost with a chance of (1 - t^4)^20 by the bands and of
at most a hundredth of that by the signatures: 3.9e-07 in all at 0.85.

Defined cases: a null or empty text, or one without words, has no shingle and is
linked with nothing; a text with fewer words than the width has its whole
sequence as one shingle; a null doc_id is linked with nothing, keeps a null
component and is kept; rows that repeat a doc_id are each in the component of
their own text, so kept holds for each of them in whose component that id is the
smallest; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import binary_rows, byte_view, discard, filter_column, key_filter, materialize, mix64, passes, shingle_hashes, span_hashes, text_slices, units, words
from quarry.llm.components import connected_components

BANDS, ROWS = 20, 4
ROUNDS = ((0, 3), (3, BANDS))
#: Bytes of shingle sets, and rows, in a tile of a bucket.
TILE_BYTES = 4 << 20
TILE_ROWS = 512
_MUL = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = byte_view(batch.column("text"))
    starts, ends, word_off = words(data, off)
    return shingle_hashes(span_hashes(data, starts, ends), word_off, width)


def signatures(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The minima of each row's set under every hash (rows x hashes, 32 bits);
    rows with an empty set have zeros."""
    out = np.zeros((len(off) - 1, len(_MUL)), np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        for k in range(len(_MUL)):
            h = ((value * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[some, k] = np.minimum.reduceat(h, off[:-1][some])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima (rows x bands)."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return key


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 1 << 19):
            value, off = shingle_sets(batch, width)
            n = np.diff(off)
            sums = np.zeros((2, len(n)), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                sums[0, some] = np.add.reduceat(mix64(value), off[:-1][some])
                sums[1, some] = np.add.reduceat(mix64(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), off[:-1][some])
            sig = signatures(value, off)
            cols = [batch.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def _bands(leaders: DataFrame) -> DataFrame:
    """id, band, bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, _ = byte_view(batch.column("sig"))
                keys = band_keys(np.frombuffer(raw.tobytes(), np.uint32).reshape(batch.num_rows, -1))
                take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), pa.array(band), pa.array(keys.ravel().view(np.int64))], ["id", "band", "bucket"])

    return leaders.select("id", "sig").mapInArrow(run, "id long, band int, bucket long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, set (sorted 64-bit hashes) of the leaders in ``ids``."""
    known = docs.sparkSession.sparkContext.broadcast(key_filter(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            batch = batch.filter(pa.array(passes(known.value, batch.column("bit").to_numpy())))
            if batch.num_rows:
                value, off = shingle_sets(batch, width)
                n = np.diff(off)
                some = np.flatnonzero(n)
                sums = np.zeros(len(n), np.uint64)
                sums[some] = np.add.reduceat(mix64(value), off[:-1][some])
                raw = value.tobytes()
                cols = [pa.array(sums.view(np.int64)), pa.array([raw[8 * a : 8 * b] for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "d1", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), filter_column("doc_id").alias("bit"))
    found = rows.mapInArrow(run, "doc_id long, d1 long, set binary").hint("merge")
    # d1 tells apart the texts of a repeated id
    return found.join(ids, ["doc_id", "d1"]).dropDuplicates(["doc_id", "d1"])


def signature_floor(t: float) -> int:
    """The most equal minima that a signature may be asked for, so that a pair of
    similarity t has fewer with a chance under a hundredth of the bands' miss."""
    k, below = BANDS * ROWS, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if below >= (1 - t**ROWS) ** BANDS / 100:
            return m
    return k


def likely(label: np.ndarray, tile: np.ndarray, n: np.ndarray, sig: np.ndarray, band: int, percent: int, crossing: bool) -> np.ndarray:
    """Which members of a bucket (or of two of its tiles) have a partner there of
    another component, met first in this band and plausible by size and signature."""
    floor, found = signature_floor(percent / 100), np.zeros(len(n), bool)
    for begin in range(0, len(n), 32):
        mine = slice(begin, begin + 32)
        fit = (label[mine, None] != label[None]) & (100 * np.minimum(n[mine, None], n[None]) >= percent * np.maximum(n[mine, None], n[None]))
        if crossing:
            fit &= tile[mine, None] != tile[None]
        i, j = np.nonzero(fit)
        i = i + begin
        i, j = i[j > i], j[j > i]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            same = sig[a] == sig[b]
            good = (same.sum(1) >= floor) & (same.reshape(len(a), BANDS, ROWS).all(2).argmax(1) == band)
            found[a[good]] = found[b[good]] = True
    return found


def link_bucket(ids: np.ndarray, label: np.ndarray, tile: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], band: int, percent: int, crossing: bool) -> list[tuple[int, int]]:
    """Links that join different components among one bucket's (or two of its
    tiles') members: pairs that meet first in this band, plausible by signature,
    confirmed on full sets."""
    size = np.array([len(s) for s in sets])
    floor = signature_floor(percent / 100)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    flag = np.zeros(int(flat.max()) + 1, bool)
    label = label.copy()
    out = []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        other = label[rest] != label[i]
        if crossing:
            other &= tile[rest] != tile[i]
        if not other.any():
            continue
        low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        js = np.flatnonzero(other & (100 * low >= percent * high)) + i + 1
        if not len(js):
            continue
        same = sig[js] == sig[i]
        meets = same.reshape(len(js), BANDS, ROWS).all(2)
        js = js[(same.sum(1) >= floor) & (meets.argmax(1) == band)]
        if not len(js):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        flag[own] = True
        for j in js.tolist():
            if label[j] != label[i]:
                both = int(np.count_nonzero(flag[flat[ends[j] - size[j] : ends[j]]]))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        flag[own] = False
    return out


_UNIT = ("bucket", "band", "ta", "tb")
_LIKELY = "id long, component long, bucket long, band int, ta int, tb int, tile int"


def _links(m: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the buckets' tiles; m has the columns of ``_LIKELY``."""

    def unit(run: pa.Table) -> tuple:
        first = {c: run.column(c)[0].as_py() for c in _UNIT}
        cols = [run.column(c).to_numpy() for c in ("component", "tile")]
        sig = binary_rows(run.column("sig"), "<u4")[0].reshape(run.num_rows, -1)
        return *cols, sig, first["band"], first["ta"] != first["tb"]

    def propose(run: pa.Table) -> pa.RecordBatch | None:
        label, tile, sig, band, crossing = unit(run)
        found = likely(label, tile, run.column("n").to_numpy(), sig, band, percent, crossing)
        return run.select([x.split()[0] for x in _LIKELY.split(", ")]).filter(pa.array(found)).combine_chunks().to_batches()[0] if found.any() else None

    def confirm(run: pa.Table) -> pa.RecordBatch | None:
        label, tile, sig, band, crossing = unit(run)
        value, off = binary_rows(run.column("set"), "<u8")
        found = link_bucket(run.column("id").to_numpy(), label, tile, sig, [value[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], band, percent, crossing)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"]) if found else None

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "id")

    rows = dealt(m.join(sets.select("id", "n", "sig"), "id"))
    near = materialize(rows.mapInArrow(lambda b: units(b, _UNIT, propose), _LIKELY), "likely")
    return dealt(near.join(sets.select("id", "sig", "set").hint("merge"), "id")).mapInArrow(lambda b: units(b, _UNIT, confirm), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of docs: documents
    are linked where 100 * intersection >= percent * union of their shingle sets."""
    spark = docs.sparkSession
    signed = materialize(_signed(docs, width), "signed")
    sets_ = signed.where("n > 0 and doc_id is not null")
    leaders = sets_.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"))
    # the numbers hold as they are written
    leaders = materialize(leaders.withColumn("id", F.monotonically_increasing_id()), "leaders")
    banded = materialize(_bands(leaders), "bands")
    crowded = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "bucket")
    crowded = materialize(crowded, "crowded")
    members = materialize(banded.join(crowded, ["band", "bucket"]), "members")
    discard(banded)
    ids = members.select("id").distinct()
    wanted = leaders.join(ids, "id", "left_semi")
    sets = materialize(_sets(docs, wanted.select("id", "doc_id", "d1", "n", "sig"), width), "sets")

    component = None
    for first, last in ROUNDS:
        m = members.where((F.col("band") >= first) & (F.col("band") < last))
        if component is None:
            m = m.withColumn("component", F.col("id"))
        else:
            m = m.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        m = m.join(sets.select("id", "n"), "id")
        open_ = (
            m.groupBy("band", "bucket")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("c"))
            .where("lo != hi")
            .select("band", "bucket", F.ceil(F.greatest(F.col("size") * 8 / TILE_BYTES, F.col("c") / TILE_ROWS)).cast("int").alias("tiles"))
        )
        # written, so that the join with a crowded bucket can be split
        open_ = materialize(open_, "open")
        m = m.drop("n").join(open_, ["band", "bucket"])
        tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        m = m.withColumn("tile", tile).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        m = m.withColumns({"ta": F.least("tile", "with"), "tb": F.greatest("tile", "with")}).drop("with", "tiles")
        new = materialize(_links(m, sets, percent), "links")
        if component is not None:  # what is joined already goes on as stars
            new = new.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b")))
        component = materialize(connected_components(new), "components")

    least = component.join(leaders.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "least")
    named = component.join(least.hint("merge"), "component").select("id", F.col("least").alias("component"))
    of_leader = leaders.select("d1", "d2", "n", "id", "doc_id").join(named, "id", "left").select("d1", "d2", "n", F.coalesce("component", "doc_id").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(of_leader.hint("merge"), ["d1", "d2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one document of each group of near-duplicates (the
    smallest doc_id of the group stays), all columns kept.

    A doc_id names one document: its rows stay if any of them is kept, and rows
    that repeat both id and text stay once.  A null doc_id stays.  A filter of
    fixed size lets most rows pass without a shuffle; only rows whose id may be
    among those dropped or repeated meet them in a join.
    """
    found = materialize(near_duplicates(docs, width, percent), "near")
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.where("not stays or n > 1").select("doc_id", "stays"), "marked")
    known = docs.sparkSession.sparkContext.broadcast(key_filter(ids, "doc_id"))
    bit, fresh = filter_column("doc_id"), "bit"
    while fresh in docs.columns:
        fresh += "_"
    marked = docs.withColumn(fresh, F.when(F.col("doc_id").isNotNull(), bit))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = batch.column(fresh)
                met = passes(known.value, bits.fill_null(0).to_numpy()) & bits.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(met if inside else ~met)).drop_columns([fresh])

        return run

    alone = marked.mapInArrow(part(False), docs.schema)
    met = marked.mapInArrow(part(True), docs.schema).hint("merge").join(ids.where("not stays"), "doc_id", "left_anti").select(docs.columns)
    return alone.unionByName(met.dropDuplicates(["doc_id", "text"]))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


def near_sql(width: int, percent: int) -> str:
    """``near_duplicates`` of documents in SQL: all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END AS g FROM d
), shingle AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL), link AS (
  SELECT a.r AS a, b.r AS b FROM shingle a JOIN shingle b ON a.x = b.x AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (SELECT reach.a AS r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN comp USING (r)
"""


OP3_SQL = near_sql(3, 85)
