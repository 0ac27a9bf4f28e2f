"""Embedding near-duplicates by random-hyperplane sign hashing.

Equal vectors of a label become one class with a multiplicity.  Each class's
vector is hashed in several tables of sign bits; classes that share a table's
bits share a bucket.  What travels to the buckets is an id and a sketch of 128
sign bits, not the vector: members whose sketches are as near as those of a pair
at the threshold may be are candidates, and only candidates fetch their vectors,
once per tile, to be compared by cosine in double precision.  A pair that meets
in several tables is counted in the first.  Buckets beyond ``TILE`` members are
split into tiles and each pair of tiles is a unit of its own, so no bucket is
held whole; units yield a link count per class and a forest of links, not pairs.
Components come from alternating large-star and small-star.

Bits and tables follow from the size of the largest label: enough bits that an
unstructured bucket holds about ``BUCKET`` classes, and enough tables that a pair
at the threshold is missed with a chance of ``MISS`` at most, the sketches' part
of it included (a closer pair less).

Defined cases: a null label, or a vector that is null, empty, zero or holds a
null or non-finite component, links with nothing; vectors of different lengths
are never linked; a null vec_id is a vector like others, though a component
whose ids are all null has a null id; rows that repeat a vec_id count as separate
vectors; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, mix64, units
from quarry.llm.components import connected_components

THRESHOLD = 0.93
BUCKET = 512
TILE = 2048
MISS = 1e-5
SEED = 11
SKETCH_BITS = 128


def plan_tables(largest: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables); nine tenths of ``miss`` are the tables' own."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest) / bucket)) if largest > bucket else 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(0.9 * miss) / math.log1p(-agree))


def sketch_limit(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most sketch bits in which a candidate pair may differ: a pair at the
    threshold differs in more with a chance of a tenth of ``miss`` at most."""
    n, p, within = SKETCH_BITS, math.acos(threshold) / math.pi, 0.0
    for d in range(n + 1):
        within += math.comb(n, d) * p**d * (1 - p) ** (n - d)
        if 1 - within <= miss / 10:
            return d
    return n


def sign_bits(x: np.ndarray, n: int) -> np.ndarray:
    """The sides of the first n hyperplanes that each vector lies on (rows x n);
    plane k is the same whatever n is."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((n, x.shape[1]))
    return x @ planes.T >= 0


def table_keys(up: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's bits under every table, as integers (rows x tables)."""
    return (up[:, : bits * tables].reshape(len(up), tables, bits) << np.arange(bits)).sum(2).astype(np.int32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares can't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def candidates(up: np.ndarray, tile: np.ndarray, table: int, bits: int, limit: int, crossing: bool) -> np.ndarray:
    """Which members of a bucket (or of two of its tiles) have a partner there as
    near by sketch as a link may be, that they don't already meet in an earlier
    table as far as the sketch tells."""
    sign, found = np.where(up, np.float32(1), np.float32(-1)), np.zeros(len(up), bool)
    told = min(table, SKETCH_BITS // bits)
    early = table_keys(up, bits, told) if told else None
    for begin in range(0, len(up), 512):
        i, j = np.nonzero(sign[begin : begin + 512] @ sign.T >= SKETCH_BITS - 2 * limit)
        i = i + begin
        keep = j > i
        if crossing:
            keep &= tile[i] != tile[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            if told:
                fresh = ~(early[a] == early[b]).any(1)
                a, b = a[fresh], b[fresh]
            found[a] = found[b] = True
    return found


def link_unit(x: np.ndarray, keys: np.ndarray, count: np.ndarray, tile: np.ndarray, table: int, threshold: float, crossing: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links found in one bucket or pair of its tiles: for each member the number
    of vectors it links with, and pairs that connect what is linked."""
    links, forest, label = np.zeros(len(x), np.int64), [], np.arange(len(x))
    for begin in range(0, len(x), 512):
        rows = slice(begin, begin + 512)
        i, j = np.nonzero(x[rows] @ x.T >= threshold - 1e-9)
        i = i + begin
        keep = j > i
        if crossing:
            keep &= tile[i] != tile[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            first = (keys[a] == keys[b]).argmax(1) == table
            a, b = a[first], b[first]
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            np.add.at(links, a, count[b])
            np.add.at(links, b, count[a])
            while len(a):  # the pairs left each join two components, or go
                p, q = int(a[0]), int(b[0])
                forest.append((p, q))
                label[label == label[q]] = label[p]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    return links, forest


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and the n+1 offsets of its rows."""
    off = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), off - off[0]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of vectors."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(kind).alias("x"))
    fine = (
        F.col("label").isNotNull()
        & (F.size("x") > 0)
        & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists("x", lambda c: c != 0)
    )
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    v = v.withColumns({"h1": F.when(F.col("fine"), F.xxhash64("label", "x")), "h2": F.when(F.col("fine"), F.xxhash64("x", "label", F.lit(1)))})
    classes = v.where("fine").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("count"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    limit = sketch_limit(threshold)

    def hashed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of at most 1024 rows at a time: which they are, their buckets (rows x
        tables) and their signs."""
        flat, off = _flat(batch.column("x"))
        n = np.diff(off)
        label = batch.column("lab").to_numpy().astype(np.uint64)
        table = (np.arange(tables, dtype=np.uint64) << np.uint64(32))[None, :]
        for d in np.unique(n):
            whole = np.flatnonzero(n == d)
            for begin in range(0, len(whole), 1024):
                at = whole[begin : begin + 1024]
                up = sign_bits(unit_rows(flat[off[at][:, None] + np.arange(d)].astype(np.float64)), max(SKETCH_BITS, bits * tables))
                salt = mix64(mix64(label[at] + np.uint64(d)))
                yield at, mix64(salt[:, None] + mix64(table + table_keys(up, bits, tables).astype(np.uint64))), up

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket, n = np.unique(np.concatenate([b.ravel() for _, b, _ in hashed(batch)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n)], ["bucket", "n"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for at, bucket, up in hashed(batch):
                    sketch = np.packbits(up[:, :SKETCH_BITS], axis=1).view(np.int64)
                    take = np.repeat(np.arange(len(at)), tables)
                    cols = [batch.column("id").take(pa.array(at[take])), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(bucket.ravel().view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(np.ascontiguousarray(sketch[:, k])[take]) for k in (0, 1))], ["id", "t", "bucket", "s0", "s1"])

    def propose(unit: pa.Table) -> pa.RecordBatch | None:
        sketch = np.column_stack([unit.column(c).to_numpy() for c in ("s0", "s1")])
        up = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1).astype(bool)
        first = {c: unit.column(c)[0].as_py() for c in ("t", "ta", "tb")}
        found = candidates(up, unit.column("tile").to_numpy(), first["t"], bits, limit, first["ta"] != first["tb"])
        if not found.any():
            return None
        kept = unit.select(["id", "t", "bucket", "ta", "tb", "tile"]).filter(pa.array(found)).combine_chunks()
        return kept.to_batches()[0]

    def confirm(unit: pa.Table) -> pa.RecordBatch | None:
        ids, count, tile = (unit.column(c).to_numpy() for c in ("id", "count", "tile"))
        first = {c: unit.column(c)[0].as_py() for c in ("t", "ta", "tb")}
        flat, _ = _flat(unit.column("x").combine_chunks())
        x = unit_rows(flat.reshape(len(ids), -1).astype(np.float64))
        keys = table_keys(sign_bits(x, max(SKETCH_BITS, bits * tables)), bits, tables)
        links, forest = link_unit(x, keys, count, tile, first["t"], threshold, first["ta"] != first["tb"])
        some = np.flatnonzero(links)
        if not len(some):
            return None
        pair = np.array(forest, np.int64).reshape(-1, 2)
        a = pa.array(np.concatenate([ids[some], ids[pair[:, 0]]]))
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[pair[:, 1]])])
        return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.array(links[some]), pa.nulls(len(pair), pa.int64())])], ["a", "b", "links"])

    rows = classes.select("id", F.xxhash64("label").alias("lab"), "x")
    crowded = rows.mapInArrow(sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > TILE)
    crowded = materialize(crowded.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "crowded")
    m = rows.mapInArrow(sketched, "id long, t int, bucket long, s0 long, s1 long").join(crowded, "bucket", "left")
    tiles = F.coalesce("tiles", F.lit(1))
    m = m.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    m = m.select("id", "t", "bucket", "s0", "s1", "tile", F.least("tile", "with").alias("ta"), F.greatest("tile", "with").alias("tb"))
    m = m.repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb")
    near = materialize(m.mapInArrow(lambda b: units(b, ("bucket", "ta", "tb"), propose), "id long, t int, bucket long, ta int, tb int, tile int"), "near")
    near = near.join(classes.select("id", "count", "x").hint("merge"), "id").repartition("bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb", "id")
    found = materialize(near.mapInArrow(lambda b: units(b, ("bucket", "ta", "tb"), confirm), "a long, b long, links long"), "links")
    component = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    c = classes.select("h1", "h2", "id", "least", "count").join(links, "id", "left").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    c = materialize(c.drop("id"), "linked")
    # written, so that a large component's join can be split
    least = materialize(c.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    c = c.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id")
    c = materialize(c, "found")
    out = v.select("vec_id", "fine", "h1", "h2").join(c.hint("merge"), ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (
  SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), n AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN n USING (r)
"""
