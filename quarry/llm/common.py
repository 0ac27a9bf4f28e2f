"""Shared parts of the corpus operators: scratch tables and byte kernels.

Scratch tables go to the shared folder the cluster names in
``spark.checkpoint.dir``; a machine-local folder is used only by a local
session that names none.  The byte kernels work on the UTF-8 buffers of Arrow
columns with numpy, so no Python string is made per word.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables that driver and executors all see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        _own_dirs[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts
    its lineage: a lost executor costs one task's read, not the whole past."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}-{tag}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing will read it."""
    path = getattr(df, "_quarry_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def id_fold(col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(modulus))


# ---------------------------------------------------------------- byte kernels

#: What separates words: space and the controls 9 to 13.
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time, and so the length of the power tables.
_HASH_BYTES = 1 << 21
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            full = np.full(_HASH_BYTES + 1, np.uint64(base))
            full[0] = 1
            _powers.append(np.cumprod(full))
    return _powers[0], _powers[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, concatenated, and the n+1 row
    offsets; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rebatches to whole rows of about ``limit`` bytes of text, which bounds the
    kernels' memory; a longer row comes alone and whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(sizes)
        at, done = 0, 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(end, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at, done = upto, int(end[upto - 1])


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` (or what lies between
    other separators), and the n+1 offsets of each row's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    fresh[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cut = off[1:] - 1
    last[cut[cut >= 0]] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums over a stretch of spans
    at a time; spans come in order and don't overlap, and may be of any length."""
    power, inverse = _power_tables()
    out, at = np.zeros(len(starts), np.uint64), 0

    def prefix(begin: int, end: int) -> np.ndarray:
        part = data[begin:end]
        codes = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes * power[: len(part)], out=sums[1:])
        return sums

    while at < len(starts):
        begin = int(starts[at])
        upto = int(np.searchsorted(ends, begin + _HASH_BYTES, "right"))
        if upto > at:
            sums = prefix(begin, int(ends[upto - 1]))
            a, b = starts[at:upto] - begin, ends[at:upto] - begin
            out[at:upto] = (sums[b] - sums[a]) * inverse[a]
        else:  # one span, longer than a stretch
            upto, total = at + 1, 0
            for k in range(begin, int(ends[at]), _HASH_BYTES):
                total += int(prefix(k, min(k + _HASH_BYTES, int(ends[at])))[-1]) * pow(_BASE, k - begin, 1 << 64)
            out[at] = total & 0xFFFFFFFFFFFFFFFF
        at = upto
    return mix64(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def shingle_hashes(h: np.ndarray, word_off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each row: their 64-bit hashes, sorted
    within a row, and the n+1 row offsets.  A row with fewer words has its whole
    sequence as one shingle; a row without words has none."""
    counts = np.diff(word_off)
    n = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    rows = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(word_off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    value = np.zeros(len(first), np.uint64)
    long = counts[rows] >= width
    at = first[long]
    acc = np.full(len(at), np.uint64(width))
    for k in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    value[long] = acc
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        acc = np.full(1, np.uint64(counts[r]))
        for x in h[word_off[r] : word_off[r + 1]]:
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + x)
        value[np.searchsorted(rows, r)] = acc[0]
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    rows, value = rows[keep], value[keep]
    return value, np.searchsorted(rows, np.arange(len(counts) + 1))


def units(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of each run of two or more rows with equal keys; rows
    come sorted by them, and no more than a run and a batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in key]
        edge = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key):
            edge = [0, *edge]
        at = 0
        for e in edge:
            held.append(batch.slice(at, e - at))
            run = pa.Table.from_batches(held)
            if run.num_rows > 1 and (out := work(run)) is not None:
                yield out
            held, at = [], e
        held.append(batch.slice(at))
    if held:
        run = pa.Table.from_batches(held)
        if run.num_rows > 1 and (out := work(run)) is not None:
            yield out


def binary_rows(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's rows as numbers of a kind, concatenated, and their n+1 offsets."""
    raw, off = byte_view(column)
    return np.frombuffer(raw.tobytes(), kind), off // np.dtype(kind).itemsize


#: All bytes but ASCII letters and digits and those of longer UTF-8 sequences.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# ------------------------------------------------------------- bounded samples


def _fitting(sizes: np.ndarray, per_label: int, share: int) -> np.ndarray:
    """Which of a label's rows, in hash order, to take: a row that doesn't fit in
    what is left of the share is stepped over; if none fits, the smallest."""
    out, left = [], share
    for k, b in enumerate(sizes.tolist()):
        if b <= left:
            out.append(k)
            left -= b
            if len(out) == per_label:
                break
    return np.array(out or [int(sizes.argmin())], np.int64)


def bounded_sample(docs: DataFrame, labelled: DataFrame, per_label: int, max_bytes: int, max_labels: int) -> tuple[pa.Table, dict]:
    """Whole texts of labelled rows to fit a model on, and the rows of each label.

    ``labelled`` has doc_id and label, and text where the labels are the rows' own;
    else a label goes to one text of its doc_id.  Of each label the ``per_label``
    rows with the smallest hash are taken, but for those that would exceed an equal
    share of ``max_bytes``, which are stepped over; a label with no text in its
    share has its smallest candidate.  Of more than ``max_labels`` labels those with
    most rows (of as many, the first by code point) are learned.  So the sample is the same on every run and
    has a size that doesn't grow with the data.  Only counts are over all rows.
    """
    own = "text" in labelled.columns
    labelled = labelled.where(F.col("text" if own else "doc_id").isNotNull())
    labelled = labelled.withColumn("h", F.xxhash64("doc_id", "text") if own else F.xxhash64("doc_id"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d"))
    counts = counts.orderBy(F.desc("n"), "label").limit(max_labels).collect()
    # twice the rows wanted, by hash, so that some can be stepped over
    near = F.lit(False)
    for label, _, distinct in counts:
        cut = min(1.0, (2 * per_label + 1000) / max(1, distinct))
        near = near | ((F.col("label") == label) & (F.col("h") <= int(-(2**63) + cut * (2**64 - 1) if cut < 1 else 2**63 - 1)))
    rows = labelled.where(near)
    if not own:
        texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
        rows = texts.join(F.broadcast(rows.dropDuplicates(["doc_id", "label"])), "doc_id")
    rows = rows.select("doc_id", "label", "h", F.xxhash64("text").alias("t"), "text")
    # one row of those that share a hash
    sizes = rows.groupBy("label", "h").agg(F.min(F.struct("t", F.octet_length("text").alias("b"))).alias("x")).select("label", "h", "x.t", "x.b")
    sizes = sizes.toPandas().sort_values(["label", "h"])
    share = max_bytes // max(1, len(counts))
    chosen = [g.iloc[_fitting(g["b"].to_numpy(), per_label, share)] for _, g in sizes.groupby("label")]
    picked = [(x.label, int(x.h), int(x.t)) for g in chosen for x in g.itertuples()]
    keys = docs.sparkSession.createDataFrame(picked, rows.select("label", "h", "t").schema)
    table = rows.join(F.broadcast(keys), ["label", "h", "t"]).dropDuplicates(["label", "h", "t"]).select("doc_id", "label", "h", "text").toArrow()
    return table.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("label", "ascending")]).combine_chunks(), {r.label: r.n for r in counts}


def release_memory() -> None:
    """Gives what a fit has freed back to the system, so that one driver can fit
    a model after another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


# ------------------------------------------------------------- bounded filters

#: Bits of the filter that is sent to every worker: 4 MB, whatever the data.
FILTER_BITS = 1 << 25


def _filter_bit(h: Column) -> Column:
    return F.pmod(h, F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """A one-hash Bloom filter of a long column, of FILTER_BITS bits however many
    keys there are: with more keys it only lets more rows through.  It goes to
    the driver as at most FILTER_BITS/64 words."""
    bit = _filter_bit(F.xxhash64(F.col(col).cast("long")))
    got = (
        keys.select(bit.alias("b"))
        .groupBy((F.col("b") / 64).cast("long").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
        .toArrow()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def filter_column(col: str) -> Column:
    """The bit that a row's key would have set."""
    return _filter_bit(F.xxhash64(F.col(col).cast("long")))


def passes(filter_words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_words[bits >> 6] >> (bits & 63)) & 1 == 1
