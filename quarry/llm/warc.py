"""WARC archives with segmented records and chunked transfer framing.

Writing: each page becomes one record.  Among records with equal payloads of at
least ``revisit_min`` bytes the one with the smallest page id is a `response`,
the others are `revisit` records that refer to it and carry no payload.  A block
longer than ``segment_bytes`` is split into a first record and `continuation`
records, which may land in other archives.

Reading: records are parsed one gzip member at a time; segments are grouped by
the identifier of their origin record, ordered by segment number, their total
length verified, and the chunked framing decoded.

Defined cases: a null html is an empty payload; a null page id is written as an
empty field and read back as null; rows that repeat the smallest page id of a
group of equal payloads are all responses; other columns of the input are not
carried; an empty table gives no archives and no rows.  A group with a missing
segment, a wrong total length or a wrong digest is kept and its ``status`` says so.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import filter_column, key_filter, materialize, passes

REVISIT_MIN = 100
SEGMENT_BYTES = 16 << 10
FRAME_BYTES = 4 << 10
ARCHIVE_BYTES = 1 << 20

_CRLF = b"\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def assign_types(pages: DataFrame, revisit_min: int = REVISIT_MIN) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which page each record refers to.

    Group sizes are aggregated before the shuffle, so a hot payload costs one row
    per task.  The repeated groups are written, so that the join with a hot digest
    can be split, and a filter of fixed size (4 MB) over them lets the rows whose
    payload occurs once pass without a join.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html"), 256))
    groups = (
        p.where(F.octet_length("html") >= revisit_min)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    groups = materialize(groups.withColumn("key", F.xxhash64("digest")), "groups")
    known = pages.sparkSession.sparkContext.broadcast(key_filter(groups, "key"))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                met = passes(known.value, batch.column("bit").to_numpy())
                yield batch.filter(pa.array(met if inside else ~met)).drop_columns(["bit"])

        return run

    marked = p.withColumn("key", F.xxhash64("digest")).withColumn("bit", filter_column("key")).drop("key")
    alone, met = (marked.mapInArrow(part(inside), p.schema) for inside in (False, True))
    joined = met.hint("merge").join(groups.select("digest", "first_id"), "digest", "left")
    # <=> so that a null page id is not mistaken for the group's first
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return alone.withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined.withColumn("refers_to", refers).drop("first_id"))


def _chunked(body: bytes, frame: int) -> bytes:
    out = []
    for at in range(0, len(body), frame):
        part = body[at : at + frame]
        out += [b"%x" % len(part), _CRLF, part, _CRLF]
    return b"".join(out) + b"0\r\n\r\n"


def decode_chunked(framed: bytes) -> bytes:
    """Undoes chunked transfer framing; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = framed.find(_CRLF, at)
        if end < 0:
            raise ValueError("no chunk size line")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != _CRLF:
            raise ValueError("chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + v + _CRLF for k, v in fields)
    return head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(serial: int, page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, frame: int = FRAME_BYTES) -> Iterator[bytes]:
    """The record or records of one page, in order."""
    page = b"" if page_id is None else b"%d" % page_id
    rid = b"<urn:page:%d:%s>" % (serial, page)
    uri = " ".join((url or "").split()).encode()
    common = [(b"WARC-Record-ID", rid), (b"WARC-Target-URI", uri), (b"WARC-Date", b"1970-01-01T00:00:00Z"), (b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"Content-Type", b"application/http;msgtype=response"), (b"Page-ID", page)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
        yield _record([(b"WARC-Type", b"revisit"), *common, (b"WARC-Profile", _PROFILE), (b"Refers-To-Page-ID", b"%d" % refers_to)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(html, frame)
    if len(block) <= segment_bytes:
        yield _record([(b"WARC-Type", b"response"), *common], block)
        return
    count = -(-len(block) // segment_bytes)
    for k in range(count):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield _record([(b"WARC-Type", b"response"), *common, (b"WARC-Segment-Number", b"1")], part)
        else:
            total = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if k == count - 1 else []
            yield _record([(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", rid[:-1] + b":%d>" % (k + 1)), (b"WARC-Segment-Origin-ID", rid), (b"WARC-Segment-Number", b"%d" % (k + 1)), *total], part)


def write_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archives as rows (name, content): gzip members of one record each, closed
    at about ``archive_bytes``, so a task holds one archive at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, first = bytearray(), None
        for batch in batches:
            cols = [batch.column(c) for c in ("serial", "page_id", "url", "html", "digest", "refers_to")]
            for k in range(batch.num_rows):
                serial, page, url, html, digest, ref = (c[k] for c in cols)
                first = serial.as_py() if first is None else first
                for record in page_records(serial.as_py(), page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), ref.as_py(), segment_bytes):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    blob += z.compress(record) + z.flush()
                if len(blob) >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([f"pages-{first:016d}.warc.gz"]), pa.array([bytes(blob)])], ["name", "content"])
                    blob, first = bytearray(), None
        if blob:
            yield pa.RecordBatch.from_arrays([pa.array([f"pages-{first:016d}.warc.gz"]), pa.array([bytes(blob)])], ["name", "content"])

    rows = typed.select(F.monotonically_increasing_id().alias("serial"), "page_id", "url", "html", "digest", "refers_to")
    return rows.mapInArrow(build, "name string, content binary")


def members(content: memoryview | bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            part = view[at : at + window]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """The named fields, in lower case, and the block."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower()] = v.strip()
    size = int(fields[b"content-length"])
    block = record[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("record is shorter than its Content-Length")
    return fields, block


def _payload(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    end = block.index(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block[:end].split(_CRLF)[1:])}
    body = block[end + 4 :]
    return (decode_chunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body), http


_PARSED = "origin string, segment long, total long, page_id long, record_type string, refers_to long, digest string, payload_bytes long, status string, payload binary, block binary"


def _finish(fields: dict[bytes, bytes], block: bytes, keep_payload: bool) -> tuple:
    said = fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
    kind, page, ref = fields[b"warc-type"].decode(), fields.get(b"page-id"), fields.get(b"refers-to-page-id")
    try:
        body, http = _payload(block)
        if kind == "revisit":
            digest, n, status = said, int(http[b"content-length"]), "ok"
        else:
            digest, n = hashlib.sha256(body).hexdigest(), len(body)
            status = "ok" if digest == said else "digest_mismatch"
    except (ValueError, KeyError):
        body, digest, n, status = None, said, None, "bad_framing"
    return int(page) if page else None, kind, int(ref) if ref else None, digest, n, status, body if keep_payload and kind == "response" else None


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per origin record: page_id, record_type, refers_to, payload_digest,
    payload_bytes, status (ok, digest_mismatch, bad_framing, missing_segment or
    length_mismatch) and, if asked for, payload.

    Only segmented records move their blocks through the shuffle; a group is one
    record's segments, so it is as large as that record and no larger.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in members(content.as_buffer()):
                    fields, block = parse_record(record)
                    number = int(fields.get(b"warc-segment-number", b"0"))
                    if number == 0:
                        page, kind, ref, digest, n, status, body = _finish(fields, block, keep_payload)
                        rows.append((fields[b"warc-record-id"].decode(), 0, None, page, kind, ref, digest, n, status, body, None))
                        held += len(body or b"")
                    else:
                        origin = fields.get(b"warc-segment-origin-id", fields[b"warc-record-id"]).decode()
                        total = fields.get(b"warc-segment-total-length")
                        head = record[: len(record) - len(block) - 4] if number == 1 else b""
                        rows.append((origin, number, int(total) if total else None, None, None, None, None, None, None, head, block))
                        held += len(block)
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column("parts"):
                parts = item.as_py()
                first = parts[0]
                if first["segment"] == 0:
                    rows.append((first["page_id"], first["record_type"], first["refers_to"], first["digest"], first["payload_bytes"], first["status"], first["payload"]))
                    continue
                total = next((p["total"] for p in parts if p["total"] is not None), None)
                block = b"".join(p["block"] for p in parts)
                if first["segment"] != 1:
                    rows.append((None, "response", None, None, None, "missing_segment", None))
                    continue
                fields, _ = parse_record(first["payload"] + first["block"])
                row = _finish(fields, block, keep_payload)
                if total is None or [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    row = (*row[:4], None, "missing_segment", None)
                elif total != len(block):
                    row = (*row[:4], None, "length_mismatch", None)
                rows.append(row)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "status", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    part = F.struct("segment", "total", "page_id", "record_type", "refers_to", "digest", "payload_bytes", "status", "payload", "block")
    parsed = archives.mapInArrow(parse, _PARSED)
    grouped = parsed.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts")).select("parts")
    out = grouped.mapInArrow(assemble, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, status string, payload binary")
    return out if keep_payload else out.drop("payload")


def round_trip(pages: DataFrame, revisit_min: int = REVISIT_MIN, segment_bytes: int = SEGMENT_BYTES, keep_payload: bool = False) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    archives = materialize(write_archives(assign_types(pages, revisit_min), segment_bytes=segment_bytes), "warc")
    return read_archives(archives, keep_payload)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id IS DISTINCT FROM g.first_id AND g.first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
