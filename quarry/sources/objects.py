"""Object files and archives as DataFrames.

The bytes come from Spark's `binaryFile` source (any store that Spark reads);
parsing them is the one thing here that no built-in expression does, so it runs
over Arrow batches, a row at a time, and what it makes leaves in small batches: a
task's Python holds what Spark sends at once, and no more however many rows there
are.  What can't be parsed gets an ``error``, not a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.sources import formats

#: Bytes and rows at which a batch of made values is sent on.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1024


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, content of files; unused columns are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def plain_files(files: DataFrame) -> DataFrame:
    """path of each plain file; as a listing, it never opens one."""
    return files.select("path")


def file_kind(content: str = "content"):
    """`elf`, `macho`, `archive` or null, from the first bytes."""
    head = F.substr(F.col(content), F.lit(1), F.lit(8))
    four = F.substr(F.col(content), F.lit(1), F.lit(4))
    return (
        F.when(four == F.lit(formats.ELF), "elf")
        .when(four.isin([F.lit(m) for m in formats.MACHO]), "macho")
        .when(head == F.lit(formats.ARCHIVE), "archive")
    )


def _chunks(rows: Iterable[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``CHUNK_BYTES``, or of one row that is larger."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes | str))
        if size >= CHUNK_BYTES or len(held) >= CHUNK_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _parse(files: DataFrame, schema: str, types: list[pa.DataType], rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """What ``rows`` makes of each file.  One of no known format is refused by its
    beginning, so no more of it goes to Python."""
    names = [x.split()[0] for x in schema.split(", ")]
    content = F.when(file_kind().isNull(), F.substr("content", F.lit(1), F.lit(len(formats.ARCHIVE)))).otherwise(F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("path"), batch.column("content"), strict=True)
            yield from _chunks((r for path, content in own for r in rows(path.as_py(), content.as_py() or b"")), types, names)

    return files.select("path", content.alias("content")).mapInArrow(run, schema)


def object_kinds(files: DataFrame) -> DataFrame:
    """path, kind: `object` for a relocatable file, `other` for another object
    or an archive, `unparsable` for anything else.  Only the first bytes are looked
    at, so only they go to Python."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            yield path, "object" if formats.is_relocatable(content) else "other"
        except formats.FormatError:
            yield path, "unparsable"

    heads = files.select("path", F.substr("content", F.lit(1), F.lit(formats.HEAD_BYTES)).alias("content"))
    return _parse(heads, "path string, kind string", [pa.string(), pa.string()], rows)


def section_texts(files: DataFrame) -> DataFrame:
    """path, member_pos, member_name, text, error: the embedded text of each
    object, or of each member of an archive.  One bad member fails its archive,
    whose only row then says why; an object without the section has no row."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            if formats.sniff(content) == "archive":
                found = [(path, k, name, formats.embedded_text(own), None) for k, (name, own) in enumerate(formats.members(content))]
            else:
                found = [(path, 0, None, formats.embedded_text(content), None)]
            yield from (r for r in found if r[3] is not None)
        except formats.FormatError as bad:
            yield path, None, None, None, str(bad)

    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return _parse(files, "path string, member_pos int, member_name string, text string, error string", types, rows)


def archive_members(files: DataFrame) -> DataFrame:
    """path, member_pos, member_name, member_bytes, content, error."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            yield from [(path, k, name, len(own), own, None) for k, (name, own) in enumerate(formats.members(content))]
        except formats.FormatError as bad:
            yield path, None, None, None, None, str(bad)

    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    return _parse(files, "path string, member_pos int, member_name string, member_bytes long, content binary, error string", types, rows)


def embed(objects: DataFrame, text: str = "text") -> DataFrame:
    """objects with ``content``: an object file that holds the text as it is; made
    anew, or, where objects has a ``content``, that with the section added.  One
    that a section can't be added to has a null content and an ``embed_error``."""
    if "content" not in objects.columns:
        return embed_as(objects, text, formats.ELF_SECTION).withColumn("embed_error", F.lit(None).cast("string"))
    kept = [c for c in objects.columns if c != "content"]
    names = [*kept, "content", "embed_error"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.select(*kept).schema) + ", content binary, embed_error string"

    def one(own: bytes | None, said: str) -> tuple[bytes | None, str | None]:
        try:
            return formats.with_section(own or b"", said), None
        except formats.FormatError as bad:
            return None, str(bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("content"), batch.column(text), strict=True)
            at = 0
            for made in _chunks((one(c.as_py(), t.as_py() or "") for c, t in own), [pa.binary(), pa.string()], names[-2:]):
                part = batch.slice(at, made.num_rows)
                at += made.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.columns], names)

    return objects.mapInArrow(run, schema)


def embed_as(objects: DataFrame, text: str, name: str) -> DataFrame:
    """objects with ``content``: a new ELF object whose only section has that name.

    Built by expressions, so texts don't leave the JVM: it is the object of an empty
    text with its sizes and places written anew, as ``formats.elf_object`` would."""
    blank = formats.elf_object("", name)
    heads = blank[-192:]
    n_names = struct.unpack_from("<Q", heads, 128 + 32)[0]
    body = _bytes(text)
    at_names = F.octet_length(body) + 64
    table = F.ceil((at_names + n_names) / 8) * 8
    return objects.withColumn(
        "content",
        F.concat(
            *(F.lit(blank[:40]), _word(table), F.lit(blank[48:64]), body, F.lit(blank[64 : 64 + n_names])),
            F.substr(F.lit(bytes(8)), F.lit(1), (table - at_names - n_names).cast("int")),
            *(F.lit(heads[:96]), _word(at_names - 64), F.lit(heads[104:152]), _word(at_names), F.lit(heads[160:])),
        ),
    )


def embed_macho(objects: DataFrame, text: str = "text") -> DataFrame:
    """objects with ``content``: a new Mach-O object that holds the text, built as
    ``embed_as`` does it."""
    blank, body = formats.macho_object(""), _bytes(text)
    size = _word(F.octet_length(body))
    return objects.withColumn("content", F.concat(F.lit(blank[:64]), size, F.lit(blank[72:80]), size, F.lit(blank[88:144]), size, F.lit(blank[152:]), body))


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _word(value: Column) -> Column:
    """A number of up to 32 bits as 64 little-endian ones."""
    digits = (F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4))
    return F.unhex(F.concat(*digits, F.lit("00000000")))


def section_table(files: DataFrame) -> DataFrame:
    """path, section_pos, name, size, error: the sections of each object file."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            yield from [(path, k, name, len(own), None) for k, (name, own) in enumerate(formats.sections(content))]
        except formats.FormatError as bad:
            yield path, None, None, None, str(bad)

    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    return _parse(files, "path string, section_pos int, name string, size long, error string", types, rows)


def symbol_table(files: DataFrame) -> DataFrame:
    """path, symbol_pos, name, value, size, section, error: the symbols of each
    object file; values are 64 bits, so those past 2**63 come out negative."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            yield from [(path, k, name, _signed(value), size, section, None) for k, (name, value, size, section) in enumerate(formats.symbols(content))]
        except formats.FormatError as bad:
            yield path, None, None, None, None, None, str(bad)

    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _parse(files, "path string, symbol_pos int, name string, value long, size long, section string, error string", types, rows)


def relocation_table(files: DataFrame) -> DataFrame:
    """path, relocation_pos, section, offset, type, symbol_pos, addend, error: the
    relocations of each object file; without a symbol its place is null."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for k, (section, offset, kind, symbol, addend) in enumerate(list(formats.relocations(content))):
                yield path, k, section, _signed(offset), kind, None if symbol < 0 else symbol, addend, None
        except formats.FormatError as bad:
            yield path, None, None, None, None, None, None, str(bad)

    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return _parse(files, "path string, relocation_pos int, section string, offset long, type long, symbol_pos int, addend long, error string", types, rows)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def archive_of(objects: DataFrame, group: str, order: str, name: str, content: str = "content") -> DataFrame:
    """path, content: an archive per value of ``group``, members by ``order``.
    An archive is one value, so a group must fit in a row."""
    packed = objects.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(content).alias("c")))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("path"), batch.column("files"), strict=True)
            made = ((path.as_py(), formats.archive([(x["n"], x["c"]) for x in files.as_py()])) for path, files in own)
            yield from _chunks(made, [pa.string(), pa.binary()], ["path", "content"])

    return packed.select(F.col(group).cast("string").alias("path"), "files").mapInArrow(run, "path string, content binary")


def archive_as(objects: DataFrame, group: str, order: str, name: str, content: str = "content") -> DataFrame:
    """``archive_of``'s rows, built by expressions, so members don't leave the JVM.

    A long name's place in the name table is the length of those before it, a sum
    over the group's window; the members are joined in that window's order."""
    by = Window.partitionBy("path").orderBy("o", "n", "c")
    given = {k: F.coalesce(F.col(v), F.raise_error(F.lit(f"archive member without {v}"))) for k, v in (("n", name), ("c", content))}
    own = objects.select(F.col(group).alias("path"), F.col(order).alias("o"), given["n"].cast("binary").alias("n"), given["c"].alias("c"))
    own = own.withColumn("long", F.when(F.octet_length("n") > 15, F.concat("n", F.lit(b"/\n"))))
    before = F.coalesce(F.sum(F.octet_length("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.select("path", "long", "n", "c", before.alias("before"), F.row_number().over(by).alias("at"))
    short = F.concat("n", F.lit(b"/"))
    short = F.concat(short, F.substr(F.lit(b" " * 16), F.lit(1), 16 - F.octet_length(short)))
    named = F.when(F.col("long").isNull(), short).otherwise(F.rpad(F.concat(F.lit("/"), F.col("before").cast("string")), 16, " ").cast("binary"))
    own = own.select("path", "at", "long", _member(named, F.col("c")).alias("member"))
    joined = (F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY at)").alias(c) for c in ("long", "member"))
    packed = own.groupBy("path").agg(*joined)
    table = F.when(F.col("long").isNull(), F.lit(b"")).otherwise(_member(F.lit(b"//".ljust(16)), F.col("long")))
    return packed.select(F.col("path").cast("string").alias("path"), F.concat(F.lit(formats.ARCHIVE), table, "member").alias("content"))


def _member(name: Column, content: Column) -> Column:
    """A member of an archive under its name, padded to 16 bytes."""
    size = F.octet_length(content)
    head = F.concat(name, F.lit(formats.MEMBER), F.rpad(size.cast("string"), 10, " ").cast("binary"), F.lit(b"`\n"))
    return F.concat(head, content, F.when(size % 2 == 1, F.lit(b"\n")).otherwise(F.lit(b"")))
