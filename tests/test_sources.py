import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.operators.extract import sorted_paths_per_object
from quarry.sources import formats, manifest, objects


def test_object_round_trips():
    for make in (formats.elf_object, formats.macho_object):
        data = make("/tmp/hello.bc\n")
        assert formats.is_relocatable(data) and formats.embedded_text(data) == "/tmp/hello.bc\n"
    assert formats.embedded_text(formats.elf_object("x", name=".other")) is None


def test_a_section_is_added_to_what_is_there():
    import struct

    data = formats.elf_object("/a.bc", name=".notes")
    more = formats.with_section(data, "/b.bc")
    assert dict(formats.sections(more))[".notes"] == b"/a.bc" and formats.embedded_text(more) == "/b.bc" and formats.is_relocatable(more)
    # a 32-bit big-endian one, written out by hand
    names = b"\0.shstrtab\0"
    head = b"\x7fELF\x01\x02\x01" + bytes(9) + struct.pack(">HHIIIIIHHHHHH", 1, 8, 1, 0, 0, 52 + 12, 0, 52, 0, 0, 40, 2, 1)
    data = head + names.ljust(12, b"\0") + bytes(40) + struct.pack(">10I", 1, 3, 0, 0, 52, 11, 0, 0, 1, 0)
    assert formats.embedded_text(formats.with_section(data, "/c.bc")) == "/c.bc"
    for bad in (formats.macho_object("x"), data[:52], b"", b"text"):
        with pytest.raises(formats.FormatError):
            formats.with_section(bad, "x")


def test_extraction_of_files_on_disk(spark, tmp_path):
    from quarry.plans.extraction import extract_files

    (tmp_path / "one.o").write_bytes(formats.elf_object("/b.bc\n/a.bc\n/a.bc\n"))
    (tmp_path / "two.dylib").write_bytes(formats.macho_object("/m.bc"))
    (tmp_path / "lib.a").write_bytes(formats.archive([("x.o", formats.elf_object("/y.bc")), ("y.o", formats.elf_object("/x.bc\n/y.bc"))]))
    (tmp_path / "bad.a").write_bytes(formats.archive([("x.o", formats.elf_object("/x.bc")), ("t.txt", b"text")]))
    (tmp_path / "none.o").write_bytes(formats.elf_object("x", name=".other"))
    (tmp_path / "notes.txt").write_text("text")
    rows = {os.path.basename(r.path): r for r in extract_files(spark, str(tmp_path), archive=True, manifest=True).collect()}
    assert rows["one.o"].args == ["llvm-link", "-o", "one.bc", "/a.bc", "/b.bc"] and rows["one.o"].manifest == "/a.bc\n/b.bc"
    assert rows["two.dylib"].args == ["llvm-link", "-o", "two.bc", "/m.bc"]
    assert rows["lib.a"].args == ["llvm-ar", "rs", "lib.bca", "/x.bc", "/y.bc"] and rows["lib.a"].manifest_path.endswith("/lib.bca.manifest")
    assert {k: r.error for k, r in rows.items() if r.error} == {"bad.a": "unsupported file format", "none.o": "no embedded paths", "notes.txt": "unsupported file format"}
    plain = {os.path.basename(r.path): r for r in extract_files(spark, str(tmp_path), "*.a", output="all.bc").collect()}
    assert plain["lib.a"].args == ["llvm-link", "-o", "all.bc", "/x.bc", "/y.bc"] and plain["lib.a"].manifest is None


def test_archive_round_trip_with_long_names():
    files = [("a.o", b"1"), ("a_very_long_member_name.o", b"22"), ("b.o", b"")]
    assert list(formats.members(formats.archive(files))) == files


@pytest.mark.parametrize("data", [b"", b"\x7fELF", b"!<arch>\nshort", formats.elf_object("x")[:70], b"text"])
def test_broken_files_raise_format_errors(data):
    with pytest.raises(formats.FormatError):
        list(formats.members(data)) if data.startswith(b"!<") else list(formats.sections(data))


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "hello.o").write_bytes(formats.elf_object("/tmp/hello.bc\n"))
    (tmp_path / "lib.dylib").write_bytes(formats.macho_object("/tmp/foo.bc\n/tmp/bar.bc\n/tmp/baz.bc\n/tmp/bar.bc\n"))
    (tmp_path / "lib.a").write_bytes(formats.archive([("x.o", formats.elf_object("/x.bc\n")), ("y.o", formats.elf_object("/y.bc\n"))]))
    (tmp_path / "bad.a").write_bytes(formats.archive([("x.o", formats.elf_object("/x.bc\n")), ("t.txt", b"text")]))
    (tmp_path / "notes.txt").write_text("text")
    files = objects.read_files(spark, str(tmp_path))
    kinds = {os.path.basename(r.path): r.kind for r in objects.object_kinds(files).collect()}
    assert kinds == {"hello.o": "object", "lib.dylib": "object", "lib.a": "unparsable", "bad.a": "unparsable", "notes.txt": "unparsable"}
    found = sorted_paths_per_object(objects.section_texts(files))
    got = {(os.path.basename(r.path), r.member_pos): r.paths for r in found.where("error is null").collect()}
    assert got[("hello.o", 0)] == ["/tmp/hello.bc"]
    assert got[("lib.dylib", 0)] == ["/tmp/bar.bc", "/tmp/baz.bc", "/tmp/foo.bc"]
    assert got[("lib.a", 1)] == ["/y.bc"] and not any(k[0] == "bad.a" for k in got)
    assert {os.path.basename(r.path) for r in found.where("error is not null").collect()} == {"bad.a", "notes.txt"}
    sniffed = {os.path.basename(r.path): r.k for r in files.select("path", objects.file_kind().alias("k")).collect()}
    assert sniffed == {"hello.o": "elf", "lib.dylib": "macho", "lib.a": "archive", "bad.a": "archive", "notes.txt": None}


def test_manifest_has_no_trailing_newline(spark, tmp_path):
    df = spark.createDataFrame([(f"{tmp_path}/app.o", ["/a", "/b"])], "path string, paths array<string>")
    df = df.withColumn("output", P.output_name(F.col("path"), F.lit("archive"), F.lit(False)))
    manifest.write_manifests(manifest.manifests(df))
    assert (tmp_path / "app.a.bc.manifest").read_bytes() == b"/a\n/b"


def test_stream_of_commands(spark, tmp_path):
    from quarry.streaming import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"cmd_id": 1, "tokens": ["a.c", "-c"], "compiler_kind": "Clang"}\n')
    query = follow(spark, str(tmp_path / "in")).select("cmd_id", "is_compile_only").writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("seen").collect()] == [(1, True)]


def test_built_objects_are_those_of_the_format(spark):
    texts = [None, "", "\n", "/a/ü.bc\n", "\U0001f600" * 3, *("x" * n for n in range(1, 20)), "y" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", F.lit("kept").alias("other"))
    for df, make in (
        (objects.embed(docs), formats.elf_object),
        (objects.embed_as(docs, "text", ".notes"), lambda t: formats.elf_object(t, ".notes")),
        (objects.embed_macho(docs), formats.macho_object),
    ):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
        assert {r.id: bytes(r.content) for r in df.where("other = 'kept'").collect()} == {k: make(t or "") for k, t in enumerate(texts)}


@pytest.mark.parametrize("many", [1, 40])
def test_python_sends_on_small_batches(many):
    """What a task's Python makes of one large batch leaves in parts of about a MB."""
    rows = ((f"/{k}", bytes(300_000)) for k in range(many))
    sizes = [b.nbytes for b in objects._chunks(rows, [objects.pa.string(), objects.pa.binary()], ["path", "content"])]
    assert sum(sizes) > 300_000 * many and max(sizes) < objects.CHUNK_BYTES + 400_000 and len(sizes) == -(-many // 4)
    assert list(objects._chunks([], [objects.pa.string()], ["path"])) == []


def sent_to_python(monkeypatch, df, make):
    """(frame, function) of each step in Python that ``make`` asks for."""
    seen = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, schema, *_: seen.append((self, run)) or self)
        make(df)
    return seen


def test_kinds_need_the_heads_only(spark, monkeypatch):
    files = [formats.elf_object("x" * 9000), formats.macho_object("y" * 9000), b"z" * 9000, formats.elf_object("")[:17], formats.macho_object("")[:15], b"", None]
    df = spark.createDataFrame([(str(k), c) for k, c in enumerate(files)], "path string, content binary")
    ((frame, _),) = sent_to_python(monkeypatch, df, objects.object_kinds)
    assert frame.agg(F.max(F.octet_length("content"))).first()[0] <= formats.HEAD_BYTES
    assert [r.kind for r in objects.object_kinds(df).orderBy("path").collect()] == ["object"] * 2 + ["unparsable"] * 5


def test_added_sections_leave_in_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([], "line string, content binary")
    ((_, run),) = sent_to_python(monkeypatch, df, lambda d: objects.embed(d, "line"))
    own = objects.pa.RecordBatch.from_pydict({"line": [f"/{k}" for k in range(40)] + ["x"], "content": [formats.elf_object("x" * 300_000)] * 40 + [b"text"]})
    out = list(run(iter([own])))
    assert [r for b in out for r in b.column("line").to_pylist()] == own.column("line").to_pylist() and len(out) > 9
    texts = [formats.embedded_text(c) if c else None for b in out for c in b.column("content").to_pylist()]
    assert texts[:40] == ["x" * 300_000] * 40 and texts[40] is None and out[-1].column("embed_error")[-1].as_py() is not None


def test_archives_leave_in_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([], "lib int, k int, name string, content binary")
    ((_, run),) = sent_to_python(monkeypatch, df, lambda d: objects.archive_of(d, "lib", "k", "name"))
    group = [{"o": k, "n": f"{k}.o", "c": bytes(300_000)} for k in range(2)]
    out = list(run(iter([objects.pa.RecordBatch.from_pydict({"path": [str(k) for k in range(40)], "files": [group] * 40})])))
    assert sum(b.num_rows for b in out) == 40 and max(b.nbytes for b in out) < objects.CHUNK_BYTES + 700_000
    assert all(list(formats.members(c)) == [("0.o", bytes(300_000)), ("1.o", bytes(300_000))] for b in out for c in b.column("content").to_pylist())


def test_parsed_rows_share_batches(spark, monkeypatch):
    df = spark.createDataFrame([], "path string, content binary")
    ((_, run),) = sent_to_python(monkeypatch, df, objects.section_texts)
    small, large = formats.elf_object("/a.bc"), formats.macho_object("/" * 700_000)
    own = objects.pa.RecordBatch.from_pydict({"path": [str(k) for k in range(2010)], "content": [small] * 2000 + [large] * 10})
    out = list(run(iter([own])))
    assert [r for b in out for r in b.column("path").to_pylist()] == own.column("path").to_pylist()
    assert len(out) < 10 and max(b.nbytes for b in out) < objects.CHUNK_BYTES + 800_000


def test_archives_by_expressions_are_those_of_the_format(spark):
    names = ["a.o", "", "x" * 14, "y" * 15, "z" * 16, "z" * 16, "ü" * 8, "member_with_a_long_name.o", "\U0001f600.o", "last.o"]
    members = [(g, k, n, bytes([65 + k]) * (k * k % 7)) for g in (1, 2, None) for k, n in enumerate(names) if g != 2 or k < 3]
    members += [(1, 4, "z" * 16, b"again"), (3, 0, "only_this_one_in_its_archive", b""), (1, 30, "long_at_the_end_of_all", b"y" * 70_000)]
    df = spark.createDataFrame(members, "lib int, k int, name string, content binary").repartition(3)
    built = objects.archive_as(df, "lib", "k", "name")
    assert "MapInArrow" not in built._jdf.queryExecution().toString()
    want = {}
    for g in (1, 2, 3, None):
        own = sorted((k, n, c) for h, k, n, c in members if h == g)
        want[None if g is None else str(g)] = formats.archive([(n, c) for _, n, c in own])
    assert {r.path: bytes(r.content) for r in built.collect()} == want
    assert {r.path: bytes(r.content) for r in objects.archive_of(df, "lib", "k", "name").collect()} == want
    same = objects.archive_as(df.where("lib = 2"), "k", "k", "name")
    assert {r.path: bytes(r.content) for r in same.collect()} == {str(k): formats.archive([(n, c)]) for g, k, n, c in members if g == 2}
    for bad in ("name", "content"):
        with pytest.raises(Exception, match=f"archive member without {bad}"):
            objects.archive_as(df.withColumn(bad, F.lit(None).cast(df.schema[bad].dataType)), "lib", "k", "name").collect()


def test_made_archives_stay_in_the_jvm(spark):
    """A task of these queries has one step in Python, that which parses."""
    from quarry import queries

    for made in (queries._archives, queries._mixed_files):
        assert "MapInArrow" not in made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_files_of_no_known_format_stay_behind(spark, monkeypatch):
    known = [formats.elf_object("/a.bc" * 900), formats.macho_object("/b.bc" * 900), formats.archive([("c.o", formats.elf_object("/c.bc" * 900))])]
    other = [b"z" * 9000, b"!<arch>" + b"z" * 9000, b"\x7fEL", b"", None]
    df = spark.createDataFrame([(str(k), c) for k, c in enumerate(known + other)], "path string, content binary")
    ((frame, _),) = sent_to_python(monkeypatch, df, objects.section_texts)
    sent = {r.path: r.content for r in frame.collect()}
    assert [sent[str(k)] for k in range(3)] == known and max(len(sent[str(k)] or b"") for k in range(3, 8)) == 8
    found = {r.path: (r.text, r.error) for r in objects.section_texts(df).collect()}
    assert [found[str(k)] for k in range(3)] == [(f"/{c}.bc" * 900, None) for c in "abc"]
    assert [found[str(k)] for k in range(3, 8)] == [(None, "unsupported file format")] * 5
    refused = {r.path: r.error for r in objects.archive_members(df).collect()}
    assert refused["2"] is None and [refused[str(k)] for k in (0, 1, 3, 4, 5, 6, 7)] == ["not an archive"] * 7
    assert {r.error for r in objects.section_table(df).where("path > '1'").collect()} == {"unsupported file format"}
