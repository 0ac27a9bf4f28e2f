import shutil
import subprocess

import pytest

from quarry.plans import tools as T
from quarry.plans.rules import TOOL_NAMES
from quarry.sources import formats, objects


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_where_tools_are_looked_for(spark):
    folders = ["/a", "/b/"]

    def found(*paths, **how):
        return tuple(T.find_tool(listing(spark, *paths), folders, **how).first())

    assert found("/b/llvm-config", "/a/llvm-config-20", "/c/llvm-config") == ("/b/llvm-config", "plain")
    assert found("/b/llvm-config", "/a/llvm-config") == ("/a/llvm-config", "plain")
    assert found("/a/llvm-config-9", "/b/llvm-config-10", "/a/llvm-config-34") == ("/b/llvm-config-10", "versioned")
    assert found("/a/llvm-config-10", "/b/llvm-config-10") == ("/a/llvm-config-10", "versioned")
    assert found("/a/llvm-config", named="/x/config") == ("/x/config", "named")
    assert found("/a/other") == (None, None) and found() == (None, None)


def test_options_follow_from_a_folder(spark):
    every = listing(spark, *(f"/t/{name}" for name in TOOL_NAMES), "/t/other", "/t/clang")
    options = T.options_from(T.tools_in(every, "/t/"))
    assert options.compiler == {"Clang": "/t/clang", "ClangXX": "/t/clang++"} and options.archiver == "/t/llvm-ar" and options.linker == "/t/llvm-link"
    with pytest.raises(FileNotFoundError, match="/t/llvm-objcopy"):
        T.options_from(T.tools_in(every.where("path not like '%objcopy'"), "/t"))


def test_running_commands(spark, tmp_path):
    there = str(tmp_path)
    rows = [
        (1, ["echo", " two  words  "], None),
        (2, ["sh", "-c", "echo out; echo err >&2; exit 3"], None),
        (3, ["sh", "-c", "kill -9 $$"], None),
        (4, ["printf", r"\377"], None),
        (5, ["/no/such/program"], None),
        (6, [], None),
        (7, None, None),
        (8, ["echo", None], None),
        (9, ["pwd"], there),
        (10, ["pwd"], "/no/such/folder"),
        (11, ["sleep", "30"], None),
        (12, ["cat"], None),
    ]
    plans = spark.createDataFrame(rows, "k int, args array<string>, cwd string")
    got = {r.k: (r.status, r.stdout, r.stderr, r.run_error) for r in T.run_commands(plans, cwd="cwd", seconds=3).collect()}
    missing = "No such file or directory"
    assert got == {
        1: (0, "two  words", "", None),
        2: (3, "out", "err", None),
        3: (-9, "", "", None),
        4: (0, None, None, "output is not UTF-8"),
        5: (None, None, None, missing),
        6: (None, None, None, "no arguments"),
        7: (None, None, None, "no arguments"),
        8: (None, None, None, "null argument"),
        9: (0, there, "", None),
        10: (None, None, None, missing),
        11: (None, None, None, "took too long"),
        12: (0, "", "", None),
    }
    assert T.run_commands(plans.limit(0)).count() == 0


@pytest.mark.skipif(not shutil.which("as"), reason="needs an assembler")
def test_symbols_and_relocations(spark, tmp_path):
    source = ".text\n.globl first\nfirst:\n  call outer\n  call outer\n.size first, .-first\n.data\nword:\n  .quad first+24\n"
    (tmp_path / "unit.o").write_bytes(b"")
    subprocess.run(["as", "-o", str(tmp_path / "unit.o"), "-"], input=source.encode(), check=True)
    (tmp_path / "text.o").write_text("text")
    files = objects.read_files(spark, str(tmp_path), "*.o")
    symbols = objects.symbol_table(files).collect()
    own = {r.name: (r.value, r.size, r.section) for r in symbols if r.name}
    assert own == {"first": (0, 10, ".text"), "word": (0, 0, ".data"), "outer": (0, 0, None)}
    assert [r.error for r in symbols if r.path.endswith("text.o")] == ["unsupported file format"]
    name = {r.symbol_pos: r.name for r in symbols if r.error is None}
    moved = [(r.section, r.offset, name[r.symbol_pos], r.addend) for r in objects.relocation_table(files).where("error is null").collect()]
    assert sorted(moved) == [(".data", 0, "first", 24), (".text", 1, "outer", -4), (".text", 6, "outer", -4)]


def test_macho_symbols_and_relocations():
    import struct

    plain = formats.macho_object("01234567")
    strings = b"\0_first\0_outer\0"
    nlist = struct.pack("<IBBHQ", 1, 0x0F, 1, 0, 4) + struct.pack("<IBBHQ", 8, 0x01, 0, 0, 0)
    relocations = struct.pack("<II", 2, 1 | 1 << 27 | 2 << 28) + struct.pack("<II", 6, 1 | 5 << 28)
    # the new load command goes behind the segment, whose section then lies further on
    head = 32 + 152
    body = plain[head:]
    place = head + 24 + len(body)
    data = bytearray(plain[:head] + struct.pack("<6I", 2, 24, place, 2, place + 32, len(strings)) + body + nlist + strings + relocations)
    struct.pack_into("<II", data, 16, 2, 152 + 24)
    section = 32 + 72
    struct.pack_into("<I", data, section + 48, head + 24)
    struct.pack_into("<II", data, section + 56, place + 32 + len(strings), 2)
    assert list(formats.sections(bytes(data))) == [("__llvm_bc", b"01234567")]
    assert list(formats.symbols(bytes(data))) == [("_first", 4, None, "__llvm_bc"), ("_outer", 0, None, None)]
    assert list(formats.relocations(bytes(data))) == [("__llvm_bc", 2, 2, 1, None), ("__llvm_bc", 6, 5, -1, None)]
