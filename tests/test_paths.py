from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import section_lines, trim_white_space
from quarry.operators.extract import distinct_paths, number_paths, pick_version, sorted_paths_per_object


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "p string")
    return tuple(df.select(*(e.alias(f"c{k}") for k, e in enumerate(exprs))).first())


def test_derived_paths_of_a_source(spark):
    p = F.col("p")
    assert one(spark, "/tmp/foo.c", P.object_path(p, F.lit(False)), P.bitcode_path(p)) == ("/tmp/.foo.o", "/tmp/.foo.o.bc")
    assert one(spark, "/tmp/foo.c", P.object_path(p, F.lit(True)), P.bitcode_path(p)) == ("/tmp/foo.c.o", "/tmp/.foo.o.bc")


def test_relative_source_has_no_artifacts(spark):
    p = F.col("p")
    assert one(spark, "foo.c", P.object_path(p, F.lit(False)), P.bitcode_path(p)) == (None, None)


def test_paths_below_a_working_directory(spark):
    df = spark.createDataFrame([("a.c", "/w"), ("../../../a", "/w/x"), ("/a/./b//c/..", None), ("./", "/w/"), ("a", None), ("a", "rel"), (None, "/w")], "p string, d string")
    got = [r.x for r in df.select(P.absolute(F.col("p"), F.col("d")).alias("x")).collect()]
    assert got == ["/w/a.c", "/a", "/a/b", "/w", None, None, None]


def test_lines_of_one_text_take_about_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("\n".join(f"/d{k % 97}/f{k * 7919 % n}" for k in range(n)),)], "text string")
        began = time.perf_counter()
        assert len(sorted_paths_per_object(df).first()["paths"]) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16000) < 4 + 6 * seconds(4000)


def test_names_stems_and_extensions(spark):
    p = F.col("p")
    cases = {
        "/a/b.tar.gz": ("b.tar.gz", "b.tar", "gz", "/a"),
        "/a/.hidden": (".hidden", ".hidden", None, "/a"),
        "/a/name.": ("name.", "name", "", "/a"),
        "/a//b/./c": ("c", "c", None, "/a/b"),
        "/": (None, None, None, "/"),
        "/a/..": (None, None, None, "/a"),
    }
    for value, want in cases.items():
        assert one(spark, value, P.file_name(p), P.file_stem(p), P.extension(p), P.parent(p)) == want, value


def test_bitcode_source_is_used_itself_and_store_has_hash(spark):
    p = F.col("p")
    assert one(spark, "/a/m.bc", P.used_bitcode(p, P.bitcode_path(p))) == ("/a/m.bc",)
    stored, h = one(spark, "/a/m.c", P.bitcode_path(p, F.lit("/store")), P.path_hash(p))
    assert stored == f"/store/.m.o_{h}.bc"


def test_component_order_and_equality(spark):
    text = "/a-b/c\n/a/b\n/a//b\n../x\n./x\n/\nx\n/a/./b\n/a/b/"
    got = sorted_paths_per_object(spark.createDataFrame([(text,)], "text string")).first()["paths"]
    assert got == ["/", "/a/b", "/a-b/c", "./x", "../x", "x"]


def test_blank_and_odd_section_texts(spark):
    p = F.col("p")
    assert one(spark, "", section_lines(p)) == ([""],)
    assert one(spark, " \n　", section_lines(p)) == ([""],)
    assert one(spark, "\xa0a\r\n\n b \n", section_lines(p)) == (["a\r", "", " b"],)
    assert one(spark, None, section_lines(p)) == (None,)
    assert one(spark, " x ", trim_white_space(p)) == ("x",)


def test_distinct_across_objects_keeps_first_spelling(spark):
    df = spark.createDataFrame([("g", 1, "/b\n/a//x"), ("g", 2, "/a/x\n/b/"), ("h", 1, "/c")], "g string, o int, text string")
    got = number_paths(distinct_paths(df, ["g"], ["o"]), ["g"]).select("g", "pos", "path").collect()
    assert sorted(map(tuple, got)) == [("g", 0, "/a//x"), ("g", 1, "/b"), ("h", 0, "/c")]


def test_numbers_of_a_group_in_several_ranges(spark):
    rows = [("g", 1, "\n".join(f"/d{k * 7919 % 1000:03d}" for k in range(1000))), (None, 2, "/b\n/a"), ("h", 3, "/c")]
    found = distinct_paths(spark.createDataFrame(rows, "g string, o int, text string"), ["g"], ["o"])
    got = number_paths(found, ["g"], 5)
    assert got.columns == [*found.columns, "pos"]
    got = sorted((r.g or "", r.pos, r.path) for r in got.collect())
    assert got == [("", 0, "/a"), ("", 1, "/b"), *(("g", k, f"/d{k:03d}") for k in range(1000)), ("h", 0, "/c")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, o int, text string")
    assert distinct_paths(df, ["g"], ["o"]).count() == 0
    assert number_paths(distinct_paths(df, ["g"], ["o"]), ["g"]).count() == 0
    assert sorted_paths_per_object(df).count() == 0


def test_pick_version(spark):
    df = spark.createDataFrame([("a", 40), ("b", 33), ("c", 7), ("d", 2)], "name string, version int")
    assert tuple(pick_version(df, "name", "version", 33, 6).first()) == ("b", 33)
