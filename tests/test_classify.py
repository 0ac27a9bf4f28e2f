import pytest

from quarry.operators import classify as C
from quarry.plans import commands as K
from quarry.plans.rules import EXACT_RULES, LOG_LEVELS, PATTERNS

COMPILE = "-pthread -O2 -Wall -std=c11 -DNAME=value -Iinclude -fPIC -c {} -o out/unit.o src/unit.c"
#: A link line and, worked out by hand from the rule table, where its tokens go.
LINK = "-Wl,--as-needed -fuse-ld=lld -flto -m64 -rdynamic -o bin/app -L/opt/lib -Wl,--start-group one.o libtwo.a -Wl,--end-group main.o -lm -pthread"
LINK_ARGS = ["-Wl,--as-needed", "-fuse-ld=lld", "-m64", "-rdynamic", "-L/opt/lib", "-Wl,--start-group", "one.o", "libtwo.a", "-Wl,--end-group", "main.o", "-lm", "-pthread"]


def parse(spark, line, objects=None):
    df = spark.createDataFrame([(1, line.split(), "Clang")], "cmd_id long, tokens array<string>, compiler_kind string")
    return C.parsed(C.with_actions(df, objects))


def test_rule_counts():
    assert len(EXACT_RULES) == 159 and len(PATTERNS) == 36


@pytest.mark.parametrize("flag", ["-flto", "-flto=thin"])
def test_lto(spark, flag):
    row = parse(spark, COMPILE.format(flag)).first()
    assert row.is_lto and row.is_compile_only and row.output_filename == "out/unit.o" and row.input_files == ["src/unit.c"]
    assert flag not in row.compile_args + row.link_args


def test_link_arguments(spark):
    row = parse(spark, LINK).first()
    assert row.link_args == LINK_ARGS and row.object_files == ["main.o"] and row.output_filename == "bin/app" and row.is_lto
    row = parse(spark, "a.c b.c -Wl,--start-group x.o y.c z.o -Wl,--end-group c.c").first()
    assert row.link_args == ["-Wl,--start-group", "x.o", "y.c", "z.o", "-Wl,--end-group"] and row.input_files == ["a.c", "b.c", "c.c"] and row.object_files == []


def test_unterminated_group_is_a_compile_argument(spark):
    row = parse(spark, "-Wl,--start-group a.o b.c").first()
    assert row.compile_args == ["-Wl,--start-group"] and row.link_args == ["a.o"] and row.input_files == ["b.c"]


def test_parameters_are_not_classified(spark):
    row = parse(spark, "-o -c -I -o -MF x.c y.c").first()
    assert row.output_filename == "-c" and row.compile_args == ["-I", "-o", "-MF", "x.c"] and row.input_files == ["y.c"]
    assert row.is_dependency_only and not row.is_compile_only


def test_kept_quirks(spark):
    row = parse(spark, "-P x -isystemX -isystem y -v -foo.c libz.so.10 libz.so.1.2 -o a -o b").first()
    assert row.compile_args == ["-P", "-isystemX", "-isystem", "y", "-foo.c", "libz.so.10"]
    assert row.link_args == ["-isystemX", "libz.so.1.2"]
    assert row.is_compile_only and not row.is_verbose and row.output_filename == "b"


def test_errors_are_rows(spark):
    assert parse(spark, "a.c -o").first().error == "missing parameter"
    assert parse(spark, "").first().error == "no arguments"
    files = spark.createDataFrame([("x.m", "unparsable"), ("y.q", "object")], "path string, kind string")
    row = parse(spark, "x.m y.q z.r", files).first()
    assert row.error == "unparsable file" and row.object_files == ["y.q"] and row.link_args == ["y.q"] and row.compile_args == ["z.r"]


def test_last_reason_counts_and_mode(spark):
    def said(line, **kw):
        return tuple(parse(spark, line).select(C.skip_reason(**kw), C.compile_mode()).first())

    assert said("a.c -c") == (None, "Compiling")
    assert said("a.c -E -") == ("we are in print-only mode, so cannot embed the path of the bitcode", "Compiling")
    assert said("x.o -flto") == ("the compiler will generate bitcode during the link-time optimization", "LTO")
    assert said("x.o -lz") == ("the list of input files is empty", "Linking")
    assert said("a.c -M -c") == (None, "Compiling")
    assert said("a.c", configure_only=True)[0] == "we are in configure-only mode"


def test_plan_steps(spark):
    options = K.Options(bitcode_flags=["-g0"], lto_flags=["-plugin"])
    rows = K.command_plan(parse(spark, "/s/a.c /s/m.bc -dead_strip -O2 -lz -o app"), options).orderBy("step").collect()
    assert [r.kind for r in rows] == ["build", "object", "bitcode", "embed", "object", "embed", "link"]
    assert rows[0].args == ["clang", "/s/a.c", "/s/m.bc", "-O2", "-lz", "-o", "app"]
    assert rows[1].args == ["clang", "-O2", "-c", "-o", "/s/.a.o", "/s/a.c"]
    assert rows[2].args == ["clang", "-O2", "-g0", "-emit-llvm", "-c", "-o", "/s/.a.o.bc", "/s/a.c"]
    assert rows[5].args == ["/s/m.bc", "/s/.m.o"]
    assert rows[6].args == ["clang", "-lz", "-o", "app", "/s/.a.o", "/s/.m.o"]


def test_compiling_only_and_skipped_plans_are_short(spark):
    only = K.command_plan(parse(spark, "/s/a.c -c -o a.o"), K.Options()).orderBy("step").collect()
    assert [r.kind for r in only] == ["build", "bitcode", "embed"]
    assert [r.kind for r in K.command_plan(parse(spark, "/s/a.c -E"), K.Options()).collect()] == ["build"]
    lto = K.command_plan(parse(spark, "x.o -flto -lz"), K.Options(lto_flags=["-plugin"])).first()
    assert lto.args == ["clang", "-plugin", "x.o", "-flto", "-lz"]


def test_relative_sources(spark):
    df = spark.createDataFrame([(1, "src/a.c ../b.bc /x/./c.c -O2 -o app".split(), "Clang", "/w/p")], "cmd_id long, tokens array<string>, compiler_kind string, cwd string")
    done = C.parsed(C.with_actions(df))
    rows = {r.kind + str(r.step): r.args for r in K.command_plan(done, K.Options()).collect()}
    assert rows["object1"] == ["clang", "-O2", "-c", "-o", "/w/p/src/.a.o", "/w/p/src/a.c"]
    assert rows["embed3"] == ["/w/p/src/.a.o.bc", "/w/p/src/.a.o"] and rows["embed5"] == ["/w/b.bc", "/w/.b.o"]
    assert rows["link9"] == ["clang", "-o", "/w/p/app", "/w/p/src/.a.o", "/w/.b.o", "/x/.c.o"]
    assert [(r.src_path, r.error) for r in K.artifacts(done, K.Options()).orderBy("pos").collect()] == [("/w/p/src/a.c", None), ("/w/b.bc", None), ("/x/c.c", None)]
    plan = K.command_plan(parse(spark, "src/a.c /x.c -o app"), K.Options()).orderBy("step").collect()
    assert [(r.kind, r.args) for r in plan[1:]] == [("error", ["source path is not absolute", "src/a.c"])]
    lost = K.artifacts(parse(spark, "src/a.c"), K.Options()).first()
    assert (lost.src_path, lost.object_path, lost.error) == ("src/a.c", None, "source path is not absolute")


def test_repeated_commands_find_their_files(spark):
    df = spark.createDataFrame([(1, ["x.m", "y.q"], "Clang")] * 3 + [(None, ["y.q"], "Clang")], "cmd_id long, tokens array<string>, compiler_kind string")
    files = spark.createDataFrame([("y.q", "object"), ("y.q", "object")], "path string, kind string")
    rows = C.parsed(C.with_actions(df, files)).collect()
    assert len(rows) == 4 and all(r.object_files == ["y.q"] for r in rows)


def test_options_from_a_table():
    text = 'clang_filepath = "/b/clang"\nllvm_link_flags = ["-v"]\nbitcode_store_path = "rel"\nis_configure_only = true\nlog_level = 200\nllvm_config_filepath = "/b/c"'
    o = K.Options.from_toml(text)
    assert o.compiler == {"Clang": "/b/clang", "ClangXX": "clang++"} and o.merge_flags == ["-v"] and o.store is None and o.configure_only and o.log_name == LOG_LEVELS[-1]
    assert K.Options.from_toml("") == K.Options() and K.Options.from_toml('bitcode_store_path = "/s"').store == "/s"
    for bad in ("x = 1", "log_level = true", "lto_ldflags = [1]", "log_level = 300"):
        with pytest.raises(ValueError):
            K.Options.from_toml(bad)


def test_options():
    assert K.Options(log_level=0).log_name == LOG_LEVELS[0] and K.Options(log_level=99).log_name == LOG_LEVELS[-1]
    with pytest.raises(ValueError):
        K.Options(store="relative")


def test_quick_rules_are_the_plain_ones(spark):
    """Length and beginning only save work: every token gets the rule of the plain search."""
    import re

    from pyspark.sql import functions as F

    from quarry.plans.rules import literal_start, rule_of

    assert [literal_start(p) for p in ("^-MF.*$", "^-(l|L).+$", "^-W[l][^,].*$", "^-mmacosx-version-min=.+$", r"^.+\.(c|cc)$", "^ab?$")] == ["-MF", "-", "-W", "-mmacosx-version-min=", "", "a"]
    tails = ["", "x", "=1", ".c", "a.o", ".so.1", ",x", "\n", "\nx.c"]
    tokens = {*EXACT_RULES, "", "-", "--", "ü.c", ".c", "x.dylib.1.2", "x.F90", "a\n.c", "-Wl,--start-group", "rel/h", "@f.rsp"}
    tokens |= {literal_start(p) + t for p, _ in PATTERNS for t in tails} | {f + "x" for f in EXACT_RULES}
    rows = spark.createDataFrame([(t,) for t in sorted(tokens)], "t string").withColumn("r", F.transform(F.array("t"), rule_of)[0]).collect()

    def plain(t):
        by = (h for p, h in PATTERNS if re.match(p[:-1].replace("(", "(?:") + r"\Z" if p.endswith("$") else p, t))
        return EXACT_RULES.get(t) or ("group" if t == "-Wl,--start-group" else next(by, None), 0)

    assert {r.t: tuple(r.r) for r in rows} == {t: plain(t) for t in tokens}


@pytest.mark.parametrize("cwd", [True, False])
def test_plans_are_worked_out_once(spark, cwd):
    """Nothing that exploding implies works out a plan or its sources again."""
    df = spark.createDataFrame([(1, ["/s/a.c", "-o", "b"], "Clang", "/w")], "cmd_id long, tokens array<string>, compiler_kind string, cwd string")
    plan = K.command_plan(C.parsed(C.with_actions(df if cwd else df.drop("cwd"))), K.Options())
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("-emit-llvm, -c, -o") == 1 and optimized.count("source path is not absolute") == 1
    assert [r.kind for r in plan.orderBy("step").collect()] == ["build", "object", "bitcode", "embed", "link"]
