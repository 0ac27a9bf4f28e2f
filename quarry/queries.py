"""Registered queries of the build-record operators and their SQL.

The driver's tables hold no build records, so the queries make some from them,
the same way in both engines: commands from `lineitem` (each row picks two
tokens from a pool), source paths from `part`, section texts from `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import WHITE_SPACE
from quarry.operators import classify as C
from quarry.operators import extract as X
from quarry.plans import commands as K
from quarry.plans import tools as T
from quarry.plans.extraction import extract
from quarry.plans.rules import EXACT_RULES, GROUP_END, GROUP_START, PATTERNS, SKIP_REASONS, TOOL_VERSIONS
from quarry.sources import manifest, objects

#: Tokens that commands are made of: every handler, and what separates the rules.
POOL = (
    "-c -c -o -o /out/app /out/lib.so -E -S -M -MF -MFdep -MD -Wall -Wlocal -w -g -O2 -flto -flto=thin -emit-llvm - --verbose -v "
    "/src/a.c /src/b.cc /src/c.cpp /src/dir/d.c /src/e.s /src/f.S /src/mod.bc /src/g.f90 /dev/null -foo.c /lib/x.o /lib/y.a libz.so.1.2 libz.so.10 libq.dylib.1 "
    "-I -I/inc -D -DX=1 -U -isystem -isystemX --sysroot --sysroot=/r -x -Xclang -Xlinker --param -P -C -L -L/lib -lz -rpath -shared -pthread -m64 -fopenmp "
    "rel/h.c ../up/i.cc ./j.c -fsanitize=cfi -fuse-ld=lld -stdlib=libc++ -std=c11 -dead_strip -Wl,-dead_strip -Wl,-O1 -print-multi-lib -dynamiclib notes.txt @args.rsp "
    f"{GROUP_START} {GROUP_START} {GROUP_END} {GROUP_END}"
).split()
OPTIONS = K.Options(lto_flags=["-Wl,-plugin"], bitcode_flags=["-Xclang", "-disable-O0-optnone"], store="/store")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cmd_id, tokens, compiler_kind, cwd."""
    li = _table(spark, sf_dir, "lineitem")
    pool, n = F.array(*map(F.lit, POOL)), len(POOL)
    one = F.get(pool, ((F.col("l_partkey") * 31 + F.col("l_linenumber") * 7) % n).cast("int"))
    two = F.get(pool, ((F.col("l_suppkey") * 17 + F.col("l_partkey")) % n).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.array(one, two).alias("t"))))
    tokens = F.flatten(F.transform(parts, lambda p: p["t"]))
    kind = F.when(F.col("l_orderkey") % 2 == 0, "Clang").otherwise("ClangXX")
    return li.groupBy("l_orderkey").agg(tokens.alias("tokens")).select(F.col("l_orderkey").alias("cmd_id"), "tokens", kind.alias("compiler_kind"), F.concat(F.lit("/work/p"), F.col("l_orderkey") % 3).alias("cwd"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parsed(C.with_actions(commands(spark, sf_dir)))


def _joined(*names: str) -> list:
    return [F.array_join(c, " ").alias(c) for c in names]


def classify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classified_tokens(C.with_actions(commands(spark, sf_dir)))


def classify_with_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("notes.txt", "object"), ("@args.rsp", "unparsable")], "path string, kind string")
    found = C.with_actions(commands(spark, sf_dir), files)
    return C.parsed(found).select("cmd_id", *_joined("object_files", "link_args"), "error")


_LISTS = ["input_args", "input_files", "object_files", "compile_args", "link_args", "forbidden_flags"]
_FLAGS = ["is_verbose", "is_dependency_only", "is_preprocess_only", "is_assemble_only", "is_assembly", "is_compile_only", "is_emit_llvm", "is_lto", "is_print_only"]


def parse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("cmd_id", *_joined(*_LISTS), "output_filename", *_FLAGS, "error")


def skip_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("cmd_id", C.skip_reason().alias("skip_reason"), C.compile_mode().alias("mode"))


def skip_when_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some commands come from configure runs."""
    return _parsed(spark, sf_dir).select("cmd_id", C.skip_reason(F.col("cmd_id") % 5 == 0).alias("skip_reason"))


def empty_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a.c"))).otherwise(F.array().cast("array<string>"))
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cmd_id"), tokens.alias("tokens"))
    return C.parsed(C.with_actions(df)).select("cmd_id", F.size("input_files").alias("n_inputs"), "error")


def log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", K.log_name(F.col("o_orderkey") % 9 - 1).alias("level"))


def relative_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of commands that have no working directory."""
    return K.command_plan(_parsed(spark, sf_dir).drop("cwd"), OPTIONS).where("kind = 'error'").withColumn("args", F.array_join("args", " "))


def build_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("cmd_id", F.array_join(K.build_command(OPTIONS), " ").alias("args"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.artifacts(_parsed(spark, sf_dir), OPTIONS)


def command_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.command_plan(_parsed(spark, sf_dir), OPTIONS).withColumn("args", F.array_join("args", " "))


def derive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, (".c", ".tar.gz", "", ".bc", "/x/../y.cc", ".")))
    src = F.concat(F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("//./"), F.replace("p_name", F.lit(" "), F.lit("_")), F.get(endings, F.col("p_size") % 6))
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("only"), src.alias("src"))
    src, code = F.col("src"), P.bitcode_path(F.col("src"))
    return p.select(
        "p_partkey",
        P.file_stem(src).alias("stem"),
        P.extension(src).alias("extension"),
        P.object_path(src, F.col("only")).alias("object_path"),
        code.alias("bitcode_path"),
        P.used_bitcode(src, code).alias("used_path"),
        P.path_hash(src).alias("path_hash"),
        P.output_name(src, F.when(F.col("only"), "archive").otherwise("object"), F.col("p_partkey") % 3 == 0).alias("output_name"),
        F.array_join(P.component_key(src), "/").alias("component_key"),
    )


def _path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", F.replace("text", F.lit(" "), F.lit("/")).alias("text"))


def extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.sorted_paths_per_object(docs).select("doc_id", F.posexplode("paths").alias("pos", "path"))


def extract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sorted_paths_per_object(_path_texts(spark, sf_dir)).select("doc_id", F.posexplode("paths").alias("pos", "path"))


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.distinct_paths(_path_texts(spark, sf_dir), ["source"], ["doc_id"])
    return found.select("source", "path", F.array_join("component_key", "/").alias("component_key"))


def _object_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/obj/"), F.col("doc_id"), F.lit(".o")).alias("path"), "doc_id", "text")
    return objects.embed(docs)


def object_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = objects.section_texts(_object_files(spark, sf_dir))
    return X.sorted_paths_per_object(texts).select("path", F.posexplode("paths").alias("pos", "line"))


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of both formats, archives of one object each, and pages."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    elf = objects.embed(docs.where("doc_id % 3 <> 1")).select("doc_id", "content")
    macho = objects.embed_macho(docs.where("doc_id % 3 = 1")).select("doc_id", "content")
    packed = elf.where("doc_id % 3 = 2").withColumn("name", F.concat(F.lit("member_of_"), F.col("doc_id"), F.lit(".o")))
    packed = objects.archive_as(packed, "doc_id", "doc_id", "name").select(F.col("path").alias("doc_id"), "content")
    made = elf.where("doc_id % 3 = 0").unionByName(macho).unionByName(packed).select(F.concat(F.lit("/in/"), "doc_id", F.lit(".x")).alias("path"), "content")
    pages = _table(spark, sf_dir, "pages").select(F.concat(F.lit("/page/"), F.col("page_id"), F.lit(".x")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return made.unionByName(pages)


def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(_mixed_files(spark, sf_dir), OPTIONS, archive=True, manifest=True)
    return found.select("path", "format", "output", F.array_join("args", "\n").alias("args"), "manifest_path", "manifest", "error")


def sections_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section is added to objects that have one already."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/obj/"), F.col("doc_id"), F.lit(".o")).alias("path"), F.concat(F.lit("/code/"), F.col("doc_id"), F.lit(".bc")).alias("line"), "text")
    first = objects.embed_as(docs, "text", ".notes").drop("text")
    added = objects.embed(first, "line")
    own = objects.section_table(added).select("path", "section_pos", "name", F.when(F.col("name") != ".shstrtab", F.col("size")).alias("size"))
    return own.join(objects.section_texts(added).select("path", "text"), "path")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _object_files(spark, sf_dir).select("path", "content")
    bad = _table(spark, sf_dir, "pages").select(F.concat(F.lit("/page/"), F.col("page_id")).alias("path"), F.encode("html", "utf-8").alias("content"))
    files = made.unionByName(bad)
    return files.select("path", objects.file_kind().alias("format")).join(objects.object_kinds(files), "path")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _object_files(spark, sf_dir).withColumn("lib", F.floor(F.col("doc_id") / 16))
    return objects.archive_as(own.withColumn("name", F.concat(F.lit("object_number_"), F.col("doc_id"), F.lit(".o"))), "lib", "doc_id", "name")


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _archives(spark, sf_dir)
    listed = objects.archive_members(files).select("path", "member_pos", "member_name", (F.col("member_bytes") > 0).alias("filled"))
    texts = objects.section_texts(files).select("path", "member_pos", F.sha2("text", 256).alias("text_sha256"))
    return listed.join(texts, ["path", "member_pos"])


def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = objects.section_texts(_archives(spark, sf_dir))
    found = X.distinct_paths(texts.withColumnRenamed("path", "archive"), ["archive"], ["member_pos"])
    return X.number_paths(found, ["archive"]).select("archive", "pos", "path")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.sorted_paths_per_object(_table(spark, sf_dir, "documents")).withColumn("path", F.concat(F.lit("/obj/"), F.col("doc_id"), F.lit(".o")))
    return manifest.manifests(found.withColumn("output", P.output_name(F.col("path"), F.lit("object"), F.lit(False))))


def pick_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = _table(spark, sf_dir, "part").select(F.concat(F.lit("tool-"), F.col("p_size")).alias("name"), F.col("p_size").alias("version"))
    return X.pick_version(tools, "name", "version", *TOOL_VERSIONS)


def pick_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "part").select(F.concat(F.lit("/opt/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.col("p_size"), F.lit("/bin/tool")).alias("path"))
    return X.pick_last(found, "path")


def find_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing: each part's size as a version, in folders by brand."""
    listed = F.concat(F.lit("/opt/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/llvm-config-"), F.col("p_size"))
    return T.find_tool(_table(spark, sf_dir, "part").select(listed.alias("path")), ["/opt/brand-35", "/opt/brand-21", "/opt/brand-12"])


def run_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that echo nations, one program that doesn't exist, one that fails."""
    program = F.when(F.col("n_nationkey") == 3, "/no/such/program").when(F.col("n_nationkey") == 4, "false").otherwise("echo")
    plans = _table(spark, sf_dir, "nation").select("n_nationkey", F.array(program, F.lit("nation"), "n_name").alias("args"))
    return T.run_commands(plans).drop("args")


QUERIES = {
    f.__name__: f
    for f in (
        classify_tokens, classify_with_objects, parse_commands, skip_and_mode, build_commands, artifacts, command_plans, derive_paths,
        extract_lines, extract_paths, distinct_paths, object_sections, file_kinds, archive_members, archive_paths, manifests, pick_tool,
        pick_last, skip_when_configured, empty_commands, log_names, relative_plans, extract_files, sections_added,
        find_tool, run_commands,
    )
}

# --------------------------------------------------------------------- their SQL


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_N = len(POOL)
#: act: the tokens that act, found by following how many tokens each uses up.
_ACT = f"""
WITH RECURSIVE pool(i, t) AS (VALUES {_values(list(enumerate(POOL)))}),
exact_rule(t, handler, arity) AS (VALUES {_values([(t, *r) for t, r in EXACT_RULES.items()])}),
pattern(k, re, handler) AS (VALUES {_values([(k, *p) for k, p in enumerate(PATTERNS)])}),
by_pattern AS (SELECT p.t, arg_min(handler, k) AS handler FROM (SELECT DISTINCT t FROM pool) p JOIN pattern ON regexp_matches(p.t, re) GROUP BY p.t),
rule AS (
  SELECT p.t, CASE WHEN e.t IS NOT NULL THEN e.handler WHEN p.t = '{GROUP_START}' THEN 'group' ELSE b.handler END AS handler, coalesce(e.arity, 0) AS arity
  FROM (SELECT DISTINCT t FROM pool) p LEFT JOIN exact_rule e ON e.t = p.t LEFT JOIN by_pattern b ON b.t = p.t
), item AS (SELECT *, row_number() OVER () AS r FROM lineitem), picked AS (
  SELECT l_orderkey AS cmd_id, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, r, 1 AS d, (l_partkey * 31 + l_linenumber * 7) % {_N} AS i FROM item
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r, 2, (l_suppkey * 17 + l_partkey) % {_N} FROM item
), tok AS (
  SELECT cmd_id, CAST(row_number() OVER w AS INTEGER) AS pos, t, count(*) OVER (PARTITION BY cmd_id) AS n
  FROM picked JOIN pool USING (i) WINDOW w AS (PARTITION BY cmd_id ORDER BY a, b, c, r, d)
), list AS (SELECT cmd_id, list(t ORDER BY pos) AS tokens FROM tok GROUP BY cmd_id),
info AS (
  SELECT s.*, CASE WHEN handler = 'group' THEN CASE WHEN stop IS NULL THEN 'compile_unary' ELSE 'linker_group' END
                   WHEN arity = 1 AND pos = n THEN 'missing_parameter' ELSE coalesce(handler, 'compile_unary') END AS does,
         CASE WHEN handler = 'group' AND stop IS NOT NULL THEN stop - pos + 1 WHEN arity = 1 AND pos < n THEN 2 ELSE 1 END AS used,
         handler IS NULL AS unmatched
  FROM (SELECT tok.*, rule.handler, rule.arity,
               min(CASE WHEN tok.t = '{GROUP_END}' THEN pos END) OVER (PARTITION BY cmd_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop
        FROM tok JOIN rule USING (t)) s
), reach AS (
  SELECT cmd_id, 1 AS pos FROM list UNION ALL
  SELECT r.cmd_id, CAST(r.pos + i.used AS INTEGER) FROM reach r JOIN info i ON i.cmd_id = r.cmd_id AND i.pos = r.pos WHERE r.pos + i.used <= i.n
), act AS (
  SELECT i.cmd_id, i.pos, i.t, i.does, i.used, i.unmatched, array_to_string(list.tokens[i.pos : i.pos + i.used - 1], ' ') AS whole, list.tokens[i.pos + 1] AS next
  FROM reach r JOIN info i ON i.cmd_id = r.cmd_id AND i.pos = r.pos JOIN list ON list.cmd_id = i.cmd_id
)
"""


def _gather(handlers: list[str], what: str = "t") -> str:
    return f"coalesce(string_agg({what}, ' ' ORDER BY pos) FILTER (does IN ({', '.join(map(_text, handlers))})), '')"


def _any(*handlers: str) -> str:
    return f"bool_or(does IN ({', '.join(map(_text, handlers))}))"


_WHOLE = f"CASE WHEN does IN ({', '.join(map(_text, ['linker_group', *C._WITH_PARAMETER]))}) THEN whole ELSE t END"
_FACTS = f"""
, facts AS (
  SELECT cmd_id, array_to_string(any_value(tokens), ' ') AS input_args, {_gather(['input_file'])} AS input_files, {_gather(['object_file'])} AS object_files,
         {_gather(C._COMPILE, _WHOLE)} AS compile_args, {_gather(C._LINK, _WHOLE)} AS link_args, {_gather(['warning_link_unary'])} AS forbidden_flags,
         coalesce(arg_max(next, pos) FILTER (does = 'output_file'), '') AS output_filename,
         {_any('verbose')} AS is_verbose, {_any('dependency_only', 'dependency_binary')} AS is_dependency_only, {_any('preprocess_only')} AS is_preprocess_only,
         {_any('assemble_only')} AS is_assemble_only, bool_or(does = 'input_file' AND regexp_matches(t, '\\.(s|S)$')) AS is_assembly,
         {_any('compile_only', 'emit_llvm')} AS is_compile_only, {_any('emit_llvm')} AS is_emit_llvm, {_any('lto')} AS is_lto, {_any('print_only')} AS is_print_only,
         CASE WHEN {_any('missing_parameter')} THEN 'missing parameter' END AS error
  FROM act JOIN list USING (cmd_id) GROUP BY cmd_id
)
"""
_HOLDS = {
    "configure_only": "false", "no_inputs": "input_files = ''", "emit_llvm": "is_emit_llvm", "lto": "is_lto", "assembly": "is_assembly", "assemble_only": "is_assemble_only",
    "dependency_only": "is_dependency_only AND NOT is_compile_only", "preprocess_only": "is_preprocess_only", "print_only": "is_print_only",
}
_SKIP = "CASE " + " ".join(f"WHEN {_HOLDS[k]} THEN {_text(v)}" for k, v in reversed(SKIP_REASONS)) + " END"
_MODE = "CASE WHEN input_files = '' AND link_args <> '' THEN CASE WHEN is_lto THEN 'LTO' ELSE 'Linking' END ELSE 'Compiling' END"
_CC = "CASE WHEN cmd_id % 2 = 0 THEN 'clang' ELSE 'clang++' END"


def _key(path: str) -> str:
    return (
        f"list_filter(list_transform(string_split({path}, '/'), lambda c, i: CASE WHEN c = '' AND i = 1 AND starts_with({path}, '/') THEN '0' "
        f"WHEN c = '.' AND i = 1 THEN '1' WHEN c = '..' THEN '2' WHEN c NOT IN ('', '.') THEN '3' || c END), lambda x: x IS NOT NULL)"
    )


def _lines(text: str, table: str, *columns: str) -> str:
    kept = ", ".join(columns)
    split = f"string_split(trim({text}, {' || '.join(f'chr({ord(c)})' for c in WHITE_SPACE)}), chr(10))"
    return f"SELECT {kept}, i, l[i] AS path FROM (SELECT {kept}, {split} AS l FROM {table}) d, unnest(range(1, len(l) + 1)) u(i)"


def _sorted_lines(text: str, table: str, owner: str, owner_as: str, path_as: str = "path") -> str:
    return f"""
WITH line AS ({_lines(text, table, owner)}), keyed AS (SELECT *, {_key('path')} AS k FROM line),
one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY {owner}, k ORDER BY i) = 1)
SELECT {owner_as}, CAST(row_number() OVER (PARTITION BY {owner} ORDER BY k) - 1 AS INTEGER) AS pos, path AS {path_as} FROM one
"""


_SRC = "'/' || lower(replace(p_type, ' ', '/')) || '//./' || replace(p_name, ' ', '_') || (['.c', '.tar.gz', '', '.bc', '/x/../y.cc', '.'])[p_size % 6 + 1]"
_SPLIT = """
  SELECT *, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS stem FROM (
    SELECT *, parts[-1] AS name, '/' || array_to_string(parts[:-2], '/') AS folder FROM (
      SELECT *, list_filter(string_split(src, '/'), lambda c: c NOT IN ('', '.')) AS parts FROM {0}))
"""
_OBJECT = "folder || '/' || CASE WHEN compiles THEN name || '.o' ELSE '.' || stem || '.o' END"
_STORED = "'/store/.' || stem || '.o_' || sha256(src)[:16] || '.bc'"
#: Where each command's relative sources and outputs are, written out.
_PLACED = "CASE t WHEN 'rel/h.c' THEN '/work/p' || cmd_id % 3 || '/rel/h.c' WHEN '../up/i.cc' THEN '/work/up/i.cc' WHEN './j.c' THEN '/work/p' || cmd_id % 3 || '/j.c' ELSE t END"
_OUTPUT = (
    "CASE WHEN starts_with(output_filename, '/') THEN output_filename WHEN output_filename = '../up/i.cc' THEN '/work/up/i.cc' "
    "ELSE '/work/p' || cmd_id % 3 || '/' || CASE WHEN starts_with(output_filename, './') THEN substr(output_filename, 3) ELSE output_filename END END"
)
_INPUTS = f"""
, own AS (SELECT act.cmd_id, act.pos AS place, {_PLACED} AS src, is_compile_only AS compiles FROM act JOIN facts USING (cmd_id) WHERE does = 'input_file'),
input AS ({_SPLIT.format('own')}), made AS (
  SELECT cmd_id, CAST(row_number() OVER (PARTITION BY cmd_id ORDER BY place) - 1 AS INTEGER) AS pos, src, compiles, {_OBJECT} AS object_path, {_STORED} AS bitcode_path FROM input
)
"""
_BITCODE_FLAGS, _LTO = " ".join(OPTIONS.bitcode_flags), " ".join(OPTIONS.lto_flags)


def _spaced(*parts: str) -> str:
    """Parts with a space between those that aren't empty."""
    return "concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


_BUILD = f"""
, whole AS (
  SELECT facts.cmd_id, list_filter([{_CC}] || CASE WHEN {_MODE} = 'LTO' THEN ['{_LTO}'] ELSE [] END || tokens,
         lambda x: NOT list_contains(string_split(forbidden_flags, ' '), x)) AS args FROM facts JOIN list USING (cmd_id)
)
"""

ORACLE_SQL = {
    "classify_tokens": _ACT + "SELECT cmd_id, pos - 1 AS pos, t AS token, does AS handler, CASE WHEN used = 2 AND does <> 'linker_group' THEN next END AS parameter FROM act",
    "classify_with_objects": _ACT
    + f"""SELECT cmd_id, coalesce(string_agg(t, ' ' ORDER BY pos) FILTER (does = 'object_file' OR unmatched AND t = 'notes.txt'), '') AS object_files,
  coalesce(string_agg({_WHOLE}, ' ' ORDER BY pos) FILTER (does IN ({', '.join(map(_text, C._LINK))}) OR unmatched AND t = 'notes.txt'), '') AS link_args,
  CASE WHEN {_any('missing_parameter')} THEN 'missing parameter' WHEN bool_or(unmatched AND t = '@args.rsp') THEN 'unparsable file' END AS error
  FROM act GROUP BY cmd_id""",
    "parse_commands": _ACT + _FACTS + f"SELECT cmd_id, {', '.join(_LISTS)}, output_filename, {', '.join(_FLAGS)}, error FROM facts",
    "skip_and_mode": _ACT + _FACTS + f"SELECT cmd_id, {_SKIP} AS skip_reason, {_MODE} AS mode FROM facts",
    "build_commands": _ACT + _FACTS + _BUILD + "SELECT cmd_id, array_to_string(args, ' ') AS args FROM whole",
    "artifacts": _ACT + _FACTS + _INPUTS + "SELECT cmd_id, pos, src AS src_path, object_path, bitcode_path, CAST(NULL AS VARCHAR) AS error FROM made",
    "command_plans": _ACT
    + _FACTS
    + _INPUTS
    + _BUILD
    + f""", step AS (
  SELECT cmd_id, -1 AS pos, 0 AS k, 'build' AS kind, array_to_string(args, ' ') AS args FROM whole
  UNION ALL SELECT cmd_id, pos, 1, 'object', {_spaced(_CC, 'compile_args')} || ' -c -o ' || object_path || ' ' || src FROM made JOIN facts USING (cmd_id) WHERE NOT compiles AND {_SKIP} IS NULL
  UNION ALL SELECT cmd_id, pos, 2, 'bitcode', {_spaced(_CC, 'compile_args', _text(_BITCODE_FLAGS))} || ' -emit-llvm -c -o ' || bitcode_path || ' ' || src
    FROM made JOIN facts USING (cmd_id) WHERE NOT regexp_matches(src, '[^/]\\.bc$') AND {_SKIP} IS NULL
  UNION ALL SELECT cmd_id, pos, 3, 'embed', CASE WHEN regexp_matches(src, '[^/]\\.bc$') THEN src ELSE bitcode_path END || ' ' || object_path FROM made JOIN facts USING (cmd_id) WHERE {_SKIP} IS NULL
  UNION ALL SELECT cmd_id, 1000000, 4, 'link', {_spaced(_CC, 'link_args')} || ' -o ' || {_OUTPUT} || ' ' || objects
    FROM facts JOIN (SELECT cmd_id, string_agg(object_path, ' ' ORDER BY pos) AS objects FROM made GROUP BY cmd_id) USING (cmd_id)
    WHERE NOT is_compile_only AND output_filename <> '' AND {_SKIP} IS NULL
)
SELECT step.cmd_id, CAST(row_number() OVER (PARTITION BY step.cmd_id ORDER BY step.pos, k) - 1 AS INTEGER) AS step, kind, args
FROM step JOIN facts USING (cmd_id) WHERE error IS NULL""",
    "skip_when_configured": _ACT + _FACTS + f"SELECT cmd_id, {_SKIP.replace('WHEN false THEN', 'WHEN cmd_id % 5 = 0 THEN')} AS skip_reason FROM facts",
    "empty_commands": "SELECT o_orderkey AS cmd_id, CAST(o_orderkey % 2 = 0 AS INTEGER) AS n_inputs, CASE WHEN o_orderkey % 2 <> 0 THEN 'no arguments' END AS error FROM orders",
    "log_names": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 2 THEN 'error' WHEN o_orderkey % 9 = 2 THEN 'warn' WHEN o_orderkey % 9 = 3 THEN 'info' WHEN o_orderkey % 9 = 4 THEN 'debug' ELSE 'trace' END AS level FROM orders",
    "relative_plans": _ACT
    + _FACTS
    + f"""SELECT act.cmd_id, 1 AS step, 'error' AS kind, 'source path is not absolute ' || string_agg(t, ' ' ORDER BY act.pos) AS args
  FROM act JOIN facts USING (cmd_id) WHERE does = 'input_file' AND NOT starts_with(t, '/') AND {_SKIP} IS NULL AND error IS NULL GROUP BY act.cmd_id""",
    "derive_paths": f"""WITH s AS (SELECT p_partkey, p_size % 2 = 0 AS compiles, {_SRC} AS src FROM part), d AS ({_SPLIT.format('s')})
SELECT p_partkey, stem, CASE WHEN name <> stem THEN substr(name, length(stem) + 2) END AS extension, {_OBJECT} AS object_path,
  folder || '/.' || stem || '.o.bc' AS bitcode_path, CASE WHEN regexp_matches(name, '.\\.bc$') THEN src ELSE folder || '/.' || stem || '.o.bc' END AS used_path,
  sha256(src)[:16] AS path_hash, stem || CASE WHEN NOT compiles THEN '.bc' WHEN p_partkey % 3 = 0 THEN '.bca' ELSE '.a.bc' END AS output_name,
  array_to_string({_key('src')}, '/') AS component_key FROM d""",
    "extract_lines": _sorted_lines("text", "documents", "doc_id", "doc_id"),
    "extract_paths": _sorted_lines("replace(text, ' ', '/')", "documents", "doc_id", "doc_id"),
    "distinct_paths": f"""WITH line AS ({_lines("replace(text, ' ', '/')", 'documents', 'doc_id', 'source')}), keyed AS (SELECT *, {_key('path')} AS k FROM line)
SELECT source, path, array_to_string(k, '/') AS component_key FROM keyed QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY doc_id, i) = 1""",
    "object_sections": _sorted_lines("text", "documents", "doc_id", "'/obj/' || doc_id || '.o' AS path", "line"),
    "file_kinds": """SELECT '/obj/' || doc_id || '.o' AS path, 'elf' AS format, 'object' AS kind FROM documents
UNION ALL SELECT '/page/' || page_id, NULL, 'unparsable' FROM pages""",
    "archive_members": """SELECT CAST(doc_id // 16 AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) - 1 AS INTEGER) AS member_pos,
'object_number_' || doc_id || '.o' AS member_name, true AS filled, sha256(text) AS text_sha256 FROM documents""",
    "archive_paths": f"""WITH line AS ({_lines('text', 'documents', 'doc_id')}), keyed AS (SELECT *, CAST(doc_id // 16 AS VARCHAR) AS archive, {_key('path')} AS k FROM line),
one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY archive, k ORDER BY doc_id, i) = 1)
SELECT archive, CAST(row_number() OVER (PARTITION BY archive ORDER BY k) - 1 AS INTEGER) AS pos, path FROM one""",
    "manifests": f"""WITH line AS ({_lines('text', 'documents', 'doc_id')}), keyed AS (SELECT *, {_key('path')} AS k FROM line),
one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1)
SELECT '/obj/' || doc_id || '.bc.manifest' AS manifest_path, string_agg(path, chr(10) ORDER BY k) AS manifest FROM one GROUP BY doc_id""",
    "extract_files": f"""WITH line AS ({_lines('text', 'documents', 'doc_id')}), keyed AS (SELECT *, {_key('path')} AS k FROM line),
one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1),
said AS (SELECT doc_id, string_agg(path, chr(10) ORDER BY k) AS m FROM one GROUP BY doc_id),
named AS (SELECT *, (['elf', 'macho', 'archive'])[doc_id % 3 + 1] AS format, doc_id || CASE WHEN doc_id % 3 = 2 THEN '.bca' ELSE '.bc' END AS output FROM said)
SELECT '/in/' || doc_id || '.x' AS path, format, output, CASE WHEN format = 'archive' THEN 'llvm-ar' || chr(10) || 'rs' ELSE 'llvm-link' || chr(10) || '-o' END || chr(10) || output || chr(10) || m AS args,
  '/in/' || output || '.manifest' AS manifest_path, m AS manifest, CAST(NULL AS VARCHAR) AS error FROM named
UNION ALL SELECT '/page/' || page_id || '.x', NULL, NULL, NULL, NULL, NULL, 'unsupported file format' FROM pages""",
    "sections_added": """WITH s(k, name) AS (VALUES (0, '.notes'), (1, '.shstrtab'), (2, '.llvm_bc'))
SELECT '/obj/' || doc_id || '.o' AS path, CAST(k AS INTEGER) AS section_pos, name,
  CASE k WHEN 0 THEN octet_length(encode(text)) WHEN 2 THEN length('/code/' || doc_id || '.bc') END AS size, '/code/' || doc_id || '.bc' AS text FROM documents, s""",
    "pick_last": """SELECT '/opt/' || arg_max(brand || '/' || p_size, [brand, CAST(p_size AS VARCHAR)]) || '/bin/tool' AS path
FROM (SELECT lower(replace(p_brand, '#', '-')) AS brand, p_size FROM part)""",
    "find_tool": f"""WITH folder(j, place) AS (VALUES (0, '/opt/brand-35'), (1, '/opt/brand-21'), (2, '/opt/brand-12')),
listed AS (SELECT '/opt/' || lower(replace(p_brand, '#', '-')) AS place, p_size FROM part WHERE p_size BETWEEN {TOOL_VERSIONS[1]} AND {TOOL_VERSIONS[0]})
SELECT arg_max(place || '/llvm-config-' || p_size, 3 * p_size - j) AS path, CASE WHEN count(*) > 0 THEN 'versioned' END AS how FROM listed JOIN folder USING (place)""",
    "run_commands": """SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN NULL WHEN 4 THEN 1 ELSE 0 END AS status,
  CASE n_nationkey WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'nation ' || n_name END AS stdout, CASE WHEN n_nationkey <> 3 THEN '' END AS stderr,
  CASE WHEN n_nationkey = 3 THEN 'No such file or directory' END AS run_error FROM nation""",
    "pick_tool": f"""SELECT arg_max('tool-' || p_size, p_size) AS name, max(p_size) AS version FROM part
WHERE p_size BETWEEN {TOOL_VERSIONS[1]} AND {TOOL_VERSIONS[0]}""",
}
