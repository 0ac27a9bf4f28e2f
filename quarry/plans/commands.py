"""Command plans: what a build would run, as rows.  Nothing is executed."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.functions.once import computed_once
from quarry.operators.classify import compile_mode, skip_reason, without_forbidden
from quarry.plans.rules import LOG_LEVELS, OPTION_KEYS, UNUSED_KEYS


@dataclass
class Options:
    """What a build is configured with."""

    compiler: dict[str, str] = field(default_factory=lambda: {"Clang": "clang", "ClangXX": "clang++"})
    lto_flags: list[str] = field(default_factory=list)
    bitcode_flags: list[str] = field(default_factory=list)
    merge_flags: list[str] = field(default_factory=list)
    linker: str = "llvm-link"
    archiver: str = "llvm-ar"
    store: str | None = None
    configure_only: bool = False
    log_level: int = 0

    def __post_init__(self) -> None:
        if self.store is not None and not self.store.startswith("/"):
            raise ValueError("the store must be an absolute path")

    @classmethod
    def from_toml(cls, text: str) -> Options:
        """Options from a table by the names in ``OPTION_KEYS``; a store that isn't
        an absolute path is ignored, and other keys and wrong types are refused."""
        table = tomllib.loads(text)
        if unknown := set(table) - set(OPTION_KEYS) - UNUSED_KEYS:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        found: dict = {}
        for key, (name, kind) in OPTION_KEYS.items():
            if key not in table:
                continue
            value = table[key]
            fine = isinstance(value, kind) and not (kind is int and isinstance(value, bool))
            if not fine or (kind is list and not all(isinstance(x, str) for x in value)) or (kind is int and not 0 <= value <= 255):
                raise ValueError(f"{key} has a wrong type")
            if name.startswith("compiler."):
                found.setdefault("compiler", cls().compiler)[name.partition(".")[2]] = value
            elif name != "store" or value.startswith("/"):
                found[name] = value
        return cls(**found)

    @property
    def log_name(self) -> str:
        """The level by ordinal, held within the list."""
        return LOG_LEVELS[max(0, min(len(LOG_LEVELS) - 1, self.log_level))]


def log_name(level: Column) -> Column:
    """The name of each row's level by ordinal, held within the list."""
    return F.get(_strings(LOG_LEVELS), F.greatest(F.lit(0), F.least(level, F.lit(len(LOG_LEVELS) - 1))).cast("int"))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _compiler(options: Options) -> Column:
    out = F.lit(None).cast("string")
    for kind, path in options.compiler.items():
        out = F.when(F.col("compiler_kind") == kind, path).otherwise(out)
    return F.array(out)


def link_command(files: Column, output: Column, options: Options) -> Column:
    """Merges files of intermediate code into one."""
    return F.concat(F.array(F.lit(options.linker)), _strings(options.merge_flags), F.array(F.lit("-o"), output), files)


def archive_command(files: Column, output: Column, options: Options) -> Column:
    """Puts files of intermediate code in one archive."""
    return F.concat(F.array(F.lit(options.archiver), F.lit("rs"), output), files)


def build_command(options: Options) -> Column:
    """The wrapped compilation: all original arguments (link-time flags first
    when only linking) without forbidden ones."""
    lto = F.when(compile_mode() == "LTO", _strings(options.lto_flags)).otherwise(_strings([]))
    return without_forbidden(F.concat(_compiler(options), lto, F.col("input_args")), F.col("forbidden_flags"))


def _absolute(parsed: DataFrame, path: Column) -> Column:
    """The path, absolute where ``cwd`` makes it so."""
    return F.coalesce(paths.absolute(path, F.col("cwd")), path) if "cwd" in parsed.columns else path


def _sources(parsed: DataFrame) -> Column:
    return F.transform("input_files", lambda s: _absolute(parsed, s))


def artifacts(parsed: DataFrame, options: Options) -> DataFrame:
    """cmd_id, pos, src_path, object_path, bitcode_path per input file, in order.
    With a column ``cwd`` in ``parsed``, sources are made absolute; one that can't
    be has null paths, stays as it is, and ``error`` says so."""
    src = F.col("src_path")
    rows = parsed.select("cmd_id", "is_compile_only", F.posexplode(_sources(parsed)).alias("pos", "src_path"))
    store = None if options.store is None else F.lit(options.store)
    return rows.select(
        "cmd_id",
        "pos",
        "src_path",
        paths.object_path(src, F.col("is_compile_only")).alias("object_path"),
        paths.bitcode_path(src, store).alias("bitcode_path"),
        F.when(~paths.is_absolute(src), "source path is not absolute").alias("error"),
    )


def command_plan(parsed: DataFrame, options: Options) -> DataFrame:
    """cmd_id, step, kind, args: the build command, and unless it is skipped, for
    each input an object command (when not only compiling), a bitcode command
    (unless it is bitcode), the embedding, and then the link command.

    Steps are numbered from 0 in the order of running.  A command with a source
    that isn't absolute and has no ``cwd`` to make it so has, after the build, one
    step `error` that names those.  All of it comes from one row, by building an
    array and exploding it, so no stage shuffles.
    """
    store = None if options.store is None else F.lit(options.store)
    cc = _compiler(options)
    sources, made, whole = _free("sources", parsed), _free("made", parsed), _free("whole", parsed)

    def command(kind: str, args: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), args.alias("args"))

    def names(src: Column) -> Column:
        return F.struct(src.alias("src"), paths.object_path(src, F.col("is_compile_only")).alias("obj"), paths.bitcode_path(src, store).alias("code"))

    def steps(m: Column) -> Column:
        src, obj, code = m["src"], m["obj"], m["code"]
        is_code = F.coalesce(paths.extension(src) == "bc", F.lit(False))
        build = command("object", F.concat(cc, F.col("compile_args"), F.array(F.lit("-c"), F.lit("-o"), obj, src)))
        make = command("bitcode", F.concat(cc, F.col("compile_args"), _strings(options.bitcode_flags), F.array(F.lit("-emit-llvm"), F.lit("-c"), F.lit("-o"), code, src)))
        embed = command("embed", F.array(paths.used_bitcode(src, code), obj))
        return F.filter(F.array(F.when(~F.col("is_compile_only"), build), F.when(~is_code, make), embed), lambda x: x.isNotNull())

    # worked out once each: sources of commands that have steps, and their paths
    reason = skip_reason(options.configure_only)
    own = parsed.where("error is null").withColumn(sources, computed_once(F.when(reason.isNull(), _sources(parsed))))
    lost = F.filter(sources, lambda s: ~paths.is_absolute(s))
    own = own.withColumn(made, computed_once(F.when(F.size(lost) == 0, F.transform(sources, names))))
    objects = F.transform(made, lambda m: m["obj"])
    lto = F.when(F.col("is_lto"), _strings(options.lto_flags)).otherwise(_strings([]))
    link = command("link", F.concat(cc, lto, F.col("link_args"), F.array(F.lit("-o"), _absolute(parsed, F.col("output_filename"))), objects))
    # only compiling leaves nothing to link, and without an output there is nowhere to
    links = ~F.col("is_compile_only") & (F.col("output_filename") != "")
    none = F.slice(F.array(command("build", _strings([]))), 1, 0)
    inner = F.concat(F.flatten(F.transform(made, steps)), F.when(links, F.array(link)).otherwise(none))
    inner = F.when(F.col(sources).isNull(), none).when(F.size(lost) > 0, F.array(command("error", F.concat(F.array(F.lit("source path is not absolute")), lost)))).otherwise(inner)
    own = own.withColumn(whole, computed_once(F.concat(F.array(command("build", build_command(options))), inner)))
    rows = own.select("cmd_id", F.posexplode(whole).alias("step", "c"))
    return rows.select("cmd_id", "step", "c.kind", "c.args")


def _free(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name
