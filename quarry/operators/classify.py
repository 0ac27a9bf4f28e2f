"""Classification of command-line tokens and the facts that follow from it.

A command is a row with ``tokens``.  Rules are looked up for all its tokens at
once; which tokens are parameters of the one before, or members of a linker
group, is a fold along the command, which keeps no more than a position.  It all
stays in one row: commands run in parallel and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.once import computed_once
from quarry.plans.rules import GROUP_END, SKIP_REASONS, rule_of

_COMPILE = ["dependency_only", "compile_unary", "dependency_binary", "compile_binary", "compile_link_unary", "compile_link_binary"]
_LINK = ["object_file", "linker_group", "link_unary", "link_binary", "compile_link_unary", "compile_link_binary"]
_WITH_PARAMETER = ["dependency_binary", "compile_binary", "link_binary", "compile_link_binary"]
_ACT = "array<struct<pos:int,used:int,handler:string>>"


def actions(tokens: Column) -> Column:
    """array<struct(pos, used, handler)>: the tokens that act, from 1, and how
    many tokens each uses up.  An unmatched token has a null handler; a flag
    whose parameter is missing at the end has `missing_parameter`."""
    rules, n = F.transform(tokens, rule_of), F.size(tokens)

    def step(state: Column, i: Column) -> Column:
        rule = F.element_at(state["rules"], i)
        end = F.array_position(F.slice(tokens, i + 1, n), GROUP_END).cast("int")
        handler = (
            F.when((rule["handler"] == "group") & (end > 0), "linker_group")
            .when(rule["handler"] == "group", "compile_unary")
            .when((rule["arity"] == 1) & (i == n), "missing_parameter")
            .otherwise(rule["handler"])
        )
        used = F.when((rule["handler"] == "group") & (end > 0), end + 1).when((rule["arity"] == 1) & (i < n), 2).otherwise(1)
        act = F.struct(i.alias("pos"), used.alias("used"), handler.alias("handler"))
        return F.when(i < state["free"], state).otherwise(
            F.struct((i + used).alias("free"), F.concat(state["acts"], F.array(act)).cast(_ACT).alias("acts"), state["rules"].alias("rules"))
        )

    start = F.struct(F.lit(1).alias("free"), F.array().cast(_ACT).alias("acts"), rules.alias("rules"))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["acts"])


def with_actions(commands: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """commands with ``actions``.  ``objects`` (path, kind) says which unmatched
    tokens name files: kind `object` makes one an object file, kind `unparsable`
    an error; others, and all without it, are compile arguments.

    Only commands with unmatched tokens meet ``objects``, and only by the tokens'
    text, so the join moves those tokens and brings back a row per command.
    """
    acted = commands.withColumn("actions", computed_once(actions(F.col("tokens"))))
    if objects is None:
        return acted.withColumn("actions", F.transform("actions", lambda a: a.withField("handler", F.coalesce(a["handler"], F.lit("compile_unary")))))
    tokens = acted.select("tokens", F.explode("actions").alias("a")).where("a.handler is null")
    tokens = tokens.select("tokens", "a.pos", F.element_at("tokens", F.col("a.pos")).alias("path"))
    found = tokens.join(objects.groupBy("path").agg(F.min("kind").alias("kind")), "path")
    # by the tokens, not the id: equal commands find the same files, however often they occur
    found = found.groupBy("tokens").agg(F.map_from_entries(F.collect_set(F.struct("pos", "kind"))).alias("files"))

    def settled(a: Column) -> Column:
        kind = F.try_element_at("files", a["pos"])
        said = F.when(kind == "object", "object_file").when(kind == "unparsable", "unparsable_file").otherwise("compile_unary")
        return a.withField("handler", F.coalesce(a["handler"], said))

    return acted.join(found, "tokens", "left").select(*(acted[c] for c in acted.columns), "files").withColumn("actions", F.transform("actions", settled)).drop("files")


def classified_tokens(acted: DataFrame) -> DataFrame:
    """cmd_id, pos (from 0), token, handler, parameter (null without one)."""
    a = acted.select("cmd_id", "tokens", F.explode("actions").alias("a"))
    return a.select(
        "cmd_id",
        (F.col("a.pos") - 1).alias("pos"),
        F.element_at("tokens", F.col("a.pos")).alias("token"),
        F.col("a.handler").alias("handler"),
        F.when((F.col("a.used") == 2) & (F.col("a.handler") != "linker_group"), F.try_element_at("tokens", F.col("a.pos") + 1)).alias("parameter"),
    )


def parsed(acted: DataFrame) -> DataFrame:
    """acted with the sixteen facts of a command and ``error`` (null if none)."""
    tokens, acts = F.col("tokens"), F.col("actions")

    def first(a: Column) -> Column:
        return F.element_at(tokens, a["pos"])

    def listed(handlers: list[str], part) -> Column:
        return F.flatten(F.transform(F.filter(acts, lambda a: a["handler"].isin(handlers)), part))

    def argument(a: Column) -> Column:
        whole = a["handler"].isin("linker_group", *_WITH_PARAMETER)
        return F.slice(tokens, a["pos"], F.when(whole, a["used"]).otherwise(1))

    def alone(a: Column) -> Column:
        return F.array(first(a))

    def any_of(*handlers: str) -> Column:
        return F.exists(acts, lambda a: a["handler"].isin(*handlers))

    outputs = F.transform(F.filter(acts, lambda a: a["handler"] == "output_file"), lambda a: F.element_at(tokens, a["pos"] + 1))
    inputs = listed(["input_file"], alone)
    return acted.withColumns(
        {
            "input_args": tokens,
            "input_files": inputs,
            "object_files": listed(["object_file"], alone),
            "output_filename": F.coalesce(F.try_element_at(outputs, F.lit(-1)), F.lit("")),
            "compile_args": listed(_COMPILE, argument),
            "link_args": listed(_LINK, argument),
            "forbidden_flags": listed(["warning_link_unary"], alone),
            "is_verbose": any_of("verbose"),
            "is_dependency_only": any_of("dependency_only", "dependency_binary"),
            "is_preprocess_only": any_of("preprocess_only"),
            "is_assemble_only": any_of("assemble_only"),
            "is_assembly": F.exists(inputs, lambda x: x.rlike(r"\.(s|S)\z")),
            "is_compile_only": any_of("compile_only", "emit_llvm"),
            "is_emit_llvm": any_of("emit_llvm"),
            "is_lto": any_of("lto"),
            "is_print_only": any_of("print_only"),
            "error": F.when(F.size(tokens) == 0, "no arguments")
            .when(any_of("missing_parameter"), "missing parameter")
            .when(any_of("unparsable_file"), "unparsable file"),
        }
    )


def skip_reason(configure_only: Column | bool = False) -> Column:
    """Why a parsed command makes no intermediate code; null if it does.  Of
    several reasons the last in the list counts, so they are tried backwards."""
    holds = {
        "configure_only": configure_only if isinstance(configure_only, Column) else F.lit(configure_only),
        "no_inputs": F.size("input_files") == 0,
        "emit_llvm": F.col("is_emit_llvm"),
        "lto": F.col("is_lto"),
        "assembly": F.col("is_assembly"),
        "assemble_only": F.col("is_assemble_only"),
        "dependency_only": F.col("is_dependency_only") & ~F.col("is_compile_only"),
        "preprocess_only": F.col("is_preprocess_only"),
        "print_only": F.col("is_print_only"),
    }
    out = F.lit(None).cast("string")
    for name, reason in SKIP_REASONS:
        out = F.when(holds[name], reason).otherwise(out)
    return out


def compile_mode() -> Column:
    """Linking or LTO for a command with link arguments and no inputs, else Compiling."""
    links = (F.size("input_files") == 0) & (F.size("link_args") > 0)
    return F.when(links, F.when(F.col("is_lto"), "LTO").otherwise("Linking")).otherwise("Compiling")


def without_forbidden(args: Column, forbidden: Column) -> Column:
    """Every argument that equals a forbidden flag goes; repeats of others stay."""
    return F.filter(args, lambda x: ~F.array_contains(forbidden, x))
