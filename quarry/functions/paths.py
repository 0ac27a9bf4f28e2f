"""Path functions as column expressions.  Nothing here touches a file system: a
relative path is made absolute by the working directory it is given with, by
components alone, and is null without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def component_key(path: Column) -> Column:
    """What paths compare by: their components, tagged so that a root sorts
    before a leading `.`, that before `..`, and that before names.  Empty
    components and inner `.` don't count, so `/a//b`, `/a/./b` and `/a/b/` are
    one path, and `/a/b` precedes `/a-b/c`."""
    parts = F.split(path, "/")
    tagged = F.transform(
        parts,
        lambda c, i: F.when((c == "") & (i == 0) & is_absolute(path), "0")
        .when((c == ".") & (i == 0), "1")
        .when(c == "..", "2")
        .when(~c.isin("", "."), F.concat(F.lit("3"), c)),
    )
    return F.filter(tagged, lambda t: t.isNotNull())


def _components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: ~c.isin("", "."))


def absolute(path: Column, folder: Column) -> Column:
    """The path from the root, below an absolute folder if it is relative, with
    `.`, `..` and empty components resolved; `..` of the root is the root.  Links
    aren't followed.  Null for a relative path without an absolute folder."""
    whole = F.when(is_absolute(path), path).when(is_absolute(folder), F.concat(folder, F.lit("/"), path))
    none = F.array().cast("array<string>")

    def step(done: Column, c: Column) -> Column:
        return F.when(c == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(c)))

    return F.concat(F.when(whole.isNotNull(), "/"), F.array_join(F.aggregate(_components(whole), none, step), "/"))


def file_name(path: Column) -> Column:
    """The last component; null where that is `..` or there is none."""
    last = F.try_element_at(_components(path), F.lit(-1))
    return F.when(last != "..", last)


def parent(path: Column) -> Column:
    """The path without its last component."""
    c = _components(path)
    return F.concat(F.when(is_absolute(path), "/").otherwise(""), F.array_join(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), "/"))


def file_stem(path: Column) -> Column:
    """The name up to its last dot; a name that begins with its only dot is whole."""
    name = file_name(path)
    stem = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)
    return F.when(stem == "", name).otherwise(stem)


def extension(path: Column) -> Column:
    """What follows the last dot; null where ``file_stem`` is the whole name."""
    name, stem = file_name(path), file_stem(path)
    return F.when(name != stem, F.substr(name, F.length(stem) + 2))


def join(folder: Column, name: Column) -> Column:
    return F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), name)


def object_path(src: Column, compile_only: Column) -> Column:
    """Where the object of a source goes: beside it, named after the whole name
    when only compiling and hidden otherwise; null for a relative source."""
    name = F.when(compile_only, F.concat(file_name(src), F.lit(".o"))).otherwise(F.concat(F.lit("."), file_stem(src), F.lit(".o")))
    return F.when(is_absolute(src), join(parent(src), name))


def path_hash(path: Column) -> Column:
    """A hash that tells sources apart in a store: the first 16 hex digits of
    SHA-256, which is the same on every machine and version."""
    return F.substr(F.sha2(path, 256), F.lit(1), F.lit(16))


def bitcode_path(src: Column, store: Column | None = None) -> Column:
    """Where the intermediate code of a source goes: hidden beside it, or in a
    store under a name that holds the source's hash."""
    beside = F.concat(F.lit("."), file_stem(src), F.lit(".o.bc"))
    path = join(parent(src), beside)
    if store is not None:
        kept = join(store, F.concat(F.lit("."), file_stem(src), F.lit(".o_"), path_hash(src), F.lit(".bc")))
        path = F.when(store.isNotNull(), kept).otherwise(path)
    return F.when(is_absolute(src), path)


def used_bitcode(src: Column, derived: Column) -> Column:
    """A source that is intermediate code already is used itself."""
    return F.when(extension(src) == "bc", src).otherwise(derived)


def output_name(path: Column, kind: Column, archive: Column, output: Column | None = None) -> Column:
    """Name of what an extraction writes: the one asked for, else the input's
    stem and `bc` for an object, `a.bc` for an archive, `bca` for an archive
    that is kept one."""
    ending = F.when(kind == "archive", F.when(archive, "bca").otherwise("a.bc")).otherwise("bc")
    named = F.concat(file_stem(path), F.lit("."), ending)
    return named if output is None else F.coalesce(output, named)
