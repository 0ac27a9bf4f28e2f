"""Ordering and deduplication of extracted path lists.

The order is by path component, not by byte, and equality too; of equal paths
the first stays as it was spelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.once import computed_once
from quarry.functions.paths import component_key
from quarry.functions.text import section_lines
from quarry.sources.scratch import written


def sorted_paths_per_object(objects: DataFrame, text: str = "text") -> DataFrame:
    """objects with ``paths``: each text's lines, sorted and without repeats.

    All inside one row, so nothing is shuffled: lines become (key, position,
    line), sort by that, and those whose key equals the one before go.  The
    sorted lines are a column of their own that is worked out once, as a lambda
    would sort them again for each of its elements.
    """
    ordered = "ordered"
    while ordered in objects.columns:
        ordered += "_"
    keyed = F.transform(section_lines(F.col(text)), lambda line, i: F.struct(component_key(line).alias("k"), i.alias("i"), line.alias("line")))
    sorted_ = objects.withColumn(ordered, computed_once(F.sort_array(keyed)))
    first = F.filter(ordered, lambda x, i: (i == 0) | (x["k"] != F.get(F.col(ordered), i - 1)["k"]))
    return sorted_.withColumn("paths", F.transform(first, lambda x: x["line"])).drop(ordered)


def distinct_paths(objects: DataFrame, group: list[str], order: list[str], text: str = "text") -> DataFrame:
    """group, path, component_key: the distinct paths of each group's objects; of
    spellings of one path the first by ``order`` and line stays.

    An aggregation with a partial step, so a group of any size sends a row per
    task and path; ``pos`` is left to the reader, who sorts by the key.
    """
    lines = objects.select(*group, *order, F.posexplode(section_lines(F.col(text))).alias("_line", "path"))
    lines = lines.withColumn("component_key", component_key(F.col("path")))
    return lines.groupBy(*group, "component_key").agg(F.min_by("path", F.struct(*order, "_line")).alias("path"))


def number_paths(paths: DataFrame, group: list[str], parts: int | None = None) -> DataFrame:
    """paths with ``pos``, their place in their group's component order.

    Rows are dealt in ranges of group and key, so a large group lies in several;
    each numbers its own, and what a group has in the ranges before is added.
    The ranges are written, as they are read twice and must not change between.
    """
    by = [*group, "component_key"]
    ranged = paths.repartitionByRange(parts, *by) if parts else paths.repartitionByRange(*by)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(group)), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *group).orderBy("component_key")
    same = [F.col("_range") == F.col("_of"), *(F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(group))]
    rows = ranged.withColumn("_place", F.row_number().over(inside) - 1).join(sizes, same)
    return rows.select(*paths.columns, (F.col("_place") + F.col("_before")).cast("int").alias("pos"))


def pick_last(found: DataFrame, path: str) -> DataFrame:
    """The last path in component order; null of an empty table."""
    return found.agg(F.max_by(path, component_key(F.col(path))).alias(path))


def pick_version(tools: DataFrame, name: str, version: str, highest: int, lowest: int) -> DataFrame:
    """The usable tool of the highest version within the bounds."""
    return tools.where(F.col(version).between(lowest, highest)).agg(F.max_by(name, version).alias(name), F.max(version).alias(version))
