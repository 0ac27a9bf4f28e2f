"""One call from files to what an extraction would do with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import manifest_text
from quarry.operators.extract import distinct_paths
from quarry.plans.commands import Options, archive_command, link_command
from quarry.sources import objects


def extract(files: DataFrame, options: Options | None = None, archive: bool = False, output: str | None = None, manifest: bool = False) -> DataFrame:
    """path, format, output, paths, args, manifest_path, manifest, error: a row for
    each file (path, content).

    ``paths`` are the distinct embedded paths of the object, or of all members of
    the archive, in component order; ``args`` links them, or with ``archive``
    archives those of an archive.  A file of another format, with a bad member or
    without any path has an ``error`` and nulls.  Without ``manifest`` its two
    columns are null.  A file's paths are one row's value, as they become one
    command.
    """
    options = options or Options()
    kind = objects.file_kind()
    said = objects.section_texts(files)
    bad = said.where("error is not null").groupBy("path").agg(F.min("error").alias("bad"))
    found = distinct_paths(said.where("error is null").withColumnRenamed("path", "of"), ["of"], ["member_pos"])
    found = found.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("component_key", "path"))).alias("found"))
    rows = files.select("path", kind.alias("format")).join(bad, "path", "left").join(found.withColumnRenamed("of", "path"), "path", "left")
    error = F.when(F.col("format").isNull(), "unsupported file format").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("found").isNull(), "no embedded paths")
    rows = rows.withColumn("error", error).withColumn("paths", F.when(F.col("error").isNull(), F.transform("found", lambda x: x["path"])))
    name = P.output_name(F.col("path"), F.when(F.col("format") == "archive", "archive").otherwise("object"), F.lit(archive), F.lit(output).cast("string"))
    rows = rows.withColumn("output", F.when(F.col("error").isNull(), name))
    link, packed = (make(F.col("paths"), F.col("output"), options) for make in (link_command, archive_command))
    args = F.when((F.col("format") == "archive") & F.lit(archive), packed).otherwise(link)
    beside = P.join(P.parent(F.col("path")), F.concat(P.file_name(F.col("output")), F.lit(".manifest")))
    asked = F.col("error").isNull() & F.lit(manifest)
    return rows.select(
        "path",
        "format",
        "output",
        "paths",
        F.when(F.col("error").isNull(), args).alias("args"),
        F.when(asked, beside).alias("manifest_path"),
        F.when(asked, manifest_text(F.col("paths"))).alias("manifest"),
        "error",
    )


def extract_files(spark: SparkSession, path: str, glob: str | None = None, **how) -> DataFrame:
    """``extract`` of the files in a folder, or of one file."""
    return extract(objects.read_files(spark, path, glob), **how)
