"""The manifest sink: a group's paths in one file, without a trailing newline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import manifest_text


def manifests(extracted: DataFrame, input_path: str = "path", output_name: str = "output", paths: str = "paths") -> DataFrame:
    """manifest_path, manifest: beside the input, named after the output."""
    name = F.concat(P.file_name(F.col(output_name)), F.lit(".manifest"))
    return extracted.select(P.join(P.parent(F.col(input_path)), name).alias("manifest_path"), manifest_text(F.col(paths)).alias("manifest"))


def write_manifests(made: DataFrame) -> None:
    """Writes each manifest to its path through Spark's file systems, a row at a
    time as rows arrive, so the driver holds one."""
    spark = made.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in made.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row["manifest_path"])
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(row["manifest"].encode()))
        finally:
            out.close()
