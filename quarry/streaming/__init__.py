"""Streams of build records.

Classification and the plans made from it look at one command at a time, so they
run on a stream as they are and keep no state.  ``follow`` reads command records
as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.classify import parsed, with_actions


def follow(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parsed commands from JSON records (cmd_id, tokens, compiler_kind)."""
    records = (
        spark.readStream.schema("cmd_id long, tokens array<string>, compiler_kind string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )
    return parsed(with_actions(records))
