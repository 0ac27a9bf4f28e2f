"""Finding the tools that plans name, and running plans.

Nothing else here starts a process: plans stay rows until someone hands them to
``run_commands``.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WHITE_SPACE
from quarry.plans.commands import Options
from quarry.plans.rules import CONFIG_TOOL, TOOL_NAMES, TOOL_VERSIONS


def find_tool(listing: DataFrame, folders: list[str], named: str | None = None, tool: str = CONFIG_TOOL, versions: tuple[int, int] = TOOL_VERSIONS) -> DataFrame:
    """path, how: one row, with the tool that a build would be configured from.

    ``listing`` has the ``path`` of each plain file that may be run; ``folders``
    are searched in order.  A path that the environment names comes first and
    need not be listed, then the plain name in any folder, then names with a
    version, from the highest down.  Without any, both columns are null.  Only
    files whose name and folder are looked for leave the scan.
    """
    spark = listing.sparkSession
    if named is not None:
        return spark.createDataFrame([(named, "named")], "path string, how string")
    names = [tool, *(f"{tool}-{v}" for v in range(versions[0], versions[1] - 1, -1))]
    sought = [f"{folder.rstrip('/')}/{name}" for name in names for folder in folders]
    wanted = spark.createDataFrame([(path, rank) for rank, path in enumerate(sought)], "path string, rank int")
    found = listing.select("path").join(F.broadcast(wanted), "path")
    how = F.when(F.min("rank") < len(folders), "plain").when(F.min("rank").isNotNull(), "versioned")
    return found.agg(F.min_by("path", "rank").alias("path"), how.alias("how"))


def tools_in(listing: DataFrame, folder: str) -> DataFrame:
    """tool, path, found: whether each tool that a build needs is in the folder."""
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(name, f"{folder.rstrip('/')}/{name}") for name in TOOL_NAMES], "tool string, path string")
    seen = listing.select("path").join(F.broadcast(wanted.select("path")), "path", "left_semi").distinct().withColumn("found", F.lit(True))
    return wanted.join(seen, "path", "left").select("tool", "path", F.coalesce("found", F.lit(False)).alias("found"))


def options_from(tools: DataFrame) -> Options:
    """Options with the tools of ``tools_in``; those that are missing are an error."""
    rows = tools.limit(len(TOOL_NAMES)).collect()
    if missing := sorted(r.path for r in rows if not r.found):
        raise FileNotFoundError(f"no such tools: {', '.join(missing)}")
    at = {r.tool: r.path for r in rows}
    found: dict = {"compiler": {}}
    for name, option in TOOL_NAMES.items():
        if option is not None and option.startswith("compiler."):
            found["compiler"][option.partition(".")[2]] = at[name]
        elif option is not None:
            found[option] = at[name]
    return Options(**found)


def run_commands(plans: DataFrame, args: str = "args", cwd: str | None = None, seconds: float | None = None) -> DataFrame:
    """plans with ``status``, ``stdout``, ``stderr`` and ``run_error``.

    Each row's command runs once, in order within its partition, without a shell
    or input, in the folder that the column ``cwd`` names.  Output is UTF-8 with
    outer white space removed.  A command that can't be started, that takes
    longer than ``seconds``, that has a null argument or none, or whose output
    isn't UTF-8 has a ``run_error``, and nulls for what is unknown; one ended by
    a signal has its negated number as status.

    Spark may run a task again, after a lost executor or for speculation, and
    the commands with it: write the result once, and run only what may be
    repeated.  To run a build's steps in order, give all of one command a
    partition, sorted by step.
    """
    rows = plans.select("*")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", status int, stdout string, stderr string, run_error string"
    space = WHITE_SPACE

    def one(command: list | None, folder: str | None) -> tuple:
        if not command or any(x is None for x in command):
            return None, None, None, "no arguments" if not command else "null argument"
        try:
            done = subprocess.run(command, cwd=folder, stdin=subprocess.DEVNULL, capture_output=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired:
            return None, None, None, "took too long"
        except (OSError, ValueError) as bad:
            return None, None, None, os.strerror(bad.errno) if isinstance(bad, OSError) and bad.errno else str(bad)
        try:
            return done.returncode, done.stdout.decode().strip(space), done.stderr.decode().strip(space), None
        except UnicodeDecodeError:
            return done.returncode, None, None, "output is not UTF-8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders = batch.column(cwd).to_pylist() if cwd else [None] * batch.num_rows
            out = [one(a, f) for a, f in zip(batch.column(args).to_pylist(), folders, strict=True)]
            new = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "status", "stdout", "stderr", "run_error"])

    return rows.mapInArrow(run, schema)

