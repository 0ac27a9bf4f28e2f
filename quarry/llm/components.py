"""Connected components by alternating large-star and small-star.

Every round is two aggregations and joins over the edge table, which is written
to the shared folder; nothing is collected but a count and a checksum per round.
A hub's edges are aggregated before the shuffle (a minimum per task).  The minima
are written before they meet the edges again: a join's side that comes straight
from an aggregation can't be split by adaptive execution, one that is read can,
so a component may be as large as the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

MAX_ROUNDS = 60


def _meet(rows: DataFrame, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (a, b) with their node's minimum m, and the table to discard later."""
    least = materialize(least, "least")
    return rows.join(least.hint("merge"), "a"), least


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours go to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, least = _meet(both.where("b > a"), both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined, least = _meet(down, down.groupBy("a").agg(F.min("b").alias("m")))
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))), least


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges between different nodes as a table, and their count and
    checksum; stars that point at their smallest id stay as they are."""
    seen = Observation()
    rows = edges.where("a != b").distinct()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return materialize(rows, "edges"), (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that it
    reaches.  Edges from a node to itself are ignored but keep their node."""
    nodes = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    now, state = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        large, least = _large_star(now)
        large, _ = _written(large)
        small, lower = _small_star(large)
        after, seen = _written(small)
        for done in (now, least, large, lower):
            discard(done)
        now = after
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge points at its component's smallest id
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(roots).unionByName(nodes).groupBy("id").agg(F.min("component").alias("component"))
