"""Connected components by joins, for any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch


def connected_components(edges: DataFrame, *, scratch: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the edges' columns u and v (long).

    component is the smallest node that can be reached. Alternates the two
    star steps: each node points its larger neighbours, then its smaller ones,
    at the smallest of them, until no edge changes. Each round is a grouped
    minimum and a join, and is written to the shared folder. No links or
    components reach the driver; only a count and a checksum do.
    Nodes without edges have no row; loops and repeated edges are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _checksum(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.filter("u <> v").distinct())
        scratch.drop(large, now)
        now, before, mark = after, mark, _checksum(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
