"""Connected components of a graph too large for one machine: large-star, small-star.

Each step replaces a node's edges by edges to its least neighbour; the minimum is an
aggregation and its spread a join, so no neighbourhood is ever gathered in a row.
Steps are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """u, v pairs with m: the least of u and all of its v."""
    m = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(m, "u")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots: the least node of its component."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, f"{name}-0")
    seen, step = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        star = _least(large.distinct())
        small = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(star.select("u", F.col("m").alias("v"))).filter("u <> v")
        step += 1
        now = scratch.save(small.distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
