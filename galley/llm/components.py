"""Connected components of a graph whose edges are rows, by alternating star steps.

Each step hooks the neighbours of a node to the least of them, so the edges end as
stars whose centres are the least nodes of their components; the number of rounds grows
with the logarithm of the longest path. A node's neighbours are never gathered: only
their minimum is, which is pre-aggregated before the shuffle, and the joins can split a
hub. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """node, root of every node that has an edge and isn't the least of its component; edges: columns a, b (long).

    Self-loops and repeated edges do no harm; rows with a null are ignored; no edges give
    no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.stored(now, "edges")
    seen = None
    for _ in range(limit):
        after = common.stored(_small_star(_large_star(now)), "edges")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = after
        if sign == seen or sign[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
    raise RuntimeError(f"no end after {limit} rounds")
