"""Connected components of a large graph by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimloom.llm.storage import Workspace


def components(edges: DataFrame, ws: Workspace, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node that can be reached.

    Each round links every neighbour of a node to its smallest neighbour, first for larger and then for smaller
    ones, until only stars around the smallest node are left; the number of rounds grows with the logarithm of
    a component's size. Minima are aggregated before the shuffle, and a centre with very many neighbours is a
    skewed key of an ordinary join, which Spark splits. Nothing but two counts per round reaches the driver.
    Loops and nulls in ``edges`` are ignored; repeated edges do no harm.
    """
    now = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # larger neighbours: both directions, v > u keeps the far end
        both = now.select(F.col("u").alias("n"), F.col("v").alias("o")).union(now.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
        large = both.where("o > n").join(low, "n").select(F.col("o").alias("v"), F.col("m").alias("u")).distinct()
        large = ws.save(large)
        # smaller neighbours
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        following = ws.save(small.select("e.v", "e.u").where("v <> u").distinct())
        ws.drop(now, large)
        now = following
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u"), F.col("u")).distinct())
