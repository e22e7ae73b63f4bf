"""Connected components by alternating star contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the smallest node reachable.

    Null ends and loops are ignored.  Each round links every node to the smallest of its neighbours; large stars
    move whole neighbourhoods, small stars halve chains, so rounds grow with the logarithm of a chain's length.
    Only a row count reaches the driver.  Minima are aggregated before the shuffle; a hot node's edges are joined to
    one row, which adaptive execution splits.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.join(low, "a")
        out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else \
            out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        new = materialise(star(star(now, large=True), large=False))
        # at the fixed point every node points straight at its component and at nothing else
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        release(now)
        now = new
        if same:
            break
    tree = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tree.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
