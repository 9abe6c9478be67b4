"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest node that links reach. Nodes without a link to another are left out.

    Each round points nodes at smaller neighbours; the longest way to the smallest node shrinks by about half. Stops when nothing
    changes, and raises if that is not so after rounds, as an unfinished state is no result.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    last = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "cc-edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.countDistinct("u").alias("k")).first()
        now = (state["n"], state["s"])
        if now == last and state["n"] == state["k"]:
            break
        last = now
    else:
        raise RuntimeError(f"components have not come to rest after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
