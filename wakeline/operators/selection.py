"""Exact percentiles by distributed selection: no task and no buffer ever holds a group's distinct values.

A round cuts the range that holds a wanted rank into `fan` buckets and counts them; the bucket with the rank, shrunk to the values that it really has, is the
range of the next round, and all others are left out. It ends when a range is one value. Values spread evenly take two or three rounds for a billion of
them; each round makes the range at least `fan` times narrower, so even doubles of all magnitudes end. The driver only learns whether a range is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.sinks import materialize


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], fan: int = 2048) -> DataFrame:
    """group, n, and a column for each of shares {name: share of 1}: percentiles by linear interpolation between the two neighbouring ranks.

    Nulls and NaN are left out; a group without values has no row.
    """
    x = F.col(value).cast("double")
    rows = materialize(rows.select(*group, (x + F.lit(0.0)).alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)").groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n")), "selection-values")
    sizes = rows.groupBy(*group).agg(F.sum("_n").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    # Wanted ranks (from 0): the one below each share, and its neighbour.
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()])
    place = F.col("w.q") * (F.col("n") - 1)
    ranks = sizes.select(*group, "n", "_low", "_high", F.explode(wanted).alias("w"))
    ranks = ranks.select(*group, "n", "_low", "_high", F.col("w.name").alias("name"), (place - F.floor(place)).alias("part"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    ranks = materialize(ranks, "selection-ranks")
    # A search is one rank of a group: the range that holds it, and how many values lie below that range.
    open_ = ranks.select(*group, "rank", F.col("_low").alias("low"), F.col("_high").alias("high"), F.lit(0).cast("long").alias("below")).distinct()
    open_, found = materialize(open_, "selection-open"), None
    while True:
        done = open_.filter("low = high").select(*group, "rank", F.col("low").alias("x"))
        found = done if found is None else found.union(done)
        open_ = open_.filter("low < high")
        if open_.isEmpty():
            break
        spans = open_.select(*group, "low", "high", "below").distinct()
        inside = rows.join(spans, group) if group else rows.crossJoin(F.broadcast(spans))  # without groups: a range for each rank, few
        inside = inside.filter((F.col("_x") >= F.col("low")) & (F.col("_x") <= F.col("high")))
        # Halves, so that the width of a range of huge values does not overflow.
        width = F.col("high") / 2 - F.col("low") / 2
        at = F.least(F.lit(fan - 1), F.floor((F.col("_x") / 2 - F.col("low") / 2) / width * fan)).cast("int")
        buckets = inside.withColumn("_b", at).groupBy(*group, "low", "high", "below", "_b").agg(F.sum("_n").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        order = Window.partitionBy(*group, "low", "high", "below").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.withColumn("_under", F.col("below") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
        key = [*group, "low", "high", "below"]
        nearer = open_.join(buckets, key).filter((F.col("rank") >= F.col("_under")) & (F.col("rank") < F.col("_under") + F.col("_n")))
        open_ = materialize(nearer.select(*group, "rank", F.col("_lo").alias("low"), F.col("_hi").alias("high"), F.col("_under").alias("below")), "selection-open")
    found = materialize(found, "selection-found")
    both = ranks.join(found, [*group, "rank"]).groupBy(*group, "n", "name", "part").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return both.groupBy(*group, "n").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in shares])
