"""Episode builders that need no state machine: fixed bins, sliding sessions, entity components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.sinks import materialize

SECOND = 1_000_000


def fixed_bins(events: DataFrame, width_s: int = 300) -> DataFrame:
    """Adds episode_no (from 0, by time) for bins of width_s counted from the run's first event."""
    starts = events.groupBy("run_id").agg(F.min("event_us").alias("t0"))
    binned = events.join(starts, "run_id").withColumn("bin_no", F.floor((F.col("event_us") - F.col("t0")) / (width_s * SECOND))).drop("t0")
    numbers = binned.select("run_id", "bin_no").distinct().withColumn("episode_no", (F.row_number().over(Window.partitionBy("run_id").orderBy("bin_no")) - 1).cast("long"))
    return binned.join(numbers, ["run_id", "bin_no"])


def sliding_sessions(events: DataFrame, gap_s: int = 300) -> DataFrame:
    """Adds session_no per run: a new session starts where the last event is more than gap_s ago."""
    order = Window.partitionBy("run_id").orderBy("event_us", "event_id")
    fresh = (F.col("event_us") - F.lag("event_us").over(order) > gap_s * SECOND).cast("int")
    return events.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("session_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("fresh")


def episode_bounds(members: DataFrame, scope: list[str]) -> DataFrame:
    return members.groupBy(*scope).agg(F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us"), F.count(F.lit(1)).alias("n_events"))


def entity_components(members: DataFrame, scope: list[str], bound: int = 100) -> DataFrame:
    """Connected components of events that share a subject or object inside a scope: adds component (its smallest event id).

    Star contraction over a graph in which every event points to the smallest event of each of its entities. Large-star and small-star
    rounds shorten the longest way to the smallest event by about half, so a chain of any length needs few rounds; each is written out,
    so a lost executor never sets it back further than its start. Raises if it has not come to rest after bound rounds.
    """
    nodes = members.select(*scope, F.col("event_id").alias("u")).distinct()
    touched = members.select(*scope, F.col("event_id").alias("u"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity")).filter("entity IS NOT NULL")
    first = touched.groupBy(*scope, "entity").agg(F.min("u").alias("v"))
    edges = materialize(touched.join(first, [*scope, "entity"]).filter("u <> v").select(*scope, "u", "v").distinct(), "components")
    for _ in range(bound):
        both = edges.unionByName(edges.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above u goes to the smallest of u and its neighbours.
        low = both.groupBy(*scope, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, [*scope, "u"]).select(*scope, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy(*scope, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*scope, "u"]).select(*scope, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select(*scope, "u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "components")
        # At rest when every node has one edge and no node that is pointed to points on.
        stars = edges.groupBy(*scope, "u").agg(F.count(F.lit(1)).alias("n"))
        if stars.filter("n > 1").isEmpty() and edges.join(stars.select(*scope, F.col("u").alias("v")), [*scope, "v"], "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components have not come to rest after {bound} rounds")
    return nodes.join(edges, [*scope, "u"], "left").select(*scope, F.col("u").alias("event_id"), F.coalesce("v", "u").alias("component"))
