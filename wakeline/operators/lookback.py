"""Looking back along time per key, without a frame a row, without pairs, and without sorting a whole key in one task.

Time is cut into slices. Inside a slice rows are sorted; what a slice has to know of earlier ones is carried over one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.numbering import numbered

SECOND = 1_000_000


def trailing_distinct(rows: DataFrame, scope: list[str], value: str, time: str, window_us: int, name: str) -> DataFrame:
    """Adds name: how many distinct values of a scope were seen in the window up to a row's time, both ends and rows of equal time included.

    A value counts from each sighting to the window's length after it. The union of these stretches changes the count by +1 where one begins and by
    -1 just after it ends, and a row's count is the sum of the changes up to it. Sightings in one slice of the window's length are always of one
    stretch, so a value has one row a slice at most, and hot scopes are summed slice by slice.
    """
    slices = rows.groupBy(*scope, value, _slice(time, window_us).alias("_s")).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    of_value = Window.partitionBy(*scope, value).orderBy("_s")
    begins = F.coalesce(F.col("_low") - F.lag("_high").over(of_value) > window_us, F.lit(True))
    ends = F.coalesce(F.lead("_low").over(of_value) - F.col("_high") > window_us, F.lit(True))
    changes = slices.withColumn("_begins", begins).withColumn("_ends", ends).select(
        *scope,
        F.inline(F.array_compact(F.array(
            F.when(F.col("_begins"), F.struct(F.col("_low").alias("_t"), F.lit(1).alias("_d"))),
            F.when(F.col("_ends"), F.struct((F.col("_high") + window_us + 1).alias("_t"), F.lit(-1).alias("_d"))),
        ))),
    )
    changes = changes.groupBy(*scope, "_t").agg(F.sum("_d").alias("_d"))
    asked = rows.withColumn("_t", F.col(time)).withColumn("_d", F.lit(0).cast("long"))
    both = asked.withColumn("_asks", F.lit(1)).unionByName(changes.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    summed = numbered(both, scope, _slice("_t", window_us), ["_t", "_asks"], "_at", {name: "_d"})
    return summed.filter("_asks = 1").select(*rows.columns, F.col(name).cast("int").alias(name))


def _slice(time: str, width_us: int) -> Column:
    return F.floor(F.col(time) / width_us)


def previous(rows: DataFrame, key: list[str], time: str, tie: str, gap_us: int, slice_us: int = 3600 * SECOND) -> DataFrame:
    """Adds prev (struct of time and tie; null for a key's first row) and start_us: where the key's chain of rows no further apart than gap began."""
    order = [time, tie]
    cut = rows.withColumn("_s", _slice(time, slice_us))
    here = Window.partitionBy(*key, "_s").orderBy(*order)
    slices = cut.groupBy(*key, "_s").agg(F.max(F.struct(*order)).alias("_last"))
    over = Window.partitionBy(*key).orderBy("_s")
    slices = slices.select(*key, "_s", F.lag("_last").over(over).alias("_carried"))
    seen = cut.join(slices, [*key, "_s"]).withColumn("prev", F.coalesce(F.lag(F.struct(*order)).over(here), F.col("_carried"))).drop("_carried")
    fresh = F.coalesce(F.col(time) - F.col(f"prev.{time}") > gap_us, F.lit(True))
    seen = seen.withColumn("_mark", F.when(fresh, F.col(time)))
    marks = seen.groupBy(*key, "_s").agg(F.max("_mark").alias("_mark_s"))
    carried = F.last("_mark_s", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.select(*key, "_s", carried.alias("_start"))
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = seen.join(marks, [*key, "_s"]).withColumn("start_us", F.coalesce(F.max("_mark").over(upto), F.col("_start")))
    return out.drop("_s", "_mark", "_start")


def nearest_candidates(events: DataFrame, gap_us: int = 300 * SECOND, span_us: int = 3600 * SECOND) -> DataFrame:
    """For each event the nearest earlier one of its run that shares its group or one of its entities, if one keeps the guards: no further away than
    the gap, and the chain on the shared key no longer than the span. run_id, event_id, candidate_id, delta_us, span_us, keys (how many keys of the
    event led to that candidate), shared ("group" or "entity", the group first).

    Every key looks back once over its own rows; the best of an event's keys (three at most) is an aggregate, so no pairs are made. Of equally near
    candidates the later in order counts, whichever key leads to it.
    """
    keys = F.array_distinct(F.array(F.concat(F.lit("e:"), "subject"), F.concat(F.lit("e:"), "object"), F.concat(F.lit("g:"), "dependency_group")))
    filed = events.select("run_id", "event_id", "event_us", F.explode(keys).alias("key")).filter("key IS NOT NULL")
    back = previous(filed, ["run_id", "key"], "event_us", "event_id", gap_us)
    delta, span = F.col("event_us") - F.col("prev.event_us"), F.col("event_us") - F.col("start_us")
    kept = back.filter((delta <= gap_us) & (span <= span_us))
    kind = F.when(F.col("key").startswith("g:"), 1).otherwise(0)
    best = F.max(F.struct(F.col("prev.event_us").alias("us"), F.col("prev.event_id").alias("id")))
    offers = kept.groupBy("run_id", "event_id", "event_us", "prev").agg(F.count(F.lit(1)).alias("keys"), F.max(kind).alias("kind"), F.max("start_us").alias("start_us"))
    chosen = offers.groupBy("run_id", "event_id", "event_us").agg(
        best.alias("best"), F.max_by(F.struct("keys", "kind", "start_us"), F.struct(F.col("prev.event_us"), F.col("prev.event_id"))).alias("how")
    )
    return chosen.select(
        "run_id", "event_id", F.col("best.id").alias("candidate_id"), (F.col("event_us") - F.col("best.us")).alias("delta_us"), (F.col("event_us") - F.col("how.start_us")).alias("span_us"),
        F.col("how.keys").alias("keys"), F.when(F.col("how.kind") == 1, "group").otherwise("entity").alias("shared"),
    )


def relations(links: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, event_id, candidate_id, relations (comma-joined, in this order) of links between two events (event_id is unique):

        endpoint_connection    they share an entity, and come from sources of different families
        authenticated_session  they share an entity, and both are of a session
        process_causal         they are of one group
        specific_entity        they share an entity
    """
    session = F.coalesce(F.col("command_family") == "remote_session", F.lit(False)) | F.coalesce(F.col("protocol") == "ssh", F.lit(False))
    side = F.struct(F.array("subject", "object").alias("entities"), F.col("source_family").alias("family"), session.alias("session"), F.col("dependency_group").alias("grp"))
    sides = events.select("event_id", side.alias("side"))
    both = links.select("run_id", "event_id", "candidate_id").join(sides.withColumnRenamed("side", "a"), "event_id")
    both = both.join(sides.select(F.col("event_id").alias("candidate_id"), F.col("side").alias("b")), "candidate_id")
    shared = F.coalesce(F.arrays_overlap("a.entities", "b.entities"), F.lit(False))
    kinds = {
        "endpoint_connection": shared & (F.col("a.family") != F.col("b.family")), "authenticated_session": shared & F.col("a.session") & F.col("b.session"),
        "process_causal": F.col("a.grp") == F.col("b.grp"), "specific_entity": shared,
    }
    names = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in kinds.items()]))
    return both.select("run_id", "event_id", "candidate_id", F.array_join(names, ",").alias("relations"))
