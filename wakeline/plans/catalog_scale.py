"""Registered queries of what must not depend on the size of one run or key: formation by segments, looking back over several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import formation, lookback, segments
from wakeline.plans.catalog import _REVISION, _flat, query
from wakeline.plans.ctes import formed_sql, sql
from wakeline.plans.frames import Frames
from wakeline.sources import sinks
from wakeline.sources.adapters import EPOCH_US

#: The stream drawn out in time, so that a run has holes wider than the link gap.
STRETCH = 10
#: Events of a chunk. Small, as the test tables are; runs of millions of events take tens of thousands.
CHUNK_EVENTS = 100
_STRETCHED = f"""SELECT * REPLACE ({EPOCH_US} + (event_us - {EPOCH_US}) * {STRETCH} AS event_us,
    {EPOCH_US} + (event_us - {EPOCH_US}) * {STRETCH} + ingest_us - event_us AS ingest_us) FROM base"""


def stretched(f: Frames) -> DataFrame:
    moved = F.lit(EPOCH_US) + (F.col("event_us") - EPOCH_US) * STRETCH
    norm = f.norm.withColumn("lag", F.col("ingest_us") - F.col("event_us")).withColumn("event_us", moved).withColumn("ingest_us", F.col("event_us") + F.col("lag"))
    return formation.formation_input(norm.drop("lag"), f.aliases)


@query(formed_sql(f"SELECT {_REVISION} FROM formed", norm=_STRETCHED))
def segment_revisions(f: Frames) -> DataFrame:
    """Revisions of runs that are cut at holes in event time and formed in chunks."""
    return _flat(segments.form_segments(stretched(f), chunk_events=CHUNK_EVENTS))


@query(formed_sql("""SELECT run_id, builder, (row_number() OVER (PARTITION BY run_id, builder ORDER BY n) - 1)::INT AS seq, e.id AS episode_id,
    e.rev AS latest_revision, event_id, ingest_us AS arrival_us, e.dl AS revision_deadline_us, e.reason AS reason FROM late_rows""", norm=_STRETCHED))  # fmt: skip
def segment_late(f: Frames) -> DataFrame:
    """Late records of the same runs."""
    return segments.form_segments(stretched(f), which="late", chunk_events=CHUNK_EVENTS)


_LOOKED_BACK = {
    "keyed": "SELECT DISTINCT run_id, event_id, event_us, unnest(['e:' || subject, 'e:' || object, 'g:' || dependency_group]) AS key FROM norm",
    "looked": """SELECT *, lag(event_us) OVER w AS p_us, lag(event_id) OVER w AS p_id FROM keyed
        WINDOW w AS (PARTITION BY run_id, key ORDER BY event_us, event_id)""",
    "chained": """SELECT *, max(CASE WHEN p_us IS NULL OR event_us - p_us > 300000000 THEN event_us END)
        OVER (PARTITION BY run_id, key ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING) AS start_us FROM looked""",
    "offers": """SELECT run_id, event_id, event_us, p_us, p_id, count(*) AS keys, max((key LIKE 'g:%')::INT) AS kind, max(start_us) AS start_us
        FROM chained WHERE event_us - p_us <= 300000000 AND event_us - start_us <= 3600000000 GROUP BY ALL""",
}


@query(sql("""SELECT run_id, event_id, p_id AS candidate_id, event_us - p_us AS delta_us, event_us - start_us AS span_us, keys,
    CASE WHEN kind = 1 THEN 'group' ELSE 'entity' END AS shared
    FROM offers QUALIFY row_number() OVER (PARTITION BY run_id, event_id ORDER BY p_us DESC, p_id DESC) = 1""", "norm", steps=_LOOKED_BACK))  # fmt: skip
def candidate_search(f: Frames) -> DataFrame:
    """The nearest earlier event that shares an event's group or one of its entities, within the gap and the span."""
    return lookback.nearest_candidates(f.norm)


@query(sql("""SELECT l.run_id, l.event_id, candidate_id, array_to_string(list_filter([
        CASE WHEN s AND a.source_family <> b.source_family THEN 'endpoint_connection' END, CASE WHEN s AND a.ses AND b.ses THEN 'authenticated_session' END,
        CASE WHEN a.dependency_group = b.dependency_group THEN 'process_causal' END, CASE WHEN s THEN 'specific_entity' END], lambda x: x IS NOT NULL), ',') AS relations
    FROM (SELECT run_id, event_id, p_id AS candidate_id FROM offers QUALIFY row_number() OVER (PARTITION BY run_id, event_id ORDER BY p_us DESC, p_id DESC) = 1) l
    JOIN sides a ON a.event_id = l.event_id JOIN sides b ON b.event_id = candidate_id, LATERAL (SELECT a.subject IN (b.subject, b.object) OR a.object IN (b.subject, b.object) AS s)""",
    "norm", steps=_LOOKED_BACK | {"sides": "SELECT *, coalesce(command_family = 'remote_session', false) OR coalesce(protocol = 'ssh', false) AS ses FROM norm"}))
def candidate_relations(f: Frames) -> DataFrame:
    """The classes of relation between an event and its nearest candidate, be it of the same group or of a shared entity alone."""
    return lookback.relations(lookback.nearest_candidates(f.norm), f.norm)


# ---------------------------------------------------------------- determinism
#: Far above the number of events of a run.
_FAR = 1 << 40
#: How the events of a run are delivered: as they came (again and again), put in order again after a shuffle, or in another order.
MODES = ["control", "repeat_1", "resorted_1", "reverse", "edr_first", "seeded_shuffle_1", "seeded_shuffle_2"]
_DELIVERED = f"""SELECT b.* EXCLUDE (pos) REPLACE (b.run_id || '|' || m AS run_id), CASE WHEN m = 'reverse' THEN -pos
        WHEN m = 'edr_first' THEN pos + CASE WHEN source_family = 'EDR' THEN 0 ELSE {_FAR} END
        WHEN m = 'ndr_first' THEN pos + CASE WHEN source_family = 'NDR' THEN 0 ELSE {_FAR} END
        WHEN m LIKE 'seeded%' THEN ('0x' || substr(sha256(m || chr(31) || event_id), 1, 15))::BIGINT ELSE pos END AS arr
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ingest_us, event_us, source_instance, event_id) AS pos FROM base) b,
        (VALUES {", ".join(f"('{m}')" for m in MODES)}) AS v(m)"""
_MATRIX = """
    SELECT m AS mode, count(*) AS n_runs, count_if(d = c)::BIGINT AS n_equal, count_if(s = cs)::BIGINT AS n_same_episodes, sum(n)::BIGINT AS n_revisions FROM (
        SELECT *, first_value(d) OVER (PARTITION BY r ORDER BY m <> 'control') AS c, first_value(s) OVER (PARTITION BY r ORDER BY m <> 'control') AS cs FROM (
            SELECT split_part(run_id, '|', 1) AS r, split_part(run_id, '|', 2) AS m, count(*) AS n,
                sha256(string_agg(sha256('["' || array_to_string(ids, '","') || '"]'), ',' ORDER BY seq)) AS d,
                sha256(string_agg(DISTINCT sha256('["' || array_to_string(ids, '","') || '"]'), ',' ORDER BY sha256('["' || array_to_string(ids, '","') || '"]')) FILTER (state = 'closed')) AS s
            FROM formed GROUP BY run_id)) GROUP BY m"""


def delivered(f: Frames) -> DataFrame:
    """Every run in every mode, with arrival_seq. Rows of a mode are dealt out by a seed of its own before, so no mode owes anything to how they lie."""
    events = formation.formation_input(f.norm, f.aliases)
    placed = segments.positions(events)
    mode, pos = F.col("child"), F.col("pos")
    seeded = F.conv(F.substring(F.sha2(F.concat(mode, F.lit("\x1f"), F.col("event_id")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    behind = lambda family: pos + F.when(F.col("source_family") == family, 0).otherwise(_FAR)
    arrival = F.when(mode == "reverse", -pos).when(mode == "edr_first", behind("EDR")).when(mode == "ndr_first", behind("NDR")).when(mode.startswith("seeded"), seeded).otherwise(pos)
    rows = placed.withColumn("child", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return rows.withColumn("arrival_seq", arrival).drop("pos").repartition(F.xxhash64("child", "event_id"))


#: Not registered as SQL: out of their own order nothing can be let go in the recursive query, which takes minutes on whole tables. A test compares.
DETERMINISM_SQL = formed_sql(_MATRIX, norm=_DELIVERED, order="arr")


@query()
def determinism_matrix(f: Frames) -> DataFrame:
    """For each mode of delivery: how many runs form the very revisions of the control, in order, and how many end with the same closed episodes."""
    rows = sinks.materialize(formation.form_rolls(delivered(f), digests=True).select("run_id", "child", "seq", "state", "membership_digest"), "determinism")
    each = F.sort_array(F.collect_list(F.struct("seq", "membership_digest")))
    digests = rows.groupBy("run_id", "child").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(each, lambda x: x["membership_digest"]), ","), 256).alias("d"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "closed", F.col("membership_digest")))), ","), 256).alias("s"),
    )
    digests = sinks.materialize(digests, "determinism-digests")
    control = digests.filter("child = 'control'").select("run_id", F.col("d").alias("c"), F.col("s").alias("cs"))
    joined = digests.join(control, "run_id")
    return joined.groupBy(F.col("child").alias("mode")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("d") == F.col("c")).alias("n_equal"), F.count_if(F.col("s") == F.col("cs")).alias("n_same_episodes"), F.sum("n").alias("n_revisions"),
    )
