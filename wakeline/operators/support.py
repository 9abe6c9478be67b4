"""Source coverage at a point in time, family health, support decisions, sufficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.sources.adapters import COVERAGE_S, INSTANCES, SECOND

#: The worse a health, the higher its rank.
HEALTH_RANK = {"healthy": 0, "degraded": 1, "not_applicable": 2, "down": 3, "unknown": 4}


def coverage_at(points: DataFrame, coverage: DataFrame, point: str, scope: list[str]) -> DataFrame:
    """Every expected source of every point, with the record that covers it (start <= point < end) or nulls.

    Intervals have one width, so the interval's number is an equality key and the range test only confirms it.
    """
    expected = F.explode(F.array(*[F.struct(F.lit(f).alias("source_family"), F.lit(i).alias("source_instance")) for f, i, _ in INSTANCES]))
    asked = points.select(*scope, F.col(point).alias("point_us"), expected.alias("s")).select(*scope, "point_us", "s.*", F.floor(F.col("point_us") / (COVERAGE_S * SECOND)).alias("interval_no"))
    keys = ["run_id", "source_family", "source_instance", "interval_no"]
    joined = asked.alias("a").join(coverage.alias("c"), keys, "left")
    inside = (F.col("start_us") <= F.col("point_us")) & (F.col("point_us") < F.col("end_us"))
    return joined.select(*scope, "source_family", "source_instance", "point_us", *[F.when(inside, F.col(c)).alias(c) for c in ("start_us", "health", "parser_valid", "transport_live", "lag_s")])


def family_health(at_point: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope and family: worst health, all parsers valid, all transports live, largest lag; unknown where a source is missing."""
    rank = F.lit(None).cast("int")
    for name, r in HEALTH_RANK.items():
        rank = F.when(F.col("health") == name, r).otherwise(rank)
    agg = at_point.withColumn("rank", rank).groupBy(*scope, "source_family").agg(
        (F.count("health") < F.count(F.lit(1))).alias("missing"), F.max("rank").alias("rank"), F.bool_and("parser_valid").alias("parsers"), F.bool_and("transport_live").alias("transports"), F.max("lag_s").alias("lag"),
    )
    worst = F.lit("healthy")
    for name, r in HEALTH_RANK.items():
        worst = F.when(F.col("rank") == r, name).otherwise(worst)
    gone = F.col("missing")
    return agg.select(*scope, "source_family", "missing", F.when(gone, "unknown").otherwise(worst).alias("health"), (~gone & F.coalesce("parsers", F.lit(False))).alias("parser_valid"), (~gone & F.coalesce("transports", F.lit(False))).alias("transport_live"), F.coalesce("lag", F.lit(0.0)).alias("lag_s"))


def detector_state(missing: Column, health: Column, parser_valid: Column, transport_live: Column, observation: Column) -> Column:
    return (
        F.when(missing, "unknown")
        .when(health.isin("down", "not_applicable") | ~transport_live, "collector_unavailable")
        .when(~parser_valid, "parser_invalid")
        .when((health == "unknown") | (observation == "not_examined"), "unknown")
        .when(observation == "detected", "available")
        .when(observation == "examined_none", "no_detection")
        .otherwise("unknown")
    )


def both_families(health: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope, the two families side by side as e_ and n_ columns."""
    out = []
    for prefix, family in (("e", "EDR"), ("n", "NDR")):
        out += [F.first(F.when(F.col("source_family") == family, F.col(c)), ignorenulls=True).alias(f"{prefix}_{c}") for c in ("missing", "health", "parser_valid", "transport_live")]
    return health.groupBy(*scope).agg(*out)


def observed(rows: DataFrame) -> DataFrame:
    """Adds mask and observation of each family, from both_families' columns and what was detected."""
    for prefix, family in (("e", "edr"), ("n", "ndr")):
        seen = (~F.col(f"{prefix}_missing")).cast("int")
        rows = rows.withColumn(f"{family}_mask", seen).withColumn(f"{family}_observation", F.when(seen == 0, "not_examined").when(F.col(f"{family}_detected") == 1, "detected").otherwise("examined_none"))
    return rows


def lateness() -> Column:
    return F.when(F.col("late_evidence_reason") == "accepted_within_horizon", "late_accepted").when(F.col("state").isin("open", "finalized"), "revisable").otherwise("stable")


def decide_support(rows: DataFrame, versions_match: Column | None = None, calibrated: Column | None = None, group: Column | None = None) -> DataFrame:
    """Adds reason and kappa, by order of precedence. rows: eligible_count, masks, observations, and both_families' columns.

    versions_match: do the versions in use fit; calibrated: is there a fitted calibrator; group: the enabled calibration group, or null.
    """
    versions_match, calibrated = F.lit(True) if versions_match is None else versions_match, F.lit(True) if calibrated is None else calibrated
    group = F.lit(None).cast("string") if group is None else group
    masked = (F.col("edr_mask") != 1) | (F.col("ndr_mask") != 1)
    bad = F.col("e_health").isin("down", "unknown", "not_applicable") | F.col("n_health").isin("down", "unknown", "not_applicable") | F.col("e_missing") | F.col("n_missing")
    states = [detector_state(F.col(f"{p}_missing"), F.col(f"{p}_health"), F.col(f"{p}_parser_valid"), F.col(f"{p}_transport_live"), F.col(f"{f}_observation")) for p, f in (("e", "edr"), ("n", "ndr"))]
    reason = (
        F.when(F.col("eligible_count") == 0, "no_eligible_detector_value")
        .when(~versions_match, "version_out_of_support")
        .when(masked, "source_out_of_support")
        .when(~F.col("e_parser_valid") | ~F.col("n_parser_valid"), "parser_out_of_support")
        .when(bad, "source_out_of_support")
        .when(~calibrated, "calibration_out_of_support")
        .when(states[0].isin("unknown", "collector_unavailable") | states[1].isin("unknown", "collector_unavailable"), "source_out_of_support")
        .when((states[0] == "parser_invalid") | (states[1] == "parser_invalid"), "parser_out_of_support")
        .otherwise("eligible")
    )
    return rows.withColumn("reason", reason).withColumn("kappa", F.when(F.col("reason") != "eligible", "out_of_support").when(group.isNotNull(), "supported_group").otherwise("supported_global"))


def sufficiency_coverage() -> Column:
    unknown = (F.col("e_health") == "unknown") | (F.col("n_health") == "unknown")
    off = F.col("e_health").isin("down", "not_applicable") | F.col("n_health").isin("down", "not_applicable") | ~F.col("e_parser_valid") | ~F.col("n_parser_valid")
    return F.when(unknown, "unknown").when(off, "unavailable").when((F.col("e_health") == "degraded") | (F.col("n_health") == "degraded"), "degraded").otherwise("complete")


def contradiction(members: DataFrame, scope: list[str]) -> DataFrame:
    """present if an endpoint has two hosts or a process two parents; else unevaluable if any part is missing; else none."""
    keys = _facts(members, scope).groupBy(*scope, "key").agg(F.countDistinct("value").alias("kinds"), (F.count("value") < F.count(F.lit(1))).alias("gaps"))
    return keys.groupBy(*scope).agg(F.when(F.max("kinds") > 1, "present").when(F.bool_or("gaps"), "unevaluable").otherwise("none").alias("contradiction"))


def _facts(members: DataFrame, keep: list[str]) -> DataFrame:
    """key, value: where an endpoint lies, and which parent a process has."""
    return members.select(*keep, F.inline(F.array(
        F.struct(F.concat(F.lit("endpoint|"), F.col("endpoint_key")).alias("key"), F.col("endpoint_host").alias("value")),
        F.struct(F.when(F.col("source_family") == "EDR", F.concat(F.lit("process|"), F.col("dependency_group"))).alias("key"), F.col("parent_pid").alias("value")),
    ))).filter("key IS NOT NULL")


def contradiction_since(members: DataFrame, scope: list[str]) -> DataFrame:
    """contradiction of scopes that only grow: members have since, the moment from which they belong. Per scope the moments from which there is a fact
    (fact_since), a part is missing (gap_since) and a key has a second value (clash_since); null if never."""
    firsts = _facts(members, [*scope, "since"]).groupBy(*scope, "key", "value").agg(F.min("since").alias("since"))
    known = F.col("value").isNotNull()
    keys = firsts.groupBy(*scope, "key").agg(F.min("since").alias("fact"), F.min(F.when(~known, F.col("since"))).alias("gap"), F.get(F.array_sort(F.collect_list(F.when(known, F.col("since")))), F.lit(1)).alias("clash"))
    return keys.groupBy(*scope).agg(*[F.min(c).alias(f"{c}_since") for c in ("fact", "gap", "clash")])


def contradiction_at(moment: str) -> Column:
    """What contradiction says at a moment, from the columns of contradiction_since; null before the first fact."""
    m = F.col(moment)
    return F.when(F.col("clash_since") <= m, "present").when(F.col("gap_since") <= m, "unevaluable").when(F.col("fact_since") <= m, "none")
