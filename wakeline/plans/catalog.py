"""The registered queries over the operators, and for each that SQL can express, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions import hashing
from wakeline.operators import builders, detectors, evaluation, formation, lookback, replay, stats, support
from wakeline.plans.ctes import formed_sql, sql
from wakeline.plans.formed import terminal
from wakeline.plans.frames import EPISODE, Frames
from wakeline.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of Frames under its name, with its SQL."""

    def add(f: Callable[[Frames], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def r9(c) -> F.Column:
    return F.round(c, 9)


# ---------------------------------------------------------------- scans, projections, filters
@query(sql("SELECT * FROM norm", "norm"))
def norm_events(f: Frames) -> DataFrame:
    return f.norm


@query(sql("SELECT * FROM cov", "cov"))
def coverage_intervals(f: Frames) -> DataFrame:
    return f.coverage


@query(sql("SELECT run_id, group_id, start_us, end_us, entity, array_to_string(required_tokens, ',') AS tokens FROM truth", "truth"))
def truth_groups(f: Frames) -> DataFrame:
    return f.truth.select("run_id", "group_id", "start_us", "end_us", "entity", F.array_join("required_tokens", ",").alias("tokens"))


@query(sql("""SELECT event_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(object, '^[A-Za-z0-9._:-]+$') THEN 'identifier' END,
    CASE WHEN ingest_us - event_us > 1000000000 THEN 'late' END, CASE WHEN severity > 0.9 THEN 'severity' END, CASE WHEN endpoint_host IS NULL THEN 'endpoint_host' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM norm WHERE ingest_us - event_us > 1000000000 OR severity > 0.9 OR endpoint_host IS NULL OR NOT regexp_matches(object, '^[A-Za-z0-9._:-]+$')""", "norm"))  # fmt: skip
def contract_violations(f: Frames) -> DataFrame:
    rules = [("identifier", ~F.col("object").rlike("^[A-Za-z0-9._:-]+$")), ("late", F.col("ingest_us") - F.col("event_us") > 1_000_000_000), ("severity", F.col("severity") > 0.9), ("endpoint_host", F.col("endpoint_host").isNull())]
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))
    return f.norm.select("event_id", found.alias("v")).filter(F.size("v") > 0).select("event_id", F.array_join("v", ",").alias("violations"))


#: Keys that must never reach the online side.
FORBIDDEN = ["run_id", "card_id", "scenario_id", "scenario_class", "ability_id", "operation_id", "caldera_run_id", "campaign_id", "adversary_id", "adversary_profile", "receipt_id", "marker", "marker_id", "label", "malicious_label", "split", "partition", "attack_window"]


@query("""SELECT event_id, 'attributes.' || key AS path, key FROM (SELECT event_id, unnest(CASE WHEN (props->>'$.k')::INT % 10 = 0 THEN ['k', 'Marker'] WHEN (props->>'$.k')::INT % 10 = 1 THEN ['k', 'label'] ELSE ['k'] END) AS key FROM events) WHERE lower(key) IN ('marker', 'label')""")
def firewall_keys(f: Frames) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    attributes = F.when(k % 10 == 0, F.create_map(F.lit("k"), k, F.lit("Marker"), k)).when(k % 10 == 1, F.create_map(F.lit("k"), k, F.lit("label"), k)).otherwise(F.create_map(F.lit("k"), k))
    rows = f.table("events").select("event_id", F.explode(F.map_keys(attributes)).alias("key"))
    return rows.filter(F.lower("key").isin(FORBIDDEN)).select("event_id", F.concat(F.lit("attributes."), F.col("key")).alias("path"), "key")


@query(sql("SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ingest_us, event_us, source_instance, event_id) - 1 AS arrival_seq FROM norm", "norm"))
def arrival_order(f: Frames) -> DataFrame:
    return replay.arrival(f.norm).select("run_id", "event_id", "arrival_seq")


@query(sql("""SELECT event_id, coalesce(a.entity, subject) AS subject, coalesce(b.entity, object) AS object FROM norm
    LEFT JOIN (SELECT DISTINCT subject AS alias, endpoint_key AS entity FROM norm WHERE subject LIKE 'ip:10.%') a ON a.alias = subject
    LEFT JOIN (SELECT DISTINCT subject AS alias, endpoint_key AS entity FROM norm WHERE subject LIKE 'ip:10.%') b ON b.alias = object""", "norm"))  # fmt: skip
def alias_projection(f: Frames) -> DataFrame:
    return formation.formation_input(f.norm, f.aliases).select("event_id", "subject", "object")


@query(sql("SELECT source_family, event_id FROM norm WHERE regexp_matches(subject, '^[^:]*:10[.]') AND regexp_matches(object, '^[^:]*:192[.]168[.]')", "norm"))
def private_pairs(f: Frames) -> DataFrame:
    return f.norm.filter(detectors.is_private(F.col("subject")) & detectors.is_private(F.col("object"))).select("source_family", "event_id")


@query(sql("SELECT source_family, action, count(*) AS n FROM norm GROUP BY ALL", "norm"))
def family_action_counts(f: Frames) -> DataFrame:
    return f.norm.groupBy("source_family", "action").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- episode builders
@query(sql("SELECT b.*, 'baseline:EB1:' || b.episode_no AS episode_id FROM bounds b", "bounds"))
def fixed_bin_episodes(f: Frames) -> DataFrame:
    return f.bounds.withColumn("episode_id", F.concat(F.lit("baseline:EB1:"), F.col("episode_no").cast("string")))


@query(sql("""SELECT run_id, session_no, min(event_us) AS start_us, max(event_us) AS end_us, count(*) AS n_events FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (
        SELECT *, coalesce((event_us - lag(event_us) OVER (PARTITION BY run_id ORDER BY event_us, event_id) > 300000000)::INT, 0) AS fresh FROM norm)) GROUP BY ALL""", "norm"))  # fmt: skip
def sliding_sessions(f: Frames) -> DataFrame:
    return builders.episode_bounds(builders.sliding_sessions(f.norm), ["run_id", "session_no"])


@query(sql("""SELECT run_id, episode_no, event_id, component FROM (
    WITH RECURSIVE ent AS (SELECT DISTINCT run_id, episode_no, event_id, unnest([subject, object]) AS entity FROM members),
    link AS (SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM ent a JOIN ent b USING (run_id, episode_no, entity)),
    reach AS (SELECT event_id AS a, event_id AS b FROM members UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT m.run_id, m.episode_no, m.event_id, min(r.b) AS component FROM members m JOIN reach r ON r.a = m.event_id GROUP BY ALL)""", "members"))  # fmt: skip
def entity_components(f: Frames) -> DataFrame:
    members = sinks.materialize(f.members.select(*EPISODE, "event_id", "subject", "object"), "members")
    return builders.entity_components(members, EPISODE)


def hub_entities(norm: DataFrame) -> DataFrame:
    """Each event's entities, with how many dependency groups touched the entity in the 600 s up to the event."""
    seen = norm.select("run_id", "event_id", "event_us", "dependency_group", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    counted = lookback.trailing_distinct(seen, ["run_id", "entity"], "dependency_group", "event_us", 600 * 1_000_000, "n_groups")
    return counted.select("run_id", "event_id", "entity", "n_groups")


@query(sql("""WITH ent AS (SELECT DISTINCT run_id, event_id, event_us, dependency_group, unnest([subject, object]) AS entity FROM norm)
    SELECT a.run_id, a.event_id, a.entity, count(DISTINCT b.dependency_group)::INT AS n_groups FROM ent a JOIN ent b
    ON a.run_id = b.run_id AND a.entity = b.entity AND b.event_us BETWEEN a.event_us - 600000000 AND a.event_us GROUP BY ALL""", "norm").replace("\nWITH ent", ",\nent"))  # fmt: skip
def hub_counts(f: Frames) -> DataFrame:
    return hub_entities(f.norm)


def band_links(norm: DataFrame, gap_s: int = 300) -> DataFrame:
    """Pairs of a run's events on one dependency group within the gap. Events are filed in bins of the gap's width and meet their own and the last bin."""
    gap = gap_s * 1_000_000
    e = norm.select("run_id", "dependency_group", "event_id", "event_us", F.floor(F.col("event_us") / gap).alias("bin"))
    left = e.select("run_id", "dependency_group", F.col("event_id").alias("first_id"), F.col("event_us").alias("t1"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = e.select("run_id", "dependency_group", F.col("event_id").alias("second_id"), F.col("event_us").alias("t2"), "bin")
    pairs = left.join(right, ["run_id", "dependency_group", "bin"])
    before = (F.col("t1") < F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("first_id") < F.col("second_id")))
    return pairs.filter(before & (F.col("t2") - F.col("t1") <= gap)).select("run_id", "dependency_group", "first_id", "second_id", (F.col("t2") - F.col("t1")).alias("delta_us"))


@query(sql("""SELECT a.run_id, a.dependency_group, a.event_id AS first_id, b.event_id AS second_id, b.event_us - a.event_us AS delta_us FROM norm a JOIN norm b
    ON a.run_id = b.run_id AND a.dependency_group = b.dependency_group AND (a.event_us, a.event_id) < (b.event_us, b.event_id) AND b.event_us - a.event_us <= 300000000""", "norm"))  # fmt: skip
def link_band_join(f: Frames) -> DataFrame:
    return band_links(f.norm)


# ---------------------------------------------------------------- formation
def _formed(f: Frames, names: list[str] | None = None) -> DataFrame:
    return formation.form_episodes(formation.formation_input(f.norm, f.aliases), names)


def _flat(rows: DataFrame) -> DataFrame:
    for c in ("ordered_event_ids", "ordered_link_reasons", "parent_episode_ids"):
        rows = rows.withColumn(c, F.array_join(c, ","))
    return rows


_REVISION = """run_id, builder, seq, episode_id, revision, state, array_to_string(ids, ',') AS ordered_event_ids, array_to_string(reasons, ',') AS ordered_link_reasons, array_to_string(parents, ',') AS parent_episode_ids, predecessor_revision,
    late_evidence_reason, first_finalized_us, revision_deadline_us, event_us_start, event_us_end, watermark_us, sha256('["' || array_to_string(ids, '","') || '"]') AS membership_digest"""
_ALL = tuple(formation.BUILDERS)


@query(formed_sql(f"SELECT {_REVISION} FROM formed"))
def formation_revisions(f: Frames) -> DataFrame:
    return _flat(_formed(f))


@query(formed_sql("""SELECT run_id, builder, (row_number() OVER (PARTITION BY run_id, builder ORDER BY n) - 1)::INT AS seq, e.id AS episode_id, e.rev AS latest_revision, event_id, ingest_us AS arrival_us, e.dl AS revision_deadline_us, e.reason AS reason
    FROM late_rows"""))
def formation_late(f: Frames) -> DataFrame:
    return formation.late_records(formation.formation_input(f.norm, f.aliases))


@query(formed_sql("SELECT run_id, builder, (row_number() OVER (PARTITION BY run_id, builder ORDER BY n) - 1)::INT AS seq, event_id, 'late_successor_disabled' AS reason FROM late_rows WHERE e.reason = 'rejected'", builders=("reject_late",)))
def formation_rejected(f: Frames) -> DataFrame:
    """Events that a builder without late successors takes no notice of."""
    return formation.rejected_events(formation.formation_input(f.norm, f.aliases), ["reject_late"])


@query(formed_sql("SELECT builder, run_id, count(*) AS n_revisions, count(DISTINCT episode_id) AS n_episodes, max(len(ids))::INT AS largest, count(late_evidence_reason) AS n_late FROM formed GROUP BY builder, run_id", builders=_ALL))
def formation_builders(f: Frames) -> DataFrame:
    rows = formation.form_rolls(formation.formation_input(f.norm, f.aliases), list(formation.BUILDERS))
    return rows.groupBy("builder", "run_id").agg(F.count(F.lit(1)).alias("n_revisions"), F.count_if(F.col("revision") == 0).alias("n_episodes"), F.max("n_events").cast("int").alias("largest"), F.count("late_evidence_reason").alias("n_late"))


@query(formed_sql(f"SELECT {_REVISION} FROM terminal"))
def terminal_views(f: Frames) -> DataFrame:
    return _flat(terminal(_formed(f)))


# ---------------------------------------------------------------- detectors and features
@query(sql("SELECT run_id, episode_no, event_id, detector_id, dependency_group, value FROM det", "det"))
def detector_values(f: Frames) -> DataFrame:
    return detectors.detector_values(f.members).select(*EPISODE, "event_id", "detector_id", "dependency_group", "value")


@query(sql("SELECT * FROM dedup", "dedup"))
def detector_dedup(f: Frames) -> DataFrame:
    return f.dedup


@query(sql("SELECT run_id, episode_no, detector_id, dependency_group, round(normalized, 9) AS normalized FROM ecdf", "ecdf"))
def ecdf_normalize(f: Frames) -> DataFrame:
    return f.ecdf.select(*EPISODE, "detector_id", "dependency_group", r9("normalized").alias("normalized"))


@query(sql("SELECT run_id, episode_no, round(d, 9) AS d, c, eligible_count, edr_detected, ndr_detected FROM feat", "feat"))
def feature_vectors(f: Frames) -> DataFrame:
    return f.features.withColumn("d", r9("d"))


@query(sql("SELECT run_id, episode_no, round(-2.0::DOUBLE + 3.0::DOUBLE * d + c, 9) AS z FROM feat", "feat"))
def raw_logit(f: Frames) -> DataFrame:
    return f.features.select(*EPISODE, r9(detectors.logit(F.col("d"), F.col("c"))).alias("z"))


# ---------------------------------------------------------------- support and sufficiency
@query(sql("SELECT run_id, episode_no, source_family, source_instance, point_us, start_us, health, lag_s FROM at_end", "at_end"))
def coverage_point_join(f: Frames) -> DataFrame:
    return f.at_end.select(*EPISODE, "source_family", "source_instance", "point_us", "start_us", "health", "lag_s")


@query(sql("SELECT * FROM health", "health"))
def family_health(f: Frames) -> DataFrame:
    return f.health


@query(sql("SELECT run_id, episode_no, reason, kappa FROM support", "support"))
def support_decision(f: Frames) -> DataFrame:
    return f.supported.select(*EPISODE, "reason", "kappa")


@query(sql("SELECT run_id, episode_no, CASE WHEN reason = 'eligible' THEN round(1 / (1 + exp(-(1.2::DOUBLE * (-2.0::DOUBLE + 3.0::DOUBLE * d + c) - 0.1::DOUBLE))), 9) END AS p FROM support", "support"))
def calibrated_p(f: Frames) -> DataFrame:
    z = detectors.logit(F.col("d"), F.col("c"))
    return f.supported.select(*EPISODE, F.when(F.col("reason") == "eligible", r9(detectors.sigmoid(1.2 * z - 0.1))).alias("p"))


@query(sql("""SELECT run_id, episode_no, CASE WHEN e_health = 'unknown' OR n_health = 'unknown' THEN 'unknown'
    WHEN e_health IN ('down', 'not_applicable') OR n_health IN ('down', 'not_applicable') OR NOT e_parser_valid OR NOT n_parser_valid THEN 'unavailable'
    WHEN e_health = 'degraded' OR n_health = 'degraded' THEN 'degraded' ELSE 'complete' END AS coverage,
    CASE WHEN e_missing OR n_missing THEN 'missing' ELSE 'complete' END AS provenance, contradiction, kappa AS calibration FROM support JOIN contra USING (run_id, episode_no)""", "support", "contra"))  # fmt: skip
def sufficiency_u(f: Frames) -> DataFrame:
    rows = f.supported.join(support.contradiction(f.members, EPISODE), EPISODE)
    provenance = F.when(F.col("e_missing") | F.col("n_missing"), "missing").otherwise("complete")
    return rows.select(*EPISODE, support.sufficiency_coverage().alias("coverage"), provenance.alias("provenance"), "contradiction", F.col("kappa").alias("calibration"))


@query(sql("SELECT * FROM contra", "contra"))
def contradiction(f: Frames) -> DataFrame:
    return support.contradiction(f.members, EPISODE)


# ---------------------------------------------------------------- assembly and storage
@query(sql("""SELECT run_id, episode_no, string_agg(ref, '|' ORDER BY rank, grp, ref) AS refs, count(*) AS n_refs FROM (
    SELECT run_id, episode_no, 0 AS rank, dependency_group AS grp, 'object:' || event_id AS ref FROM members
    UNION ALL SELECT run_id, episode_no, 1, 'coverage:' || source_instance, CASE WHEN health IS NULL THEN 'sentinel:not_observed' ELSE 'object:' || start_us END FROM at_end) GROUP BY ALL""", "members", "at_end"))  # fmt: skip
def evidence_references(f: Frames) -> DataFrame:
    own = f.members.select(*EPISODE, F.lit(0).alias("rank"), F.col("dependency_group").alias("grp"), F.concat(F.lit("object:"), F.col("event_id")).alias("ref"))
    health = f.at_end.select(*EPISODE, F.lit(1).alias("rank"), F.concat(F.lit("coverage:"), F.col("source_instance")).alias("grp"), F.when(F.col("health").isNull(), "sentinel:not_observed").otherwise(F.concat(F.lit("object:"), F.col("start_us").cast("string"))).alias("ref"))
    refs = own.unionByName(health).groupBy(*EPISODE).agg(F.array_sort(F.collect_list(F.struct("rank", "grp", "ref"))).alias("r"))
    return refs.select(*EPISODE, F.array_join(F.transform("r", lambda x: x["ref"]), "|").alias("refs"), F.size("r").cast("long").alias("n_refs"))


@query(sql("""SELECT run_id, episode_no, sha256('["' || string_agg(event_id, '","' ORDER BY event_us, ingest_us, source_instance, event_id) || '"]') AS membership_digest FROM members GROUP BY ALL""", "members"))
def membership_digest(f: Frames) -> DataFrame:
    rows = f.members.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(F.struct("event_us", "ingest_us", "source_instance", "event_id"))).alias("m"))
    return rows.select(*EPISODE, hashing.sha256_text(hashing.id_list_json(F.transform("m", lambda x: x["event_id"]))).alias("membership_digest"))


@query(sql("""SELECT run_id, episode_no, CASE WHEN e_missing OR n_missing THEN 'failure' ELSE 'audit' END AS outcome, CASE WHEN e_missing OR n_missing THEN 'missing_input' END AS failure_code FROM support""", "support"))
def terminal_outcomes(f: Frames) -> DataFrame:
    gone = F.col("e_missing") | F.col("n_missing")
    return f.supported.select(*EPISODE, F.when(gone, "failure").otherwise("audit").alias("outcome"), F.when(gone, "missing_input").alias("failure_code"))


@query(sql("""SELECT event_id, CASE WHEN event_id = first_id THEN 'stored' WHEN action = first_action THEN 'idempotent' ELSE 'rejected' END AS outcome FROM (
    SELECT event_id, action, first_value(event_id) OVER w AS first_id, first_value(action) OVER w AS first_action FROM norm WINDOW w AS (PARTITION BY run_id, dependency_group ORDER BY event_us, event_id))""", "norm"))  # fmt: skip
def append_only_store(f: Frames) -> DataFrame:
    return sinks.terminal_store(f.norm.select("run_id", "dependency_group", "event_us", "event_id", "action"), ["run_id", "dependency_group"], ["event_us", "event_id"], "action").select("event_id", "outcome")


@query(sql("""SELECT event_id, CASE WHEN endpoint_host IS NULL THEN 'schema_reject' WHEN k % 7 = 3 THEN 'digest_reject' ELSE 'accept' END AS gate FROM norm""", "norm"))
def canonical_gate(f: Frames) -> DataFrame:
    """A record is rejected for a missing field first, then for a digest that its content does not give."""
    content = F.concat_ws("|", "event_id", "action")
    stored = F.when(F.col("k") % 7 == 3, hashing.sha256_text(F.concat(content, F.lit("!")))).otherwise(hashing.sha256_text(content))
    rows = f.norm.select("event_id", "endpoint_host", content.alias("content"), stored.alias("digest"))
    return rows.select("event_id", F.when(F.col("endpoint_host").isNull(), "schema_reject").when(hashing.sha256_text(F.col("content")) != F.col("digest"), "digest_reject").otherwise("accept").alias("gate"))


@query("""SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.missing') IS NOT NULL AS has_missing, (props->>'$.k')::DOUBLE = 7 AS k_is_seven FROM events""")
def json_pointer_checks(f: Frames) -> DataFrame:
    v = F.parse_json("props")
    return f.table("events").select("event_id", F.try_variant_get(v, "$.k", "long").isNotNull().alias("has_k"), F.try_variant_get(v, "$.missing", "string").isNotNull().alias("has_missing"), (F.abs(F.try_variant_get(v, "$.k", "double") - 7) <= 1e-12).alias("k_is_seven"))


# ---------------------------------------------------------------- evaluation against truth
@query(sql("SELECT run_id, episode_no, group_id, round(coverage, 9) AS coverage, round(jaccard, 9) AS jaccard, round(iou, 9) AS iou, round(weight, 9) AS weight FROM edges", "edges"))
def match_edges(f: Frames) -> DataFrame:
    return f.edges.drop("attack", "apart_us").withColumns({c: r9(c) for c in ("coverage", "jaccard", "iou", "weight")})


@query(sql("SELECT run_id, episode_no, group_id, round(coverage, 9) AS coverage, round(contamination, 9) AS contamination, label FROM labelled", "labelled"))
def episode_labels(f: Frames) -> DataFrame:
    return f.labelled.withColumns({c: r9(c) for c in ("coverage", "contamination")})


@query(sql("""SELECT e.run_id, n_episodes, coalesce(n_groups, 0) AS n_groups, round(coverage, 9) AS coverage, round(fragmentation, 9) AS fragmentation, round(over_merge, 9) AS over_merge, round(contamination, 9) AS contamination FROM (
        SELECT run_id, count(*) AS n_episodes, avg((coalesce(degree, 0) > 1)::INT) AS over_merge, avg(CASE WHEN either > 0 THEN len(benign) / either END) AS contamination
        FROM matched LEFT JOIN (SELECT run_id, episode_no, count(*) AS degree FROM edges GROUP BY ALL) USING (run_id, episode_no) GROUP BY run_id) e
    LEFT JOIN (SELECT run_id, count(*) AS n_groups, avg(coalesce(coverage, 0)) AS coverage, avg(greatest(coalesce(degree, 0) - 1, 0)) AS fragmentation
        FROM truth LEFT JOIN (SELECT run_id, group_id, max(coverage) AS coverage, count(*) AS degree FROM edges GROUP BY ALL) USING (run_id, group_id) GROUP BY run_id) g USING (run_id)""", "matched", "truth", "edges"))  # fmt: skip
def formation_metrics(f: Frames) -> DataFrame:
    rows = evaluation.formation_metrics(f.views, f.truth, f.edges)
    return rows.withColumns({c: r9(c) for c in ("coverage", "fragmentation", "over_merge", "contamination")})


@query()
def assignment(f: Frames) -> DataFrame:
    return evaluation.assignment(f.edges).drop("attack")


@query(sql("""SELECT count(*) AS n_episodes, count_if(reason = 'eligible')::BIGINT AS n_eligible, count_if(label IN ('positive', 'negative'))::BIGINT AS n_binary, count_if(label = 'mixed')::BIGINT AS n_mixed, count_if(label = 'ambiguous')::BIGINT AS n_ambiguous,
    count_if(reason = 'eligible' AND label IN ('positive', 'negative'))::BIGINT AS n_decided, round(count_if(reason = 'eligible') / count(*), 9) AS eligible_rate FROM support JOIN labelled USING (run_id, episode_no)""", "support", "labelled"))  # fmt: skip
def rt1_population(f: Frames) -> DataFrame:
    rows = f.supported.join(f.labelled.select(*EPISODE, "label"), EPISODE)
    fit, binary = F.col("reason") == "eligible", F.col("label").isin("positive", "negative")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n_episodes"), F.count_if(fit).alias("n_eligible"), F.count_if(binary).alias("n_binary"), F.count_if(F.col("label") == "mixed").alias("n_mixed"), F.count_if(F.col("label") == "ambiguous").alias("n_ambiguous"), F.count_if(fit & binary).alias("n_decided"), r9(F.try_divide(F.count_if(fit), n)).alias("eligible_rate"))


@query(sql("""SELECT j AS jaccard, i AS iou, w AS weight, count(*) AS n_edges, count(DISTINCT run_id || episode_no) AS n_episodes FROM weighed, (VALUES (0.2, 0.02, 0.3), (0.2, 0.01, 0.3), (0.2, 0.05, 0.3), (0.1, 0.02, 0.3), (0.5, 0.02, 0.3), (0.2, 0.02, 0.2), (0.2, 0.02, 0.4)) AS g(j, i, w)
    WHERE weighed.jaccard >= j::DOUBLE AND weighed.iou >= i::DOUBLE AND weighed.weight >= w::DOUBLE GROUP BY ALL""".replace("SELECT j AS jaccard, i AS iou, w AS weight", "SELECT j::DOUBLE AS jaccard, i::DOUBLE AS iou, w::DOUBLE AS weight"), "weighed"))  # fmt: skip
def sensitivity_grid(f: Frames) -> DataFrame:
    """Edges are formed once at the loosest setting; each edge then counts for every setting that it meets."""
    grid = [(0.2, 0.02, 0.3), (0.2, 0.01, 0.3), (0.2, 0.05, 0.3), (0.1, 0.02, 0.3), (0.5, 0.02, 0.3), (0.2, 0.02, 0.2), (0.2, 0.02, 0.4)]
    edges = evaluation.match_edges(f.views, f.truth, 0.0, 0.0, 0.0)
    meets = F.array_compact(F.array(*[F.when((F.col("jaccard") >= j) & (F.col("iou") >= i) & (F.col("weight") >= w), F.struct(F.lit(j).alias("gj"), F.lit(i).alias("gi"), F.lit(w).alias("gw"))) for j, i, w in grid]))
    rows = edges.select(*EPISODE, F.inline(meets))
    return rows.groupBy(F.col("gj").alias("jaccard"), F.col("gi").alias("iou"), F.col("gw").alias("weight")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("run_id", "episode_no").alias("n_episodes"))


# ---------------------------------------------------------------- ranking and calibration
@query(sql("""SELECT grp, n AS n_rows, round(sum(label) FILTER (pos <= greatest(1, ceil(n * 0.1::DOUBLE))) / nullif(p_all, 0), 9) AS recall_at_budget, round(sum(label) FILTER (pos <= 10) / least(n, 10), 9) AS precision_at_k FROM (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS pos, count(*) OVER (PARTITION BY grp) AS n, sum(label) OVER (PARTITION BY grp) AS p_all FROM scored) GROUP BY grp, n, p_all""", "scored"))  # fmt: skip
def rank_metrics(f: Frames) -> DataFrame:
    return evaluation.rank_metrics(f.scored, ["grp"], "doc_id").withColumns({c: r9(c) for c in ("recall_at_budget", "precision_at_k")})


@query(sql("""SELECT g.grp, round(w / nullif(p * q, 0), 9) AS auroc FROM (SELECT grp, sum(label) AS p, count(*) - sum(label) AS q FROM scored GROUP BY grp) g
    LEFT JOIN (SELECT a.grp, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) AS w FROM scored a JOIN scored b ON a.grp = b.grp AND a.label = 1 AND b.label = 0 GROUP BY a.grp) x ON x.grp = g.grp""", "scored"))  # fmt: skip
def auroc(f: Frames) -> DataFrame:
    return evaluation.auroc(f.scored, ["grp"]).withColumn("auroc", r9("auroc"))


@query(sql("""SELECT grp, round(avg(hits / pos) FILTER (label = 1), 9) AS average_precision FROM (SELECT *, row_number() OVER w AS pos, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM scored WINDOW w AS (PARTITION BY grp ORDER BY score DESC, doc_id)) GROUP BY grp""", "scored"))
def average_precision(f: Frames) -> DataFrame:
    return evaluation.average_precision(f.scored, ["grp"], "doc_id").withColumn("average_precision", r9("average_precision"))


@query(sql("""SELECT grp, count(*) AS n, round(avg((p - label) * (p - label)), 9) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 9) AS nll FROM (SELECT *, least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM scored) GROUP BY grp""", "scored"))
def calibration_metrics(f: Frames) -> DataFrame:
    return evaluation.calibration_metrics(f.scored, ["grp"]).withColumns({c: r9(c) for c in ("brier", "nll")})


@query(sql("""SELECT grp, (CASE WHEN p >= 0.9::DOUBLE THEN 9 WHEN p >= 0.8::DOUBLE THEN 8 WHEN p >= 0.7::DOUBLE THEN 7 WHEN p >= 0.6::DOUBLE THEN 6 WHEN p >= 0.5::DOUBLE THEN 5 WHEN p >= 0.4::DOUBLE THEN 4 WHEN p >= 0.3::DOUBLE THEN 3 WHEN p >= 0.2::DOUBLE THEN 2 WHEN p >= 0.1::DOUBLE THEN 1 ELSE 0 END)::INT AS bin,
    count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(label), 9) AS rate FROM scored GROUP BY ALL""", "scored"))  # fmt: skip
def reliability_bins(f: Frames) -> DataFrame:
    return evaluation.reliability_bins(f.scored, ["grp"]).withColumns({c: r9(c) for c in ("mean_p", "rate")})


@query(sql("""SELECT category, count(*) AS n, arg_min(doc_id, (-score, doc_id)) AS example FROM (SELECT *, CASE WHEN label = 0 AND p >= 0.5 THEN 'false_positive' WHEN label = 1 AND p < 0.5 THEN 'false_negative' WHEN label = 1 THEN 'true_positive' ELSE 'true_negative' END AS category FROM scored) GROUP BY category""", "scored"))
def rt7_errors(f: Frames) -> DataFrame:
    y, high = F.col("label") == 1, F.col("p") >= 0.5
    kind = F.when(~y & high, "false_positive").when(y & ~high, "false_negative").when(y, "true_positive").otherwise("true_negative")
    rows = f.scored.withColumn("category", kind).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("doc_id"))).alias("e"))
    return rows.select("category", "n", F.col("e.doc_id").alias("example"))
