"""Further registered queries: injections, store variants, recovery reports, percentiles, outage plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import evaluation, formation, replay, selection
from wakeline.plans.catalog import query, r9
from wakeline.plans.ctes import formed_sql, sql
from wakeline.plans.frames import EPISODE, Frames

SECOND = 1_000_000


@query(sql("""SELECT run_id, cell_id, source_family, duration_s, repetition_index, card_id FROM (SELECT DISTINCT run_id, substr(run_id, 5)::INT % 40 AS i FROM norm) JOIN (
    SELECT i, s AS source_family, d AS duration_s, rep AS repetition_index, card AS card_id, sha256(encode('PO1-v3') || unhex('1F') || encode(s) || unhex('1F') || unhex(printf('%08X', d)) || unhex('1F') || unhex(printf('%08X', rep)) || unhex('1F') || encode(card)) AS cell_id FROM (
        SELECT i, CASE WHEN i < 20 THEN 'EDR' ELSE 'NDR' END AS s, CASE WHEN (i // 10) % 2 = 0 THEN 120 ELSE 600 END AS d, (i % 10)::INT AS rep, ['M1', 'M3', 'M4', 'M7'][((i % 10) + 2 * (i // 20) + (i // 10) % 2) % 4 + 1] AS card FROM range(40) t(i))) USING (i)""", "norm"))  # fmt: skip
def outage_plan(f: Frames) -> DataFrame:
    """Runs dealt in turn to the 40 cells of the outage design."""
    cells = replay.outage_cells(f.spark).withColumn("i", F.when(F.col("source_family") == "EDR", 0).otherwise(20) + F.when(F.col("duration_s") == 120, 0).otherwise(10) + F.col("repetition_index"))
    runs = f.norm.select("run_id").distinct().withColumn("i", F.substring("run_id", 5, 9).cast("int") % 40)
    return runs.join(F.broadcast(cells), "i").select("run_id", "cell_id", "source_family", "duration_s", "repetition_index", "card_id")  # 40 rows


@query(sql("""SELECT run_id, event_id, CASE WHEN event_id = last_id THEN ingest_us + 120000000 ELSE ingest_us END AS ingest_us FROM (
    SELECT *, first_value(event_id) OVER (PARTITION BY run_id ORDER BY event_us DESC, event_id DESC) AS last_id FROM norm)""", "norm"))  # fmt: skip
def ingest_shift(f: Frames) -> DataFrame:
    """The last event of each run arrives two minutes later."""
    last = f.norm.groupBy("run_id").agg(F.max(F.struct("event_us", "event_id")).alias("m")).select("run_id", F.col("m.event_id").alias("last_id"))
    return f.norm.join(last, "run_id").select("run_id", "event_id", F.when(F.col("event_id") == F.col("last_id"), F.col("ingest_us") + 120 * SECOND).otherwise(F.col("ingest_us")).alias("ingest_us"))


def with_hub_load(norm: DataFrame, peers: int = 26) -> DataFrame:
    """Per run: peers of different groups touch one entity in one minute, then a victim does."""
    start = norm.groupBy("run_id").agg((F.max("event_us") + 7200 * SECOND).alias("t"), F.max("ingest_us").alias("i"))
    rows = start.select("run_id", "t", "i", F.explode(F.sequence(F.lit(0), F.lit(peers))).alias("n"))
    t = F.col("t") + F.col("n") * 2 * SECOND
    injected = rows.select(
        "run_id", F.concat(F.lit("inj:"), F.col("run_id"), F.lit(":"), F.col("n").cast("string")).alias("event_id"), t.alias("event_us"), (F.greatest(t, F.col("i")) + SECOND).alias("ingest_us"), F.lit("EDR").alias("source_family"), F.lit("edr-target-01").alias("source_instance"),
        F.lit("user:hub").alias("subject"), F.concat(F.lit("obj:inj:"), F.col("n").cast("string")).alias("object"), F.lit("process.start.discovery").alias("action"), F.concat(F.lit("g:inj:"), F.col("n").cast("string")).alias("dependency_group"), F.lit("discovery").alias("command_family"), F.lit(None).cast("string").alias("protocol"),
    )
    return norm.select(injected.columns).unionByName(injected)


_SEEN = "event_id, event_us, ingest_us, source_family, source_instance, subject, object, action, dependency_group, command_family, protocol, endpoint_key"
_HUB = f"""SELECT run_id || '|' || s AS run_id, {_SEEN} FROM base, (VALUES ('raw'), ('injected')) AS v(s) UNION ALL
    SELECT run_id || '|injected', 'inj:' || run_id || ':' || n, t + n * 2000000, greatest(t + n * 2000000, i) + 1000000, 'EDR', 'edr-target-01', 'user:hub', 'obj:inj:' || n, 'process.start.discovery', 'g:inj:' || n, 'discovery', NULL, NULL
    FROM (SELECT run_id, max(event_us) + 7200000000 AS t, max(ingest_us) AS i FROM base GROUP BY run_id), range(0, 27) AS r(n)"""


@query(formed_sql("SELECT builder, split_part(run_id, '|', 2) AS stream, count(DISTINCT run_id || episode_id) AS n_episodes, count(*) AS n_revisions FROM formed GROUP BY ALL", norm=_HUB, builders=("full", "no_guards")))
def hub_injection(f: Frames) -> DataFrame:
    """Episodes with and without the hub guard on streams with and without an injected hub."""
    names, out = f.aliases, None
    for label, rows in (("raw", f.norm), ("injected", with_hub_load(f.norm))):
        formed = formation.form_rolls(formation.formation_input(rows, names), ["full", "no_guards"])
        part = formed.groupBy("builder").agg(F.count_if(F.col("revision") == 0).alias("n_episodes"), F.count(F.lit(1)).alias("n_revisions")).withColumn("stream", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


_LATE = f"""SELECT run_id || '|' || s AS run_id, {_SEEN} FROM base, (VALUES ('within'), ('beyond')) AS v(s) UNION ALL
    SELECT run_id || '|' || s, 'late:' || event_id, event_us + 1000000, event_us + 1000000 + lag, {_SEEN.split("ingest_us, ")[1]} FROM (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_us, event_id) = 1), (VALUES ('within', 600000000), ('beyond', 7200000000)) AS v(s, lag)"""


@query(formed_sql("""SELECT split_part(r.run_id, '|', 1) AS run_id, split_part(r.run_id, '|', 2) AS injection, coalesce(l, 0) AS late_records, coalesce(a, 0) AS accepted FROM (SELECT DISTINCT run_id FROM norm) r
    LEFT JOIN (SELECT run_id, count(*) AS l FROM late_rows WHERE event_id LIKE 'late:%' GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS a FROM formed WHERE late_evidence_reason = 'accepted_within_horizon' AND len(list_filter(ids, lambda x: x LIKE 'late:%')) > 0 GROUP BY run_id) USING (run_id)""", norm=_LATE))  # fmt: skip
def horizon_injection(f: Frames) -> DataFrame:
    """A late copy of each run's first event, inside and beyond the revision horizon: accepted revisions and late records."""
    names, out = f.aliases, None
    first = f.norm.groupBy("run_id").agg(F.min(F.struct("event_us", "event_id")).alias("m")).select("run_id", F.col("m.event_id").alias("event_id"))
    base = f.norm.join(first, ["run_id", "event_id"], "left_semi")
    for label, lag in (("within", 600), ("beyond", 7200)):
        late = base.withColumn("event_id", F.concat(F.lit("late:"), F.col("event_id"))).withColumn("event_us", F.col("event_us") + SECOND).withColumn("ingest_us", F.col("event_us") + lag * SECOND)
        rows = formation.formation_input(f.norm.unionByName(late), names)
        records = formation.late_records(rows).filter(F.col("event_id").startswith("late:")).groupBy("run_id").agg(F.count(F.lit(1)).alias("late_records"))
        accepted = formation.form_episodes(rows).filter((F.col("late_evidence_reason") == "accepted_within_horizon") & F.exists("ordered_event_ids", lambda e: e.startswith("late:"))).groupBy("run_id").agg(F.count(F.lit(1)).alias("accepted"))
        part = first.select("run_id").join(records, "run_id", "left").join(accepted, "run_id", "left").select("run_id", F.lit(label).alias("injection"), F.coalesce("late_records", F.lit(0)).alias("late_records"), F.coalesce("accepted", F.lit(0)).alias("accepted"))
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("""SELECT variant, count_if(kept) ::BIGINT AS kept, count_if(NOT kept)::BIGINT AS refused FROM (
    SELECT 'mutable' AS variant, true AS kept FROM ops UNION ALL SELECT 'append_noncanonical', true FROM ops UNION ALL
    SELECT 'silent_failure', outcome <> 'failure' FROM ops UNION ALL SELECT 'append_only', first_id = event_id OR outcome = first_outcome FROM ops) GROUP BY variant""", "norm").replace("\nSELECT variant", """,
ops AS (SELECT event_id, outcome, first_value(event_id) OVER w AS first_id, first_value(outcome) OVER w AS first_outcome FROM (SELECT *, CASE WHEN parent_pid IS NULL THEN 'failure' ELSE action END AS outcome FROM norm) WINDOW w AS (PARTITION BY run_id, dependency_group ORDER BY event_us, event_id))
SELECT variant"""))  # fmt: skip
def store_variants(f: Frames) -> DataFrame:
    """What four designs of a terminal store keep of the same attempts: only the append-only one refuses a changed outcome and keeps failures."""
    ops = f.norm.select("run_id", "dependency_group", "event_us", "event_id", F.when(F.col("parent_pid").isNull(), "failure").otherwise(F.col("action")).alias("outcome"))
    first = ops.groupBy("run_id", "dependency_group").agg(F.min(F.struct("event_us", "event_id", "outcome")).alias("x"))
    both = ops.join(first, ["run_id", "dependency_group"])
    kept = {"mutable": F.lit(True), "append_noncanonical": F.lit(True), "silent_failure": F.col("outcome") != "failure", "append_only": (F.col("event_id") == F.col("x.event_id")) | (F.col("outcome") == F.col("x.outcome"))}
    rows = both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("kept")) for n, c in kept.items()])))
    return rows.groupBy("variant").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("refused"))


@query(sql("""SELECT token, count(*) AS n_groups, count_if(hit)::BIGINT AS n_recovered, round(count_if(hit) / count(*), 9) AS rate FROM (
    SELECT t.run_id, t.group_id, t.token, coalesce(bool_or(list_contains(v.tokens, t.token)), false) AS hit FROM (SELECT run_id, group_id, unnest(required_tokens) AS token FROM truth) t
    LEFT JOIN edges e USING (run_id, group_id) LEFT JOIN views v ON v.run_id = e.run_id AND v.episode_no = e.episode_no GROUP BY ALL) GROUP BY token""", "truth", "edges", "views"))  # fmt: skip
def token_recovery(f: Frames) -> DataFrame:
    """For each required token: in how many truth groups some matched episode has it."""
    needed = f.truth.select("run_id", "group_id", F.explode("required_tokens").alias("token"))
    found = f.edges.select("run_id", "episode_no", "group_id").join(f.views.select(*EPISODE, F.explode("tokens").alias("token")), EPISODE).select("run_id", "group_id", "token").distinct().withColumn("hit", F.lit(1))
    rows = needed.join(found, ["run_id", "group_id", "token"], "left")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_groups"), F.count("hit").alias("n_recovered"), r9(F.count("hit") / F.count(F.lit(1))).alias("rate"))


@query(sql("""SELECT run_id, count(*) AS n_groups, count_if(coalesce(c, 0) >= 1)::BIGINT AS exact_complete, count_if(c IS NULL)::BIGINT AS missed FROM truth LEFT JOIN (SELECT run_id, group_id, max(coverage) AS c FROM edges GROUP BY ALL) USING (run_id, group_id) GROUP BY run_id""", "truth", "edges"))
def exact_complete(f: Frames) -> DataFrame:
    best = f.edges.groupBy("run_id", "group_id").agg(F.max("coverage").alias("c"))
    rows = f.truth.select("run_id", "group_id").join(best, ["run_id", "group_id"], "left")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("c") >= 1).alias("exact_complete"), F.count_if(F.col("c").isNull()).alias("missed"))


@query(sql("""SELECT source_family, round(quantile_cont((ingest_us - event_us) / 1e6::DOUBLE, 0.5), 9) AS p50, round(quantile_cont((ingest_us - event_us) / 1e6::DOUBLE, 0.95), 9) AS p95, round(quantile_cont((ingest_us - event_us) / 1e6::DOUBLE, 0.99), 9) AS p99 FROM norm GROUP BY source_family""", "norm"))
def lag_percentiles(f: Frames) -> DataFrame:
    """Percentiles by linear interpolation, by distributed selection."""
    lag = (F.col("ingest_us") - F.col("event_us")) / F.lit(1e6)
    found = selection.percentiles(f.norm.select("source_family", lag.alias("lag")), ["source_family"], "lag", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("source_family", *[r9(n).alias(n) for n in ("p50", "p95", "p99")])


@query(sql("""SELECT a.run_id, a.n AS edr_episodes, b.n AS ndr_episodes, a.n - b.n AS delta FROM (SELECT run_id, count(DISTINCT episode_no) AS n FROM members WHERE source_family = 'EDR' GROUP BY run_id) a JOIN (SELECT run_id, count(DISTINCT episode_no) AS n FROM members WHERE source_family = 'NDR' GROUP BY run_id) b USING (run_id)""", "members"))
def builder_pairs(f: Frames) -> DataFrame:
    """Two variants of one run side by side, and their difference."""
    rows = f.members.groupBy("run_id").pivot("source_family", ["EDR", "NDR"]).agg(F.countDistinct("episode_no"))
    return rows.filter("EDR IS NOT NULL AND NDR IS NOT NULL").select("run_id", F.col("EDR").alias("edr_episodes"), F.col("NDR").alias("ndr_episodes"), (F.col("EDR") - F.col("NDR")).alias("delta"))


@query(sql("""SELECT label, kappa, count(*) AS n FROM labelled JOIN support USING (run_id, episode_no) GROUP BY ALL""", "labelled", "support"))
def label_support_confusion(f: Frames) -> DataFrame:
    return f.labelled.select(*EPISODE, "label").join(f.supported.select(*EPISODE, "kappa"), EPISODE).groupBy("label", "kappa").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT run_id, source_instance, health, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM (SELECT *, interval_no - row_number() OVER (PARTITION BY run_id, source_instance, health ORDER BY interval_no) AS island FROM cov) GROUP BY run_id, source_instance, health, island""", "cov"))
def health_spells(f: Frames) -> DataFrame:
    """Neighbouring intervals of one health, joined."""
    w = Window.partitionBy("run_id", "source_instance", "health").orderBy("interval_no")
    rows = f.coverage.withColumn("island", F.col("interval_no") - F.row_number().over(w))
    return rows.groupBy("run_id", "source_instance", "health", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n")).drop("island")


@query(sql("""SELECT run_id, count(*) AS n, count(DISTINCT dependency_group) AS n_groups, array_to_string(list_sort(list(DISTINCT source_instance)), ',') AS instances FROM norm GROUP BY run_id""", "norm"))
def run_manifest(f: Frames) -> DataFrame:
    return f.norm.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dependency_group").alias("n_groups"), F.array_join(F.array_sort(F.collect_set("source_instance")), ",").alias("instances"))


@query(sql("""SELECT grp, round(avg(label), 9) AS rate, round(sum((score - m) * (label - l)) / nullif(sqrt(sum((score - m) * (score - m)) * sum((label - l) * (label - l))), 0), 9) AS correlation FROM (SELECT *, avg(score) OVER (PARTITION BY grp) AS m, avg(label) OVER (PARTITION BY grp) AS l FROM scored) GROUP BY grp""", "scored"))
def score_label_effect(f: Frames) -> DataFrame:
    rows = evaluation.by_score(f.scored, ["grp"])
    n, sx, sy = F.sum("n"), F.sum(F.col("score") * F.col("n")), F.sum("pos")
    sxx, sxy = F.sum(F.col("score") * F.col("score") * F.col("n")), F.sum(F.col("score") * F.col("pos"))
    vx, vy = sxx - sx * sx / n, sy - sy * sy / n
    return rows.groupBy("grp").agg(r9(sy / n).alias("rate"), F.when((vx > 1e-12) & (vy > 0), r9((sxy - sx * sy / n) / F.sqrt(vx * vy))).alias("correlation"))
