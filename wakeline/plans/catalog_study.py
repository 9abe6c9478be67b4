"""Registered queries: registries and lines, guards, links, outages, losses, deliveries and checks of replies, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import builders, detectors, evaluation, firewall, formation
from wakeline.plans.catalog import FORBIDDEN, band_links, query, r9
from wakeline.plans.catalog_formed import formed_query
from wakeline.plans.ctes import formed_sql, sql
from wakeline.plans.formed import FormedFrames
from wakeline.plans.frames import Frames
from wakeline.sources import adapters, sinks

S = 1_000_000


# ---------------------------------------------------------------- registries and lines
_REGISTRY = "SELECT DISTINCT run_id, 'M' || (substr(run_id, 5, 9)::INT % 9) AS card_id, CASE substr(run_id, 5, 9)::INT % 3 WHEN 0 THEN 'locked_test' WHEN 1 THEN 'train' ELSE 'dev' END AS partition, CASE WHEN substr(run_id, 5, 9)::INT % 5 = 4 THEN 'open' ELSE 'sealed' END AS status FROM norm"


def registry(f: Frames) -> DataFrame:
    n = F.substring("run_id", 5, 9).cast("int")
    part = F.when(n % 3 == 0, "locked_test").when(n % 3 == 1, "train").otherwise("dev")
    return f.norm.select("run_id").distinct().select("run_id", F.concat(F.lit("M"), (n % 9).cast("string")).alias("card_id"), part.alias("partition"), F.when(n % 5 == 4, "open").otherwise("sealed").alias("status"))


@query(sql(f"SELECT * FROM ({_REGISTRY}) WHERE status = 'sealed' AND partition = 'locked_test' AND card_id IN ('M0', 'M1', 'M2', 'M3', 'M4', 'M5', 'M6')", "norm"))
def registry_scan(f: Frames) -> DataFrame:
    """The registry of runs written as CSV and scanned again by status, partition and card."""
    path = f"{sinks.shared_dir(f.spark).rstrip('/')}/wakeline-registry-{uuid.uuid4().hex}"
    sinks.write_csv(registry(f), path)
    where = "status = 'sealed' AND partition = 'locked_test' AND card_id IN ('M0', 'M1', 'M2', 'M3', 'M4', 'M5', 'M6')"
    return sinks.read_registry(f.spark, path, "run_id string, card_id string, partition string, status string", where, registry(f).filter(where).count())


@query(sql(f"""SELECT 'run:' || lpad(i::VARCHAR, 9, '0') AS run_id, r.run_id IS NOT NULL AS present, coalesce(r.n, 0) AS n_events FROM range((SELECT max(substr(run_id, 5, 9)::INT) + 4 FROM norm)) AS p(i)
    LEFT JOIN (SELECT run_id, count(*) AS n FROM norm WHERE source_family = 'EDR' GROUP BY run_id) r ON r.run_id = 'run:' || lpad(i::VARCHAR, 9, '0') WHERE i % 3 = 0""", "norm"))  # fmt: skip
def campaign_plan(f: Frames) -> DataFrame:
    """Every planned locked run, whether it is there, and how many endpoint events it has."""
    last = f.norm.agg(F.max(F.substring("run_id", 5, 9).cast("long")).alias("m"))
    plan = last.select(F.explode(F.sequence(F.lit(0), F.col("m") + 3)).alias("i")).filter("i % 3 = 0").select(adapters.id_text("run:", F.col("i")).alias("run_id"))
    present = f.norm.filter("source_family = 'EDR'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(present, "run_id", "left").select("run_id", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).cast("long").alias("n_events"))


@query(sql(f"""SELECT run_id, status = 'sealed' AS sealed, sha256(string_agg(event_id, ',' ORDER BY event_id)) AS digest, count(*) AS n FROM norm JOIN ({_REGISTRY}) USING (run_id) GROUP BY run_id, status""", "norm"))
def sealed_runs(f: Frames) -> DataFrame:
    """Runs with the digest of their events; reading them again must give the digest that was stored, else the job fails."""
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("event_id")), ",").cast("binary"), 256)
    stored = sinks.materialize(f.norm.groupBy("run_id").agg(digest.alias("stored")), "sealed")
    found = f.norm.groupBy("run_id").agg(digest.alias("digest"), F.count(F.lit(1)).alias("n"))
    rows = found.join(stored, "run_id").join(registry(f), "run_id")
    same = F.when(F.col("digest") == F.col("stored"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("digest of run differs: "), "run_id")))
    return rows.select("run_id", (F.col("status") == "sealed").alias("sealed"), same.alias("digest"), "n")


_LINE = """CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '[' || k || ']' WHEN 2 THEN '{"a": NaN}' WHEN 3 THEN '{"a": ' || k WHEN 4 THEN '{"a": 9007199254740993}' WHEN 5 THEN '{"a": "NaN, 99999999999999999999"}' ELSE '{"object_type": "' || event_type || '", "k": ' || k || '}' END"""


@query(f"""SELECT line, CASE k % 8 WHEN 0 THEN 'blank' WHEN 1 THEN 'not_object' WHEN 2 THEN 'invalid' WHEN 3 THEN 'invalid' WHEN 4 THEN 'range' ELSE 'ok' END AS status, CASE WHEN k % 8 > 5 THEN event_type END AS object_type
    FROM (SELECT row_number() OVER (ORDER BY event_id) AS line, (props->>'$.k')::INT AS k, event_type FROM events)""")
def ndjson_scan(f: Frames) -> DataFrame:
    """A file of JSON lines, some of them broken: the number of each line, what is wrong with it, and the type of its object."""
    path = f"{sinks.shared_dir(f.spark).rstrip('/')}/wakeline-lines-{uuid.uuid4().hex}"
    lines = f.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).orderBy("event_id").select(F.expr(_LINE).alias("value"))
    lines.coalesce(1).write.text(path)  # one file, as the scan counts the lines of a file
    rows = sinks.read_lines(f.spark, path).withColumn("status", sinks.line_status(F.col("value")))
    return rows.select(F.col("line").cast("long").alias("line"), "status", F.when(F.col("status") == "ok", F.get_json_object("value", "$.object_type")).alias("object_type"))


# ---------------------------------------------------------------- guards
_NESTED = """'{"id": ' || event_id || ', "attributes": {"' || CASE k % 5 WHEN 0 THEN 'Marker' WHEN 1 THEN 'label' ELSE 'plain' END || '": ' || k || ', "list": [{"deep": {"' || CASE WHEN k % 7 = 0 THEN 'campaign_id' ELSE 'other' END || '": "' || CASE WHEN k % 11 = 0 THEN 'secret-value' ELSE 'open' END || '"}}, "' || CASE WHEN k % 13 = 0 THEN 'secret-value' ELSE 'x' END || '"]}}'"""


@query(f"""SELECT event_id, substr(replace(fullkey, '"', ''), 3) AS path, 'key' AS kind, key AS found FROM (SELECT event_id, {_NESTED} AS doc FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)), json_tree(doc) WHERE lower(key) IN ({', '.join(f"'{k}'" for k in FORBIDDEN)})
    UNION ALL SELECT event_id, substr(replace(fullkey, '"', ''), 3), 'value', atom->>'$' FROM (SELECT event_id, {_NESTED} AS doc FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)), json_tree(doc) WHERE type = 'VARCHAR' AND atom->>'$' = 'secret-value'""")
def firewall_walk(f: Frames) -> DataFrame:
    """Forbidden keys and values at any depth of nested records, with their paths."""
    docs = f.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select("event_id", F.expr(_NESTED).alias("doc"))
    return firewall.findings(docs, "event_id", "doc", FORBIDDEN, ["secret-value"]).withColumnRenamed("id", "event_id")


@query("""SELECT event_id, CASE WHEN k % 6 > 2 THEN x END AS finite, CASE WHEN k % 6 > 2 AND x BETWEEN 0 AND 1 THEN x END AS unit FROM (SELECT event_id, (props->>'$.k')::INT AS k, ((props->>'$.k')::INT - 20) / 64 AS x FROM events)""")
def finite_guards(f: Frames) -> DataFrame:
    """Numbers among which NaN and infinities occur: the finite ones, and those from 0 to 1."""
    k = F.get_json_object("props", "$.k").cast("int")
    wild = F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 6 == 1, F.lit(float("inf"))).when(k % 6 == 2, F.lit(float("-inf"))).otherwise((k - 20) / 64)
    rows = f.table("events").select("event_id", firewall.finite_or_null(wild).alias("finite"), firewall.unit_or_null(wild).alias("unit"))
    return firewall.assert_finite(rows)


_IPV4 = " OR ".join(f"x BETWEEN {(low := sum(int(o) << 8 * (3 - i) for i, o in enumerate(a.split('.'))))} AND {low + (1 << 32 - b) - 1}" for a, b in detectors.BLOCKS)
_FIRST = "[0, 8, 10, 11, 127, 128, 169, 172, 192, 198, 203, 223, 240, 255]"
_SECOND = "[0, 1, 15, 16, 31, 32, 168, 254, 18, 19, 51, 100]"


@query(f"""SELECT event_id, {_IPV4} AS private FROM (SELECT event_id, ({_FIRST})[a + 1]::BIGINT * 16777216 + ({_SECOND})[b + 1] * 65536 + (event_id % 3) * 256 + event_id % 200 AS x FROM (SELECT event_id, event_id % 14 AS a, (event_id // 14) % 12 AS b FROM events))""")
def private_addresses(f: Frames) -> DataFrame:
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(F.from_json(F.lit(values), "array<int>"), (n + 1).cast("int")).cast("string")
    address = F.concat_ws(".", pick(_FIRST, e % 14), pick(_SECOND, F.floor(e / 14) % 12), (e % 3).cast("string"), (e % 200).cast("string"))
    return f.table("events").select("event_id", detectors.private_address(address).alias("private"))


_POINTERS = ["/k", "/a~1b", "/m~0n/1", "/list/0/x", "/none", "/list/7"]
_DOC = """'{"k": ' || k || ', "a/b": ' || CASE WHEN k % 2 = 0 THEN '1' ELSE 'null' END || ', "m~n": [1, "' || k || '"], "list": [{"x": ' || k || '.5}]}'"""


@query("SELECT event_id, " + ", ".join(f"json_extract(doc, '{p}') IS NOT NULL AS p{i}" for i, p in enumerate(_POINTERS)) + f", abs(json_extract(doc, '/list/0/x')::DOUBLE - 7.5) <= 1e-12 AS equal FROM (SELECT event_id, {_DOC} AS doc FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events))")
def json_pointers(f: Frames) -> DataFrame:
    """Do pointers, some of them escaped, name something in a record; and is a number equal to another within 1e-12."""
    rows = f.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).select("event_id", F.parse_json(F.expr(_DOC)).alias("v"))
    found = [firewall.json_pointer(F.col("v"), p).isNotNull().alias(f"p{i}") for i, p in enumerate(_POINTERS)]
    x = F.try_variant_get("v", "$.list[0].x", "double")
    return rows.select("event_id", *found, (F.abs(x - 7.5) <= 1e-12).alias("equal"))


# ---------------------------------------------------------------- links
@query(sql("""SELECT run_id, event_id, first_value(b_id) AS nearest_id, delta_us FROM (SELECT a.run_id, a.event_id, b.event_id AS b_id, a.event_us - b.event_us AS delta_us, row_number() OVER (PARTITION BY a.event_id ORDER BY a.event_us - b.event_us, b.event_id DESC) AS pos
    FROM norm a JOIN norm b ON a.run_id = b.run_id AND a.dependency_group = b.dependency_group AND (b.event_us, b.event_id) < (a.event_us, a.event_id) AND a.event_us - b.event_us <= 300000000) WHERE pos = 1""", "norm").replace("first_value(b_id)", "b_id"))
def nearest_link(f: Frames) -> DataFrame:
    """The last event of the same group before an event, if it is no more than the gap away. One look back in order, no pairs."""
    w = Window.partitionBy("run_id", "dependency_group").orderBy("event_us", "event_id")
    rows = f.norm.select("run_id", "event_id", F.lag("event_id").over(w).alias("nearest_id"), (F.col("event_us") - F.lag("event_us").over(w)).alias("delta_us"))
    return rows.filter(F.col("delta_us") <= 300 * S)


@query(sql("""SELECT run_id, session_no, event_id, event_us - lag(event_us) OVER w AS delta_us, event_us - min(event_us) OVER w AS span_us, event_us - min(event_us) OVER w <= 3600000000 AS within_span FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY event_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (
        SELECT *, coalesce((event_us - lag(event_us) OVER (PARTITION BY run_id ORDER BY event_us, event_id) > 300000000)::INT, 0) AS fresh FROM norm))
    WINDOW w AS (PARTITION BY run_id, session_no ORDER BY event_us, event_id)""", "norm"))  # fmt: skip
def session_spans(f: Frames) -> DataFrame:
    """In sessions by gap: the distance to the last event, the span so far, and whether it keeps within an hour."""
    w = Window.partitionBy("run_id", "session_no").orderBy("event_us", "event_id")
    span = F.col("event_us") - F.min("event_us").over(w)
    return builders.sliding_sessions(f.norm).select("run_id", "session_no", "event_id", (F.col("event_us") - F.lag("event_us").over(w)).alias("delta_us"), span.alias("span_us"), (span <= 3600 * S).alias("within_span"))


@query(sql("""SELECT l.*, list_sort(list_filter(['process_causal', CASE WHEN s THEN 'specific_entity' END, CASE WHEN s AND a.source_family <> b.source_family THEN 'endpoint_connection' END, CASE WHEN s AND a.ses AND b.ses THEN 'authenticated_session' END], lambda x: x IS NOT NULL))::VARCHAR AS relations
    FROM (SELECT a.run_id, a.event_id AS first_id, b.event_id AS second_id FROM norm a JOIN norm b ON a.run_id = b.run_id AND a.dependency_group = b.dependency_group AND (a.event_us, a.event_id) < (b.event_us, b.event_id) AND b.event_us - a.event_us <= 300000000) l
    JOIN e a ON a.event_id = first_id JOIN e b ON b.event_id = second_id, LATERAL (SELECT a.subject IN (b.subject, b.object) OR a.object IN (b.subject, b.object) AS s)""", "norm").replace("\nSELECT l.*", """,
e AS (SELECT *, coalesce(command_family = 'remote_session', false) OR coalesce(protocol = 'ssh', false) AS ses FROM norm)
SELECT l.*""").replace("::VARCHAR AS relations", "AS r").replace("SELECT l.*, list_sort", "SELECT run_id, first_id, second_id, array_to_string(r, ',') AS relations FROM (SELECT l.*, list_sort") + ")")
def event_relations(f: Frames) -> DataFrame:
    """The classes of relation between two events of a group within the gap."""
    ses = F.coalesce(F.col("command_family") == "remote_session", F.lit(False)) | F.coalesce(F.col("protocol") == "ssh", F.lit(False))
    side = lambda x: f.norm.select(F.col("event_id").alias(f"{x}_id"), F.array("subject", "object").alias(f"{x}_e"), F.col("source_family").alias(f"{x}_f"), ses.alias(f"{x}_s"))
    pairs = band_links(f.norm).select("run_id", "first_id", "second_id").join(side("first"), "first_id").join(side("second"), "second_id")
    both = F.arrays_overlap("first_e", "second_e")
    kinds = [F.lit("process_causal"), F.when(both, "specific_entity"), F.when(both & (F.col("first_f") != F.col("second_f")), "endpoint_connection"), F.when(both & F.col("first_s") & F.col("second_s"), "authenticated_session")]
    return pairs.select("run_id", "first_id", "second_id", F.array_join(F.array_sort(F.array_compact(F.array(*kinds))), ",").alias("relations"))


# ---------------------------------------------------------------- coverage that contradicts itself
@query(sql("""SELECT run_id, source_instance, interval_no, count(DISTINCT h) AS n_records, CASE WHEN count(DISTINCT h) = 1 THEN min(h) ELSE 'unknown' END AS health FROM (
    SELECT run_id, source_instance, interval_no, health AS h FROM cov UNION ALL SELECT run_id, source_instance, interval_no, CASE WHEN interval_no % 5 = 0 THEN 'down' ELSE health END FROM cov WHERE interval_no % 2 = 0) GROUP BY ALL""", "cov"))  # fmt: skip
def coverage_conflicts(f: Frames) -> DataFrame:
    """Records that came twice: equal ones are one, different ones make an interval unknown."""
    again = f.coverage.filter("interval_no % 2 = 0").withColumn("health", F.when(F.col("interval_no") % 5 == 0, "down").otherwise(F.col("health")))
    key = ["run_id", "source_instance", "interval_no"]
    rows = f.coverage.select(*key, "health").unionByName(again.select(*key, "health")).distinct()
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_records"), F.min("health").alias("h")).select(*key, "n_records", F.when(F.col("n_records") == 1, F.col("h")).otherwise("unknown").alias("health"))


# ---------------------------------------------------------------- outages
_JOURNAL = """SELECT run_id, 'cell:' || (no % 40) AS cell_id, t_stop, t_stop + 600000000 AS t_restore, CASE WHEN no % 5 <> 2 THEN t_stop + 45000000 END AS t_detect, CASE WHEN no % 4 <> 3 THEN t_stop + 660000000 END AS t_ready, t_stop + 1800000000 AS t_censor
    FROM (SELECT run_id, substr(run_id, 5, 9)::INT AS no, min(event_us) + (max(event_us) - min(event_us)) // 2 AS t_stop FROM norm GROUP BY run_id)"""


def journal(f: Frames) -> DataFrame:
    """A source of each run stops half way; some outages are never detected, some sources never ready again."""
    spans = f.norm.groupBy("run_id").agg(F.min("event_us").alias("a"), F.max("event_us").alias("b"))
    no = F.substring("run_id", 5, 9).cast("int")
    rows = spans.select("run_id", F.concat(F.lit("cell:"), (no % 40).cast("string")).alias("cell_id"), (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).alias("t_stop"), no.alias("no"))
    at = lambda s: F.col("t_stop") + s * S
    return rows.select("run_id", "cell_id", "t_stop", at(600).alias("t_restore"), F.when(F.col("no") % 5 != 2, at(45)).alias("t_detect"), F.when(F.col("no") % 4 != 3, at(660)).alias("t_ready"), at(1800).alias("t_censor"))


_OUTAGE = f"""SELECT j.run_id, cell_id, comparator, any_value(array_to_string(list_filter([CASE WHEN t_detect IS NULL THEN 'detection_right_censored_at_restore' END, CASE WHEN t_ready IS NULL THEN 'ready_right_censored' END, CASE WHEN t_stable IS NULL THEN 'stable_revision_right_censored' END], lambda x: x IS NOT NULL), '+')) AS censor_reason,
        any_value((t_detect - t_stop) / 1e6) AS detection_s, any_value((t_ready - t_restore) / 1e6) AS recovery_s, any_value((t_stable - t_restore) / 1e6) AS stable_s, count(o.run_id) AS n_outcomes,
        round(count_if(CASE comparator WHEN 'whole' THEN audit AND reason = 'eligible' ELSE audit AND eligible_count > 0 AND seen END) / nullif(count(o.run_id), 0), 9) AS eligible_fraction,
        round(count_if(CASE comparator WHEN 'whole' THEN audit AND kappa = 'out_of_support' ELSE NOT audit OR NOT seen END) / nullif(count(o.run_id), 0), 9) AS out_of_support_rate
    FROM ({_JOURNAL}) j CROSS JOIN (VALUES ('whole'), ('available_source')) AS c(comparator)
    LEFT JOIN (SELECT run_id, min(watermark_us) AS t_stable FROM (SELECT f.run_id, watermark_us FROM formed f JOIN ({_JOURNAL}) USING (run_id) WHERE state = 'closed' AND watermark_us >= t_restore) GROUP BY run_id) s ON s.run_id = j.run_id
    LEFT JOIN (SELECT o.*, f.watermark_us, e_health IN ('healthy', 'degraded') OR n_health IN ('healthy', 'degraded') AS seen FROM outcome o JOIN formed f USING (run_id, episode_id, revision)) o ON o.run_id = j.run_id AND o.watermark_us BETWEEN t_stop AND coalesce(t_ready, t_censor)
    GROUP BY j.run_id, cell_id, comparator"""


@formed_query(formed_sql(_OUTAGE, "outcome"))
def outage_comparison(f: FormedFrames) -> DataFrame:
    """What an outage costs, two rows each: all sources must be in support, or one that is available is enough."""
    j = journal(f)
    stable = f.marks.filter("state = 'closed'").join(j.select("run_id", "t_restore"), "run_id").filter("watermark_us >= t_restore").groupBy("run_id").agg(F.min("watermark_us").alias("t_stable"))
    seen = F.col("e_health").isin("healthy", "degraded") | F.col("n_health").isin("healthy", "degraded")
    fit, any_fit = F.col("audit") & (F.col("reason") == "eligible"), F.col("audit") & (F.col("eligible_count") > 0) & seen
    out, any_out = F.col("audit") & (F.col("kappa") == "out_of_support"), ~F.col("audit") | ~seen
    rows = f.outcomes.join(j.select("run_id", "t_stop", F.coalesce("t_ready", "t_censor").alias("t_end")), "run_id").filter(F.col("watermark_us").between(F.col("t_stop"), F.col("t_end")))
    counts = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in (("a0", fit), ("a1", any_fit), ("b0", out), ("b1", any_out))])
    both = j.join(stable, "run_id", "left").join(counts, "run_id", "left")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("t_detect").isNull(), "detection_right_censored_at_restore"), F.when(F.col("t_ready").isNull(), "ready_right_censored"), F.when(F.col("t_stable").isNull(), "stable_revision_right_censored"))), "+")
    share = lambda c: r9(F.col(c) / F.col("n"))
    pair = F.array(*[F.struct(F.lit(name).alias("comparator"), share(f"a{i}").alias("eligible_fraction"), share(f"b{i}").alias("out_of_support_rate")) for i, name in enumerate(("whole", "available_source"))])
    seconds = lambda a, b: ((F.col(a) - F.col(b)) / F.lit(1e6))
    return both.select("run_id", "cell_id", why.alias("censor_reason"), seconds("t_detect", "t_stop").alias("detection_s"), seconds("t_ready", "t_restore").alias("recovery_s"), seconds("t_stable", "t_restore").alias("stable_s"), F.coalesce("n", F.lit(0)).cast("long").alias("n_outcomes"), F.inline(pair))


@formed_query(formed_sql(f"SELECT cell_id, count(*) AS n_rows, count(DISTINCT run_id) AS n_traces, count(*) = 2 * count(DISTINCT run_id) AS paired, count(DISTINCT cell_id) OVER () >= 40 AS complete FROM ({_OUTAGE}) GROUP BY cell_id".replace("count(DISTINCT cell_id) OVER () >= 40 AS complete", "(SELECT count(DISTINCT cell_id) FROM (" + _JOURNAL + ")) = 40 AS complete"), "outcome"))
def outage_completeness(f: FormedFrames) -> DataFrame:
    """Per cell: its rows, the traces they come from, whether both comparators share each, and whether all 40 cells are there."""
    rows = outage_comparison(f).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run_id").alias("n_traces"))
    total = journal(f).agg((F.countDistinct("cell_id") == 40).alias("complete"))
    return rows.withColumn("paired", F.col("n_rows") == 2 * F.col("n_traces")).crossJoin(F.broadcast(total))  # one row


# ---------------------------------------------------------------- where evidence is lost
_LOSS = """SELECT t.run_id, t.group_id, t.token, CASE WHEN n.n IS NULL THEN 'B_sensor_observability' WHEN n.mapped = 0 THEN 'D_token_mapping' WHEN v.member IS NULL THEN 'E_formation_membership' WHEN e.credited IS NULL THEN 'F_offline_attribution' ELSE 'G_none' END AS loss
    FROM (SELECT run_id, group_id, start_us, end_us, entities, unnest(required_tokens) AS token FROM truth) t
    LEFT JOIN (SELECT run_id, endpoint_key || '@' || event_us // 1800000000 AS group_id, count(*) AS n FROM norm WHERE source_family = 'EDR' GROUP BY ALL) x USING (run_id, group_id)
    LEFT JOIN (SELECT run_id, group_id, token, count(*) AS n, count_if(k % 19 <> 0) AS mapped FROM (SELECT run_id, endpoint_key || '@' || event_us // 1800000000 AS group_id, k, unnest([action, 'command_family:' || command_family]) AS token FROM norm WHERE source_family = 'EDR' AND k % 29 <> 0) GROUP BY ALL) n ON n.run_id = t.run_id AND n.group_id = t.group_id AND n.token = t.token
    LEFT JOIN (SELECT DISTINCT t.run_id, t.group_id, x.token, true AS member FROM truth t JOIN (SELECT run_id, start_us, end_us, entities, unnest(tokens) AS token FROM views) x ON x.run_id = t.run_id AND x.start_us <= t.end_us AND t.start_us <= x.end_us AND list_has_any(x.entities, t.entities)) v ON v.run_id = t.run_id AND v.group_id = t.group_id AND v.token = t.token
    LEFT JOIN (SELECT DISTINCT run_id, group_id, unnest(attack) AS token, true AS credited FROM edges) e ON e.run_id = t.run_id AND e.group_id = t.group_id AND e.token = t.token"""


def losses(f: FormedFrames) -> DataFrame:
    truth = sinks.materialize(f.truth, "loss-truth")
    bucket = F.floor(F.col("event_us") / (adapters.TRUTH_S * S)).cast("string")
    tokens = f.norm.filter("source_family = 'EDR' AND k % 29 <> 0").select("run_id", F.concat("endpoint_key", F.lit("@"), bucket).alias("group_id"), "k", F.explode(F.array("action", F.concat(F.lit("command_family:"), "command_family"))).alias("token"))
    seen = tokens.groupBy("run_id", "group_id", "token").agg(F.count_if(F.col("k") % 19 != 0).alias("mapped"))
    # Episodes and groups meet on an entity, then in time.
    g = truth.select("run_id", "group_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"), F.explode("entities").alias("entity"))
    v = f.views.select("run_id", "start_us", "end_us", "tokens", F.explode("entities").alias("entity"))
    member = g.join(v, ["run_id", "entity"]).filter("start_us <= g1 AND g0 <= end_us").select("run_id", "group_id", F.explode("tokens").alias("token")).distinct().withColumn("member", F.lit(True))
    credited = f.edges.select("run_id", "group_id", F.explode("attack").alias("token")).distinct().withColumn("credited", F.lit(True))
    key = ["run_id", "group_id", "token"]
    rows = truth.select("run_id", "group_id", F.explode("required_tokens").alias("token")).join(seen, key, "left").join(member, key, "left").join(credited, key, "left")
    loss = F.when(F.col("mapped").isNull(), "B_sensor_observability").when(F.col("mapped") == 0, "D_token_mapping").when(F.col("member").isNull(), "E_formation_membership").when(F.col("credited").isNull(), "F_offline_attribution").otherwise("G_none")
    return rows.select(*key, loss.alias("loss"))


@formed_query(formed_sql(_LOSS, "truth", "views", "edges"))
def evidence_loss(f: FormedFrames) -> DataFrame:
    """At which stage each required token of each truth group is lost, or that it is not."""
    return losses(f)


@formed_query(formed_sql(f"SELECT stage, count(*) AS n FROM (SELECT unnest(list_filter(['required', CASE WHEN loss > 'B_z' THEN 'observed' END, CASE WHEN loss > 'D_z' THEN 'mapped' END, CASE WHEN loss > 'E_z' THEN 'member' END, CASE WHEN loss > 'F_z' THEN 'credited' END], lambda x: x IS NOT NULL)) AS stage FROM ({_LOSS})) GROUP BY stage", "truth", "views", "edges"))
def evidence_waterfall(f: FormedFrames) -> DataFrame:
    """How many required tokens reach each stage."""
    stages = F.array_compact(F.array(F.lit("required"), *[F.when(F.col("loss") > f"{c}_z", name) for c, name in (("B", "observed"), ("D", "mapped"), ("E", "member"), ("F", "credited"))]))
    return losses(f).select(F.explode(stages).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@formed_query(formed_sql(f"SELECT expected, loss AS observed, count(*) AS n FROM (SELECT *, CASE WHEN contains(token, 'file_change') THEN 'D_token_mapping' ELSE 'G_none' END AS expected FROM ({_LOSS})) GROUP BY ALL", "truth", "views", "edges"))
def loss_confusion(f: FormedFrames) -> DataFrame:
    expected = F.when(F.col("token").contains("file_change"), "D_token_mapping").otherwise("G_none")
    return losses(f).groupBy(expected.alias("expected"), F.col("loss").alias("observed")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT CASE WHEN k % 31 = 0 THEN 'A_action_execution_failure' WHEN k % 29 = 0 THEN 'B_sensor_observability_failure' WHEN command_family IS DISTINCT FROM 'file_change' AND command_family = 'remote_session' THEN 'D_token_mapping_failure'
    WHEN command_family IS DISTINCT FROM 'file_change' THEN 'C_parser_normalization_failure' WHEN n < 2 THEN 'E_relation_linking_failure' ELSE 'F_matching_or_none' END AS drop_class, count(*) AS n
    FROM (SELECT k, command_family, count(*) OVER (PARTITION BY run_id, dependency_group) AS n FROM norm) GROUP BY 1""", "norm"))  # fmt: skip
def drop_classes(f: Frames) -> DataFrame:
    """Why a transfer leaves no trace, first cause first."""
    size = f.norm.groupBy("run_id", "dependency_group").agg(F.count(F.lit(1)).alias("size"))
    transfer, k = F.col("command_family").eqNullSafe("file_change"), F.col("k")
    kind = F.when(k % 31 == 0, "A_action_execution_failure").when(k % 29 == 0, "B_sensor_observability_failure").when(~transfer & (F.col("command_family") == "remote_session"), "D_token_mapping_failure").when(~transfer, "C_parser_normalization_failure").when(F.col("size") < 2, "E_relation_linking_failure").otherwise("F_matching_or_none")
    return f.norm.join(size, ["run_id", "dependency_group"]).groupBy(kind.alias("drop_class")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- builders side by side
_BUILDER_RUNS = """SELECT builder, run_id, count(*) AS n_episodes, avg(len(ids)) AS mean_size FROM terminal GROUP BY ALL"""
_FAIR = ("full", "sliding_time", "sliding_entity", "no_guards", "no_causal")


@formed_query(formed_sql(f"""SELECT a.run_id, a.builder, a.n_episodes - b.n_episodes AS episode_delta, round(a.mean_size - b.mean_size, 9) AS size_delta FROM ({_BUILDER_RUNS}) a JOIN ({_BUILDER_RUNS}) b ON a.run_id = b.run_id AND b.builder = 'full' AND a.builder <> 'full'""", builders=_FAIR))
def paired_builders(f: FormedFrames) -> DataFrame:
    """Each builder against the full one, run by run: episodes and mean size of an episode."""
    rows = formation.form_rolls(f.aliased, list(_FAIR)).filter("is_last").groupBy("builder", "run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("n_events").alias("size"))
    rows = sinks.materialize(rows, "builder-runs")
    full = rows.filter("builder = 'full'").select("run_id", F.col("n").alias("n0"), F.col("size").alias("size0"))
    return rows.filter("builder <> 'full'").join(full, "run_id").select("run_id", "builder", (F.col("n") - F.col("n0")).alias("episode_delta"), r9(F.col("size") - F.col("size0")).alias("size_delta"))


_MODE = "CASE WHEN substr(run_id, 5, 9)::INT % 2 = 0 THEN 'attack_only' ELSE 'concurrent_benign' END"


@formed_query(formed_sql(f"""SELECT mode, count(DISTINCT run_id) AS n_runs, round(avg(contamination), 9) AS contamination, round(avg(cov), 9) AS coverage FROM (
    SELECT r.run_id, {_MODE.replace('run_id', 'r.run_id')} AS mode, contamination, cov FROM (SELECT DISTINCT run_id FROM norm) r
    LEFT JOIN (SELECT run_id, avg(CASE WHEN either > 0 THEN len(benign) / either END) AS contamination FROM matched GROUP BY run_id) m USING (run_id)
    LEFT JOIN (SELECT run_id, avg(coalesce(c, 0)) AS cov FROM truth LEFT JOIN (SELECT run_id, group_id, max(coverage) AS c FROM edges GROUP BY ALL) USING (run_id, group_id) GROUP BY run_id) t USING (run_id)) GROUP BY mode""", "matched", "truth", "edges"))  # fmt: skip
def contamination_tradeoff(f: FormedFrames) -> DataFrame:
    """Mean contamination against mean coverage, by the mode of a run: the points of a trade-off."""
    metrics = evaluation.formation_metrics(f.views, f.truth, f.edges)
    mode = F.when(F.substring("run_id", 5, 9).cast("int") % 2 == 0, "attack_only").otherwise("concurrent_benign")
    return metrics.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n_runs"), r9(F.avg("contamination")).alias("contamination"), r9(F.avg("coverage")).alias("coverage"))


@formed_query(formed_sql("""SELECT run_id, max(revision)::INT AS max_revision, count(*) AS n_revisions, count_if(state = 'closed')::BIGINT AS n_closed, count_if(late_evidence_reason IS NOT NULL)::BIGINT AS n_late_accepted, round(avg(CASE WHEN state = 'closed' THEN (watermark_us - event_us_end) / 1e6 END), 6) AS stabilization_s,
    arg_max(state, seq) AS last_state FROM formed GROUP BY run_id"""))
def revision_counts(f: FormedFrames) -> DataFrame:
    """Per run: the highest revision, how many there are, closed and late ones, seconds until an episode closes, and the last record's state."""
    closed = F.col("state") == "closed"
    return f.marks.groupBy("run_id").agg(
        F.max("revision").alias("max_revision"), F.count(F.lit(1)).alias("n_revisions"), F.count_if(closed).alias("n_closed"), F.count("late_evidence_reason").alias("n_late_accepted"),
        F.round(F.avg(F.when(closed, (F.col("watermark_us") - F.col("event_us_end")) / 1e6)), 6).alias("stabilization_s"), F.max_by("state", "seq").alias("last_state"),
    )


@formed_query(formed_sql("""SELECT run_id, episode_id, revision, state, len(ids) AS n_events FROM formed WHERE state IN ('finalized', 'closed') QUALIFY row_number() OVER (PARTITION BY run_id, episode_id ORDER BY revision DESC) = 1"""))
def latest_membership(f: FormedFrames) -> DataFrame:
    """The latest finalized or closed revision of each episode."""
    rows = f.marks.filter(F.col("state").isin("finalized", "closed"))
    return sinks.latest(rows, ["run_id", "episode_id"], "revision").select("run_id", "episode_id", "revision", "state", "n_events")


# ---------------------------------------------------------------- other orders of delivery
_ORDERS = "[('reverse', -rn), ('alternating', 2 * fn + (source_family = 'NDR')::INT)]"


@formed_query(formed_sql("""SELECT split_part(run_id, '|', 1) AS run_id, split_part(run_id, '|', 2) AS delivery, count(*) AS n_revisions, count(DISTINCT episode_id) AS n_episodes FROM formed GROUP BY run_id""", norm=f"""
    SELECT base.* REPLACE (base.run_id || '|' || o[1] AS run_id), o[2] AS arr FROM (SELECT event_id, source_family AS sf, row_number() OVER (PARTITION BY run_id ORDER BY ingest_us, event_us, source_instance, event_id) AS rn, row_number() OVER (PARTITION BY run_id, source_family ORDER BY ingest_us, event_us, source_instance, event_id) AS fn FROM base) p
    JOIN base USING (event_id), LATERAL (SELECT unnest({_ORDERS.replace('source_family', 'sf')}) AS o)""", order="arr"))  # fmt: skip
def delivery_orders(f: FormedFrames) -> DataFrame:
    """Formation is sensitive to the order of arrival: the same events reversed, or the sources taking turns."""
    order = ["ingest_us", "event_us", "source_instance", "event_id"]
    rows = f.aliased.withColumns({"rn": F.row_number().over(Window.partitionBy("run_id").orderBy(*order)), "fn": F.row_number().over(Window.partitionBy("run_id", "source_family").orderBy(*order))})
    each = {"reverse": -F.col("rn"), "alternating": 2 * F.col("fn") + (F.col("source_family") == "NDR").cast("int")}
    dealt = rows.withColumn("d", F.explode(F.array(*[F.struct(F.lit(n).alias("child"), c.cast("long").alias("arrival_seq")) for n, c in each.items()]))).select("*", "d.*").drop("d", "rn", "fn")
    formed = formation.form_rolls(dealt)
    return formed.groupBy("run_id", F.col("child").alias("delivery")).agg(F.count(F.lit(1)).alias("n_revisions"), F.countDistinct("episode_id").alias("n_episodes"))


# ---------------------------------------------------------------- checks of records and replies
_MUTATIONS = ["none", "missing_field", "extra_field", "wrong_type", "edited_value", "edited_digest", "reordered_keys", "null_digest"]


@query(sql("""SELECT mutation, CASE WHEN mutation IN ('missing_field', 'extra_field', 'wrong_type') THEN 'schema_reject' WHEN mutation IN ('edited_value', 'edited_digest', 'null_digest') THEN 'digest_reject' ELSE 'accept' END AS gate, count(*) AS n
    FROM norm, (SELECT unnest(['none', 'missing_field', 'extra_field', 'wrong_type', 'edited_value', 'edited_digest', 'reordered_keys', 'null_digest']) AS mutation) GROUP BY mutation""", "norm"))  # fmt: skip
def record_mutations(f: Frames) -> DataFrame:
    """Records changed in seven ways after they were sealed: what the gate makes of each. A change of the keys' order alone changes nothing."""
    key, action = F.col("event_id"), F.col("action")
    seal = lambda a, e: F.sha2(F.concat(F.lit('{"action":"'), a, F.lit('","event_id":"'), e, F.lit('"}')).cast("binary"), 256)
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    text = lambda *kv: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in kv]), F.lit("}"))
    d = seal(action, key)
    made = {
        "none": text(("action", q(action)), ("event_id", q(key)), ("digest", q(d))), "missing_field": text(("event_id", q(key)), ("digest", q(d))), "extra_field": text(("action", q(action)), ("event_id", q(key)), ("label", q(F.lit("x"))), ("digest", q(d))),
        "wrong_type": text(("action", F.lit("7")), ("event_id", q(key)), ("digest", q(d))), "edited_value": text(("action", q(F.concat(action, F.lit("x")))), ("event_id", q(key)), ("digest", q(d))),
        "edited_digest": text(("action", q(action)), ("event_id", q(key)), ("digest", q(F.reverse(d)))), "reordered_keys": text(("digest", q(d)), ("event_id", q(key)), ("action", q(action))), "null_digest": text(("action", q(action)), ("event_id", q(key)), ("digest", F.lit("null"))),
    }
    rows = f.norm.select(F.explode(F.array(*[F.struct(F.lit(n).alias("mutation"), c.alias("record")) for n, c in made.items()])).alias("m")).select("m.mutation", F.parse_json("m.record").alias("v"), "m.record")
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    schema_ok = (F.size(F.json_object_keys("record")) == 3) & get("event_id").isNotNull() & get("action").rlike("^[a-z_.]+$") & F.array_contains(F.json_object_keys("record"), "digest")
    gate = F.when(~F.coalesce(schema_ok, F.lit(False)), "schema_reject").when(F.coalesce(get("digest") == seal(get("action"), get("event_id")), F.lit(False)), "accept").otherwise("digest_reject")
    return rows.groupBy("mutation", gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


_REPLY = """CASE WHEN k % 9 = 0 THEN 'no json' ELSE '{"answer": ' || CASE WHEN k % 4 = 3 THEN 'null' WHEN k % 10 = 5 THEN (k + 1)::VARCHAR ELSE k::VARCHAR END || ', "abstain": ' || CASE WHEN k % 4 = 3 THEN 'true' ELSE 'false' END || ', "refs": ["/k"' || CASE WHEN k % 7 = 2 THEN ', "/made/up"' ELSE '' END || ']}' END"""
_CATEGORY = "CASE WHEN k % 4 = 3 THEN 'abstention' WHEN k % 2 = 0 THEN 'extraction' ELSE 'conflict' END"


@query(f"""SELECT category, count(*) AS total, count_if(shape)::BIGINT AS shape_ok, count_if(answer)::BIGINT AS answer_ok, count_if(abstain)::BIGINT AS abstain_ok, count_if(refs)::BIGINT AS refs_ok, count_if(shape AND answer AND abstain AND refs)::BIGINT AS exact_pass, sum(invalid)::BIGINT AS invalid_refs FROM (
    SELECT {_CATEGORY} AS category, k % 9 <> 0 AS shape, k % 9 <> 0 AND (k % 4 = 3 OR k % 10 <> 5) AS answer, k % 9 <> 0 AS abstain, k % 9 <> 0 AND k % 7 <> 2 AS refs, (k % 9 <> 0 AND k % 7 = 2)::INT AS invalid FROM (SELECT (props->>'$.k')::INT AS k FROM events)) GROUP BY category""")
def reply_checks(f: Frames) -> DataFrame:
    """Replies of a model about records: shape, answer, abstention and references against the record, totals by category."""
    rows = f.table("events").select("props", F.get_json_object("props", "$.k").cast("int").alias("k")).select("props", "k", F.expr(_CATEGORY).alias("category"), F.try_parse_json(F.expr(_REPLY.replace("::VARCHAR", "||''"))).alias("v"))
    record = F.parse_json("props")
    refs = F.try_variant_get("v", "$.refs", "array<string>")
    shape = F.try_variant_get("v", "$.abstain", "boolean").isNotNull() & refs.isNotNull()
    stated, away = F.try_variant_get("v", "$.answer", "double"), F.try_variant_get("v", "$.abstain", "boolean")
    should = F.col("category") == "abstention"
    real = F.transform(refs, lambda p: F.when(p == "/k", firewall.json_pointer(record, "/k").isNotNull()).otherwise(False))
    checks = rows.select("category", F.coalesce(shape, F.lit(False)).alias("shape"), (F.coalesce(shape, F.lit(False)) & F.when(should, stated.isNull()).otherwise(F.coalesce(F.abs(stated - F.col("k")) <= 1e-12, F.lit(False)))).alias("answer"), F.coalesce(away == should, F.lit(False)).alias("abstain"),
                         F.coalesce(F.forall(real, lambda x: x), F.lit(False)).alias("refs"), F.coalesce(F.size(F.filter(real, lambda x: ~x)), F.lit(0)).alias("invalid"))
    checks = checks.withColumn("invalid", F.greatest("invalid", F.lit(0)))
    return checks.groupBy("category").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in (("shape_ok", "shape"), ("answer_ok", "answer"), ("abstain_ok", "abstain"), ("refs_ok", "refs"))], F.count_if(F.col("shape") & F.col("answer") & F.col("abstain") & F.col("refs")).alias("exact_pass"), F.sum("invalid").alias("invalid_refs"))

