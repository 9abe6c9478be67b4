"""Registered queries of what is stored and read back: scans of many files, bundles, and the log of a store's operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import assembly, oplog
from wakeline.plans import catalog_study
from wakeline.plans.catalog import query
from wakeline.plans.catalog_study import _REGISTRY
from wakeline.plans.ctes import sql
from wakeline.plans.frames import EPISODE, Frames
from wakeline.sources import adapters, bundles, sealed, sinks


def _folder(f: Frames, name: str) -> str:
    return f"{sinks.shared_dir(f.spark).rstrip('/')}/wakeline-{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scans
#: Lines of a file. Small, as the test tables are.
FILE_LINES = 500
#: A line for each event: an object, or what a scan has to reject.
_LINE = """CASE WHEN k % 16 = 3 THEN '' WHEN k % 16 = 5 THEN '[' || event_id || ']' WHEN k % 16 = 7 THEN '{"k": NaN}'
    WHEN k % 16 = 9 THEN '{"object_type": "' || event_type || '"' WHEN k % 16 = 11 THEN '{"k": 9007199254740993}' WHEN k % 16 = 13 THEN '{"k": ' || k || '}'
    ELSE '{"object_type": "' || event_type || '", "event_id": ' || event_id || ', "k": ' || k || '}' END"""
_REASON = """CASE k % 16 WHEN 5 THEN 'not_object' WHEN 7 THEN 'invalid' WHEN 9 THEN 'invalid' WHEN 11 THEN 'range' WHEN 13 THEN 'no_type'
    ELSE CASE WHEN k > 90 THEN 'contract' END END"""


@query(f"""SELECT file_no, line, object_type, reason FROM (SELECT event_id // {FILE_LINES} AS file_no,
        row_number() OVER (PARTITION BY event_id // {FILE_LINES} ORDER BY event_id) AS line, k,
        {_REASON} AS reason, CASE WHEN ({_REASON}) IS NULL THEN event_type END AS object_type
    FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)) WHERE k % 16 <> 3 AND (reason IS NOT NULL OR object_type IN ('click', 'error'))""")
def object_scan(f: Frames) -> DataFrame:
    """Objects of two types in many files of JSON lines, and the lines that are rejected, with the reason; k above 90 breaks the contract."""
    path = _folder(f, "objects")
    k = F.get_json_object("props", "$.k").cast("int")
    lines = f.table("events").select("event_id", "event_type", k.alias("k"), F.floor(F.col("event_id") / FILE_LINES).alias("file_no"))
    lines = lines.repartition("file_no").sortWithinPartitions("file_no", "event_id")
    lines.select("file_no", F.expr(_LINE).alias("value")).write.partitionBy("file_no").text(path)
    good, bad = bundles.scan_objects(f.spark, [path], ["click", "error"], "coalesce(try_variant_get(v, '$.k', 'int'), 0) <= 90")
    none = F.lit(None).cast("string")
    rows = good.select("file", "line", "object_type", none.alias("reason")).unionByName(bad.select("file", "line", none.alias("object_type"), "reason"))
    return rows.select(F.regexp_extract("file", r"file_no=(\d+)", 1).cast("long").alias("file_no"), F.col("line").cast("long").alias("line"), "object_type", "reason")


# ---------------------------------------------------------------- bundles
def _object(fields: dict[str, str]) -> str:
    """SQL of an object's canonical JSON: text and numbers by column, keys in order."""
    texts = [f"""'"{name}":' || {f"coalesce('{chr(34)}' || {c} || '{chr(34)}', 'null')" if kind == "t" else f"coalesce({c}::VARCHAR, 'null')"}""" for name, (kind, c) in
             sorted((n, c.split(":", 1)) for n, c in fields.items())]
    return "'{' || " + " || ',' || ".join(texts) + " || '}'"


_EVENT = {"event_id": "t:event_id", "event_us": "n:event_us", "parent_pid": "t:parent_pid", "run_id": "t:run_id", "subject": "t:subject"}
_HEALTH = {"health": "t:health", "lag_s": "n:lag_s::INT", "parser_valid": "n:parser_valid", "run_id": "t:run_id", "source_instance": "t:source_instance", "start_us": "n:start_us"}


@query(sql(f"""SELECT name, sha256(record) AS record_sha256, count(*) AS n, max(strlen(record)) AS n_bytes FROM (
    SELECT 'online/' || lower(source_family) AS name, {_object(_EVENT)} AS record FROM norm UNION ALL SELECT 'online/health', {_object(_HEALTH)} FROM cov) GROUP BY ALL""", "norm", "cov"))  # fmt: skip
def bundle_records(f: Frames) -> DataFrame:
    """Events by family and the coverage of their sources as a bundle of canonical JSON, and what a checked scan of the bundle finds in it."""
    path = _folder(f, "bundle")
    events = f.norm.select(*_EVENT, "source_family")
    frames = {f"online/{family.lower()}": events.filter(F.col("source_family") == family).drop("source_family") for family in ("EDR", "NDR")}
    bundles.save_bundle(frames | {"online/health": f.coverage.select(*_HEALTH)}, path, "telemetry", {"tables": ["events"]})
    found = bundles.read_bundle(f.spark, path).groupBy("name", F.sha2("record", 256).alias("record_sha256"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("record")).cast("long").alias("n_bytes"))


# ---------------------------------------------------------------- the log of a store
_KEY, _ORDER = ["run_id", "dependency_group"], ["event_us", "event_id"]
_OP = """CASE WHEN source_family = 'EDR' THEN CASE WHEN parent_pid IS NULL THEN 'failure' ELSE 'success' END
    WHEN eve_event_type = 'alert' THEN 'update' WHEN object LIKE 'obj:shared%' THEN 'delete' ELSE 'late' END"""
_LOG = {
    "log": f"""SELECT run_id, dependency_group, event_id, {_OP} AS op, action AS content, [subject, object] AS refs, ingest_us - event_us <= 60000000 AS within,
        row_number() OVER (PARTITION BY run_id, dependency_group ORDER BY event_us, event_id) AS n FROM norm""",
    "met": """SELECT *, min(CASE WHEN op IN ('success', 'failure') THEN n END) OVER w AS first_n, min(CASE WHEN op = 'success' THEN n END) OVER w AS success_n,
        arg_max(CASE WHEN op IN ('success', 'update', 'delete') THEN op END, CASE WHEN op IN ('success', 'update', 'delete') THEN n END)
            OVER (PARTITION BY run_id, dependency_group ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS control
        FROM log WINDOW w AS (PARTITION BY run_id, dependency_group)""",
    "judged": """SELECT m.*, t.op AS first_op, t.content AS first_content, coalesce(control <> 'delete', false) AS there, coalesce(success_n < m.n, false) AS after
        FROM met m LEFT JOIN log t ON t.run_id = m.run_id AND t.dependency_group = m.dependency_group AND t.n = m.first_n""",
    "folded": """SELECT run_id, dependency_group, event_id, n, op, refs, 'mutable' AS variant, CASE WHEN op = 'failure' THEN 'lost'
            WHEN op IN ('success', 'update') THEN CASE WHEN there THEN 'changed' ELSE 'stored' END
            WHEN op = 'delete' THEN CASE WHEN there THEN 'removed' ELSE 'ignored' END WHEN there THEN 'changed' ELSE 'ignored' END AS outcome FROM judged
        UNION ALL SELECT run_id, dependency_group, event_id, n, op, refs, v, CASE op WHEN 'failure' THEN 'lost' WHEN 'success' THEN 'appended' WHEN 'late'
            THEN CASE WHEN NOT after THEN 'ignored' WHEN v = 'silent' THEN 'successor' ELSE 'replaced' END ELSE 'rejected' END
            FROM judged, (VALUES ('noncanonical'), ('silent')) AS x(v)
        UNION ALL SELECT run_id, dependency_group, event_id, n, op, refs, 'append_only', CASE WHEN op IN ('success', 'failure') THEN CASE WHEN n = first_n THEN 'stored'
            WHEN op = first_op AND content = first_content THEN 'idempotent' ELSE 'rejected' END
            WHEN op = 'late' AND after AND first_op = 'success' THEN CASE WHEN within THEN 'successor' ELSE 'late_record' END ELSE 'rejected' END FROM judged""",
}
_LEFT = "('stored', 'appended', 'successor', 'late_record')"
_ALTERED = "('changed', 'replaced', 'removed')"


def _folded(f: Frames) -> DataFrame:
    ops = f.norm.select(*_KEY, *_ORDER, F.expr(_OP).alias("op"), F.col("action").alias("content"), F.array("subject", "object").alias("refs"), (F.col("ingest_us") - F.col("event_us") <= 60_000_000).alias("within"))
    return oplog.fold_log(ops, _KEY, _ORDER, F.floor(F.col("event_us") / 600_000_000))


@query(sql(f"""SELECT run_id, dependency_group, variant, count(*) AS n_ops, count_if(outcome IN {_LEFT})::BIGINT AS records, count_if(outcome IN {_ALTERED})::BIGINT AS altered,
    count_if(outcome = 'lost')::BIGINT AS lost, count_if(outcome = 'rejected')::BIGINT AS rejected, count_if(outcome = 'idempotent')::BIGINT AS idempotent,
    CASE variant WHEN 'mutable' THEN 0 WHEN 'append_only' THEN count_if(outcome = 'successor') ELSE count_if(outcome IN ('successor', 'replaced')) END::BIGINT AS revision
    FROM folded GROUP BY run_id, dependency_group, variant""", "norm", steps=_LOG))  # fmt: skip
def store_states(f: Frames) -> DataFrame:
    """What four designs of a store hold of each key when the log of attempts, evidence, updates and deletes is folded."""
    return oplog.store_state(_folded(f), _KEY)


@query(sql(f"""SELECT variant, count(*) AS n_ops, count_if(op = 'late' AND outcome IN {_ALTERED}) = 0 AS immutable_under_late,
    count_if(kept AND NOT same) = 0 AS byte_identical_replay, round(count_if(kept AND same) / nullif(count_if(kept), 0), 9) AS replay_rate,
    count_if(op = 'failure' AND outcome = 'lost') = 0 AS explicit_failure,
    count_if(op IN ('success', 'update', 'delete') AND outcome IN {_ALTERED}) = 0 AS append_only,
    count_if(op IN ('success', 'failure') AND outcome = 'rejected')::BIGINT AS conflicts_found
    FROM (SELECT *, outcome IN {_LEFT} OR outcome IN ('changed', 'replaced') AS kept, variant <> 'noncanonical' OR refs[1] = refs[2] AS same FROM folded)
    GROUP BY variant""", "norm", steps=_LOG))  # fmt: skip
def store_property_table(f: Frames) -> DataFrame:
    """Which properties each design kept over the whole log: the ablation of the store's contract."""
    return oplog.store_properties(_folded(f))


# ---------------------------------------------------------------- terminal records under faults
#: No fault, each fault alone, and each with all faults of lower rank.
FAULTS = ["none", *assembly.CODES, *[f"{c}+" for c in assembly.CODES]]
_VERSIONS = {t: f"{t}.v1" for t in assembly.INPUTS[1:]}
_LIMIT_US = 60_000_000
_RANK = "CASE " + " ".join(f"WHEN fault IN ('{c}', '{c}+') THEN {i}" for i, c in enumerate(assembly.CODES)) + " ELSE 7 END"


def _faulty(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Every episode of fixed bins once a fault, and its seven inputs (no coverage where a family has none), spoilt by the fault.

    What an input says is the episode's own; the fault is what is put in, as in a test of conformance.
    """
    rows = f.supported.withColumn("fault", F.explode(F.array(*[F.lit(x) for x in FAULTS])))
    own = F.sha2(F.concat_ws("|", *EPISODE).cast("binary"), 256)
    has = lambda code: (F.col("fault") == code) | (F.col("fault").endswith("+") & (F.expr(_RANK) <= assembly.CODES.index(code)))
    elapsed = F.when(has("assembly_timeout"), _LIMIT_US + 1).otherwise(_LIMIT_US).cast("long")
    revisions = rows.select(*EPISODE, "fault", own.alias("revision_digest"), elapsed.alias("elapsed_us"))
    says = F.to_json(F.struct(*EPISODE, "kappa"))
    each = []
    for kind in assembly.INPUTS:
        content = F.concat(F.lit(kind), F.lit(":"), says)
        there = ~F.lit(kind == "SourceCoverage") | ~(F.col("e_missing") | F.col("n_missing") | has("missing_input"))
        one = F.struct(
            F.lit(kind).alias("input_type"), (~(F.lit(kind == "RawLogit") & has("schema_invalid"))).alias("valid"),
            F.when(F.lit(kind == "SupportDecision") & has("key_mismatch"), F.lit("other")).otherwise(own).alias("revision_digest"), content.alias("content"),
            F.when(F.lit(kind == "UProfile") & has("digest_mismatch"), F.sha2(F.lit("else"), 256)).otherwise(F.sha2(content.cast("binary"), 256)).alias("stated_digest"),
            F.when(F.lit(kind == "CalibratedProbability") & has("version_mismatch"), F.lit("v0")).otherwise(F.lit(f"{kind}.v1")).alias("version"),
        )
        each.append(F.when(there, one))
        if kind == "FeatureVector":
            twin = F.concat(content, F.lit("!"))
            each.append(F.when(has("conflicting_duplicate"), one.withField("content", twin).withField("stated_digest", F.sha2(twin.cast("binary"), 256))))
    return revisions, rows.select(*EPISODE, "fault", F.inline(F.array_compact(F.array(*each))))


_FAULT_VALUES = ", ".join(f"('{x}')" for x in FAULTS)
_CODE = "CASE " + " ".join(f"WHEN code_at = {i} THEN '{c}'" for i, c in enumerate(assembly.CODES)) + " END"


@query(sql(f"""SELECT run_id, fault, {_CODE} AS failure_code, count(*) AS n_episodes, sum(7 - uncovered::INT)::BIGINT AS n_observed,
    sum(7 - uncovered::INT + twin::INT)::BIGINT AS n_inputs FROM (
    SELECT *, least(rank, CASE WHEN gone THEN 5 ELSE 7 END) AS code_at FROM (
        SELECT run_id, fault, e_missing OR n_missing AS gone, e_missing OR n_missing OR fault = 'missing_input' OR (fault LIKE '%+' AND {_RANK} <= 5) AS uncovered,
            fault = 'conflicting_duplicate' OR (fault LIKE '%+' AND {_RANK} <= 2) AS twin, {_RANK} AS rank FROM support, (VALUES {_FAULT_VALUES}) AS v(fault)))
    GROUP BY run_id, fault, failure_code""", "support"))  # fmt: skip
def assembly_conformance(f: Frames) -> DataFrame:
    """How many episodes of each run end with which terminal record, under no fault, each fault, and each with all of lower rank."""
    ended = assembly.assemble(*_faulty(f), [*EPISODE, "fault"], _VERSIONS, _LIMIT_US)
    return ended.groupBy("run_id", "fault", "failure_code").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum(F.size("observed")).cast("long").alias("n_observed"), F.sum("n_inputs").cast("long").alias("n_inputs"),
    )


# ---------------------------------------------------------------- sealed runs
_TRUTH = {"end_us": "n:end_us", "group_id": "t:group_id", "run_id": "t:run_id", "start_us": "n:start_us"}
_WANTED = "status = 'sealed' AND partition = 'locked_test'"
_SUMS = ", ".join(f"sum(('0x' || substr(d, {16 * i + 1}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))


@query(sql(f"""SELECT run_id, name, n_records, sha256(whole) AS run_digest FROM (
        SELECT run_id, name, count(*) AS n_records FROM digests GROUP BY ALL) JOIN (
        SELECT run_id, concat_ws('|', count(*)::VARCHAR, {_SUMS}) AS whole FROM digests GROUP BY run_id) USING (run_id)
    WHERE run_id IN (SELECT run_id FROM ({_REGISTRY}) WHERE {_WANTED})""", "norm", "cov", "truth", steps={
    "digests": f"""SELECT run_id, name, sha256(name || chr(31) || record) AS d FROM (
        SELECT run_id, 'inputs/' || source_instance AS name, {_object(_EVENT)} AS record FROM norm UNION ALL
        SELECT run_id, 'health/' || source_instance, {_object(_HEALTH)} FROM cov UNION ALL SELECT run_id, 'offline/truth', {_object(_TRUTH)} FROM truth)""",
}))
def sealed_inputs(f: Frames) -> DataFrame:
    """All runs sealed as one bundle (events and coverage of three sources, ground truth), then the sealed runs for tests loaded again: the digests found
    in the bundle must be those that the registry took from the tables."""
    path = _folder(f, "sealed")
    sources = [instance for _, instance, _ in adapters.INSTANCES]
    at = lambda df, i, names: df.filter(F.col("source_instance") == i).select(*names)
    frames = {f"inputs/{i}": at(f.norm, i, _EVENT) for i in sources} | {f"health/{i}": at(f.coverage, i, _HEALTH) for i in sources} | {"offline/truth": f.truth.select(*_TRUTH)}
    registry = sinks.materialize(sealed.seal(frames, catalog_study.registry(f), path), "sealed-registry")
    records = sealed.load_sealed(f.spark, path, registry, registry.filter(_WANTED))
    return records.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("n_records")).join(registry.select("run_id", "run_digest"), "run_id")
