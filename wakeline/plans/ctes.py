"""The adapters and intermediate frames once more, as SQL (DuckDB), so that oracles can be put together from them."""

from __future__ import annotations

from wakeline.operators.detectors import FLOW, PERSISTENCE, PRIVATE, PROCESS, REMOTE, TRANSFER
from wakeline.plans.formation_sql import formation_ctes
from wakeline.sources.adapters import EPOCH_US, INSTANCES


def case(column: str, values: dict[str, float], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"


#: One keyed draw in [0, 1) for each key, as SQL: see wakeline.functions.hashing.
HEX_XOR = "unhex(array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(CASE WHEN i < 32 THEN ('0x' || substr({}, 2 * i + 1, 2))::INT ELSE 0 END, {}))), ''))"
_INSTANCES = ", ".join(f"('{f}', '{i}', {n})" for f, i, n in INSTANCES)

CTES: dict[str, tuple[list[str], str]] = {
    "raw": ([], f"""SELECT *, (props->>'$.k')::BIGINT AS k, {EPOCH_US} + floor((epoch_us(ts) - {EPOCH_US}) / 200)::BIGINT AS event_us, event_type IN ('signup', 'error') AS edr, user_id // 10 AS run_no FROM events"""),
    "norm": (["raw"], """SELECT 'run:' || lpad(run_no::VARCHAR, 9, '0') AS run_id, 'ev:' || lpad(event_id::VARCHAR, 12, '0') AS event_id, event_us,
        event_us + (CASE WHEN k >= 98 THEN 1500 WHEN k >= 95 THEN 400 ELSE k % 7 END) * 1000000 AS ingest_us,
        CASE WHEN edr THEN 'EDR' ELSE 'NDR' END AS source_family,
        CASE WHEN edr THEN 'edr-target-0' || (user_id % 2 + 1) ELSE 'ndr-gateway-01' END AS source_instance,
        CASE WHEN edr THEN 'user:' || lpad(user_id::VARCHAR, 9, '0') ELSE 'ip:10.' || (user_id // 65536) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) END AS subject,
        CASE WHEN k % 25 = 0 THEN 'obj:shared:' || run_no WHEN event_type = 'purchase' THEN 'ip:192.168.0.' || (k % 20) WHEN event_type = 'click' THEN 'ip:93.184.216.' || (k % 20) ELSE 'obj:' || user_id || ':' || (k % 20) END AS object,
        CASE event_type WHEN 'signup' THEN 'process.start.remote_session' WHEN 'error' THEN 'process.start.file_change' ELSE 'network.flow' END AS action,
        'g:' || user_id || ':' || (k // 10) AS dependency_group,
        CASE event_type WHEN 'signup' THEN 'remote_session' WHEN 'error' THEN 'file_change' END AS command_family,
        CASE event_type WHEN 'purchase' THEN 'ssh' WHEN 'click' THEN 'http' END AS protocol,
        CASE WHEN edr THEN NULL WHEN event_type = 'purchase' THEN 'alert' WHEN event_type = 'click' THEN 'http' ELSE 'flow' END AS eve_event_type,
        CASE WHEN edr THEN NULL ELSE least(value / 500, 1.0::DOUBLE) END AS severity,
        'user:' || lpad(user_id::VARCHAR, 9, '0') AS endpoint_key,
        CASE WHEN k % 50 = 49 THEN NULL WHEN k % 40 = 39 THEN 'host-x' ELSE 'host-' || (user_id % 5) END AS endpoint_host,
        CASE WHEN edr AND k % 33 <> 0 THEN CASE WHEN k % 20 = 19 THEN 'p2' ELSE 'p1' END END AS parent_pid, k
        FROM raw"""),
    "cov": (["norm"], f"""SELECT run_id, f AS source_family, i AS source_instance, no AS interval_no, no * 600000000 AS start_us, (no + 1) * 600000000 AS end_us,
        CASE (no * 7 + n) % 11 WHEN 0 THEN 'down' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unknown' ELSE 'healthy' END AS health,
        (no * 5 + n) % 13 <> 0 AS parser_valid, (no * 3 + n) % 17 <> 0 AS transport_live, (no % 7)::DOUBLE AS lag_s
        FROM (SELECT run_id, unnest(range(min(event_us) // 600000000, max(event_us) // 600000000 + 1)) AS no FROM norm GROUP BY run_id), (VALUES {_INSTANCES}) AS s(f, i, n)
        WHERE (no * 3 + n) % 19 <> 0"""),
    "truth": (["norm"], """SELECT run_id, endpoint_key || '@' || bucket AS group_id, start_us, end_us, endpoint_key AS entity, required_tokens FROM (
        SELECT run_id, endpoint_key, event_us // 1800000000 AS bucket, min(event_us) AS start_us, max(event_us) AS end_us, count(*) AS n,
               list_sort(list(DISTINCT action) FILTER (source_family = 'EDR')) AS required_tokens FROM norm GROUP BY ALL) WHERE n >= 2 AND len(required_tokens) > 0"""),
    "binned": (["norm"], """SELECT n.*, (n.event_us - t0) // 300000000 AS bin_no FROM norm n JOIN (SELECT run_id, min(event_us) AS t0 FROM norm GROUP BY run_id) USING (run_id)"""),
    "members": (["binned"], """SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY bin_no) - 1 AS episode_no FROM binned"""),
    "det": (["members"], f"""SELECT * FROM (SELECT members.*, unnest([
        {{'detector_id': 'edr.process_anomaly.v1', 'value': CASE WHEN source_family = 'EDR' THEN {case("coalesce(command_family, 'process_execution')", PROCESS, '0.2::DOUBLE')} END}},
        {{'detector_id': 'edr.remote_execution.v1', 'value': CASE WHEN source_family = 'EDR' THEN {case('command_family', REMOTE)} END}},
        {{'detector_id': 'edr.persistence_change.v1', 'value': CASE WHEN source_family = 'EDR' THEN {case('command_family', PERSISTENCE)} END}},
        {{'detector_id': 'ndr.flow_anomaly.v1', 'value': CASE WHEN source_family = 'NDR' THEN greatest({case('eve_event_type', FLOW, '0.15::DOUBLE')}, severity) END}},
        {{'detector_id': 'ndr.lateral_session.v1', 'value': CASE WHEN source_family = 'NDR' AND protocol = 'ssh' AND regexp_matches(subject, '{PRIVATE}') AND regexp_matches(object, '{PRIVATE}') THEN 0.9::DOUBLE END}},
        {{'detector_id': 'ndr.transfer_anomaly.v1', 'value': CASE WHEN source_family = 'NDR' THEN {case('protocol', TRANSFER)} END}}], recursive := true) FROM members) WHERE value IS NOT NULL"""),
    "dedup": (["det"], """SELECT run_id, episode_no, source_family, detector_id, dependency_group, value, event_id FROM det
        QUALIFY row_number() OVER (PARTITION BY run_id, episode_no, source_family, detector_id, dependency_group ORDER BY value DESC, sha256(event_id), event_id) = 1"""),
    "cohort": (["dedup"], "SELECT detector_id, value FROM dedup WHERE substr(run_id, -1) IN ('0', '2', '4', '6', '8')"),
    "ecdf": (["dedup", "cohort"], """SELECT d.*, (c.below + 0.5::DOUBLE * c.same) / c.size AS normalized FROM dedup d JOIN (
        SELECT v.detector_id, v.value, count_if(c.value < v.value) AS below, count_if(c.value = v.value) AS same, count(*) AS size
        FROM (SELECT DISTINCT detector_id, value FROM dedup) v JOIN cohort c USING (detector_id) GROUP BY ALL) c USING (detector_id, value)"""),
    "feat": (["ecdf"], """SELECT run_id, episode_no,
        (max(normalized) FILTER (pos = 1) + coalesce(max(normalized) FILTER (pos = 2), 0) + coalesce(max(normalized) FILTER (pos = 3), 0)) / least(count(*), 3) AS d,
        max((source_family = 'EDR')::INT) * max((source_family = 'NDR')::INT) AS c, count(*) AS eligible_count, max((source_family = 'EDR')::INT) AS edr_detected, max((source_family = 'NDR')::INT) AS ndr_detected
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id, episode_no ORDER BY normalized DESC, detector_id, dependency_group) AS pos FROM ecdf) GROUP BY run_id, episode_no"""),
    "bounds": (["members"], "SELECT run_id, episode_no, min(event_us) AS start_us, max(event_us) AS end_us, count(*) AS n_events FROM members GROUP BY ALL"),
    "at_end": (["bounds", "cov"], f"""SELECT b.run_id, b.episode_no, f AS source_family, i AS source_instance, b.end_us AS point_us, c.start_us, c.health, c.parser_valid, c.transport_live, c.lag_s
        FROM bounds b CROSS JOIN (VALUES {_INSTANCES}) AS s(f, i, n)
        LEFT JOIN cov c ON c.run_id = b.run_id AND c.source_family = f AND c.source_instance = i AND c.start_us <= b.end_us AND b.end_us < c.end_us"""),
    "health": (["at_end"], """SELECT run_id, episode_no, source_family, missing, CASE WHEN missing THEN 'unknown' ELSE health END AS health, NOT missing AND p AS parser_valid, NOT missing AND t AS transport_live, coalesce(lag, 0) AS lag_s FROM (
        SELECT run_id, episode_no, source_family, count(health) < count(*) AS missing,
               arg_max(health, CASE health WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 WHEN 'not_applicable' THEN 2 WHEN 'down' THEN 3 ELSE 4 END) AS health,
               coalesce(bool_and(parser_valid), false) AS p, coalesce(bool_and(transport_live), false) AS t, max(lag_s) AS lag FROM at_end GROUP BY ALL)"""),
    "sides": (["health"], """SELECT e.run_id, e.episode_no, e.missing AS e_missing, e.health AS e_health, e.parser_valid AS e_parser_valid, e.transport_live AS e_transport_live,
        n.missing AS n_missing, n.health AS n_health, n.parser_valid AS n_parser_valid, n.transport_live AS n_transport_live
        FROM health e JOIN health n USING (run_id, episode_no) WHERE e.source_family = 'EDR' AND n.source_family = 'NDR'"""),
    "support": (["feat", "sides"], """SELECT *, CASE WHEN reason = 'eligible' THEN 'supported_global' ELSE 'out_of_support' END AS kappa FROM (SELECT *, CASE
        WHEN eligible_count = 0 THEN 'no_eligible_detector_value' WHEN e_missing OR n_missing THEN 'source_out_of_support'
        WHEN NOT e_parser_valid OR NOT n_parser_valid THEN 'parser_out_of_support'
        WHEN e_health IN ('down', 'unknown', 'not_applicable') OR n_health IN ('down', 'unknown', 'not_applicable') THEN 'source_out_of_support'
        WHEN NOT e_transport_live OR NOT n_transport_live THEN 'source_out_of_support' ELSE 'eligible' END AS reason FROM feat JOIN sides USING (run_id, episode_no))"""),
    "contra": (["members"], """SELECT run_id, episode_no, CASE WHEN max(kinds) > 1 THEN 'present' WHEN bool_or(gaps) THEN 'unevaluable' ELSE 'none' END AS contradiction FROM (
        SELECT run_id, episode_no, key, count(DISTINCT v) AS kinds, count(v) < count(*) AS gaps FROM (
            SELECT run_id, episode_no, 'endpoint|' || endpoint_key AS key, endpoint_host AS v FROM members
            UNION ALL SELECT run_id, episode_no, 'process|' || dependency_group, parent_pid FROM members WHERE source_family = 'EDR') GROUP BY ALL) GROUP BY ALL"""),
    "views": (["members"], """SELECT run_id, episode_no, min(event_us) AS start_us, max(event_us) AS end_us, list_sort(list(DISTINCT endpoint_key)) AS entities, list_sort(list(DISTINCT action)) AS tokens FROM members GROUP BY ALL"""),
    "pairs": (["views", "truth"], """SELECT v.run_id, v.episode_no, t.group_id, list_intersect(tokens, required_tokens) AS attack, len(list_intersect(tokens, required_tokens)) / len(required_tokens) AS coverage,
        len(list_intersect(v.entities, [t.entity])) / len(list_distinct(v.entities || [t.entity])) AS jaccard,
        CASE WHEN greatest(v.end_us, t.end_us) > least(v.start_us, t.start_us) THEN greatest(least(v.end_us, t.end_us) - greatest(v.start_us, t.start_us), 0) / (greatest(v.end_us, t.end_us) - least(v.start_us, t.start_us)) WHEN v.start_us = t.start_us THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS iou
        FROM views v JOIN truth t ON v.run_id = t.run_id AND list_contains(v.entities, t.entity)"""),
    "weighed": (["pairs"], "SELECT *, 0.5::DOUBLE * coverage + 0.3::DOUBLE * jaccard + 0.2::DOUBLE * iou AS weight FROM pairs WHERE coverage > 0"),
    "edges": (["weighed"], "SELECT * FROM weighed WHERE jaccard >= 0.2::DOUBLE AND iou >= 0.02::DOUBLE AND weight >= 0.3::DOUBLE"),
    "matched": (["views", "edges"], """SELECT v.*, e.* EXCLUDE (run_id, episode_no), list_filter(tokens, lambda t: t = 'network.flow') AS benign, len(list_distinct(list_filter(tokens, lambda t: t = 'network.flow') || attack)) AS either
        FROM views v LEFT JOIN (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY run_id, episode_no ORDER BY coverage DESC, weight DESC, group_id) = 1) e USING (run_id, episode_no)"""),
    "labelled": (["matched"], """SELECT run_id, episode_no, group_id, coalesce(coverage, 0) AS coverage, contamination,
        CASE WHEN group_id IS NULL THEN CASE WHEN len(benign) > 0 THEN 'negative' ELSE 'ambiguous' END WHEN coverage >= 0.5 AND contamination >= 0.25 THEN 'mixed' WHEN coverage >= 0.5 AND contamination < 0.25 THEN 'positive' ELSE 'ambiguous' END AS label
        FROM (SELECT *, CASE WHEN either > 0 THEN len(benign) / either END AS contamination FROM matched)"""),
    "scored": ([], "SELECT source AS grp, d.doc_id, least(n_chars / 5000, 1.0::DOUBLE) AS score, least(n_chars / 5000, 1.0::DOUBLE) AS p, quality AS label FROM documents d JOIN labels USING (doc_id)"),
}


#: The same frames over all revisions of formed episodes: episode_no is then the episode's id and revision.
FORMED: dict[str, tuple[list[str], str]] = CTES | {
    "members": (["norm"], """SELECT n.*, f.episode_id || '#' || f.revision AS episode_no FROM (SELECT run_id, episode_id, revision, unnest(ids) AS event_id FROM formed) f JOIN norm n USING (run_id, event_id)"""),
    "last": ([], "SELECT run_id, episode_id || '#' || revision AS episode_no FROM terminal"),
    "truth": (["norm"], """SELECT run_id, endpoint_key || '@' || bucket AS group_id, start_us, end_us, entities, list_sort(list_distinct(flatten(tokens))) AS required_tokens FROM (
        SELECT run_id, endpoint_key, event_us // 1800000000 AS bucket, min(event_us) AS start_us, max(event_us) AS end_us, list_sort(list_distinct(flatten(list([a.subject, a.object])))) AS entities,
               list([action, 'command_family:' || command_family]) AS tokens FROM norm JOIN aliased a USING (run_id, event_id, event_us, source_family) WHERE source_family = 'EDR' GROUP BY ALL HAVING count(*) >= 2)"""),
    "views": (["members", "last"], """SELECT run_id, episode_no, min(event_us) AS start_us, max(event_us) AS end_us, list_sort(list_distinct(flatten(list([a.subject, a.object])))) AS entities,
        list_sort(list_distinct(flatten(list(CASE WHEN command_family IS NULL THEN [action] ELSE [action, 'command_family:' || command_family] END)))) AS tokens
        FROM members JOIN last USING (run_id, episode_no) JOIN aliased a USING (run_id, event_id, event_us) GROUP BY ALL"""),
    "pairs": (["views", "truth"], """SELECT v.run_id, v.episode_no, t.group_id, list_intersect(tokens, required_tokens) AS attack, len(list_intersect(tokens, required_tokens)) / len(required_tokens) AS coverage,
        len(list_intersect(v.entities, t.entities)) / len(list_distinct(v.entities || t.entities)) AS jaccard,
        CASE WHEN greatest(v.end_us, t.end_us) > least(v.start_us, t.start_us) THEN greatest(least(v.end_us, t.end_us) - greatest(v.start_us, t.start_us), 0) / (greatest(v.end_us, t.end_us) - least(v.start_us, t.start_us)) WHEN v.start_us = t.start_us THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS iou
        FROM views v JOIN truth t ON v.run_id = t.run_id AND list_has_any(v.entities, t.entities)"""),
    "edges": (["weighed"], "SELECT * FROM weighed WHERE jaccard >= 0.5::DOUBLE AND iou >= 0.1::DOUBLE AND weight >= 0.5::DOUBLE"),
    "unconflicted": CTES["labelled"],
    "labelled": (["unconflicted"], """SELECT run_id, episode_no, CASE WHEN ok THEN group_id END AS group_id, CASE WHEN ok THEN coverage ELSE 0 END AS coverage, CASE WHEN ok THEN contamination END AS contamination, CASE WHEN ok THEN label ELSE 'ambiguous' END AS label
        FROM (SELECT *, substr(run_id, 5, 9)::INT % 7 <> 5 AS ok FROM unconflicted)"""),
    "train": (["norm"], """SELECT run_id FROM (SELECT run_id, row_number() OVER (ORDER BY sha256('7' || chr(31) || run_id), run_id) - 1 AS pos FROM (SELECT DISTINCT run_id FROM norm)) WHERE pos % 10 < 5"""),
    "cohort": (["dedup", "labelled", "train"], "SELECT detector_id, value FROM dedup JOIN labelled USING (run_id, episode_no) JOIN train USING (run_id) WHERE label = 'negative'"),
    "featured": (CTES["feat"][0], CTES["feat"][1]),
    "feat": (["bounds", "featured"], """SELECT b.run_id, b.episode_no, coalesce(d, 0) AS d, coalesce(c, 0) AS c, coalesce(eligible_count, 0) AS eligible_count, coalesce(edr_detected, 0) AS edr_detected, coalesce(ndr_detected, 0) AS ndr_detected
        FROM bounds b LEFT JOIN featured USING (run_id, episode_no)"""),
    "support": (["feat", "sides"], """SELECT *, CASE WHEN reason <> 'eligible' THEN 'out_of_support' WHEN run_no % 3 = 1 THEN 'supported_group' ELSE 'supported_global' END AS kappa FROM (SELECT *, CASE
        WHEN eligible_count = 0 THEN 'no_eligible_detector_value' WHEN run_no % 11 = 7 THEN 'version_out_of_support' WHEN e_missing OR n_missing THEN 'source_out_of_support'
        WHEN NOT e_parser_valid OR NOT n_parser_valid THEN 'parser_out_of_support'
        WHEN e_health IN ('down', 'unknown', 'not_applicable') OR n_health IN ('down', 'unknown', 'not_applicable') THEN 'source_out_of_support'
        WHEN run_no % 13 = 4 THEN 'calibration_out_of_support'
        WHEN NOT e_transport_live OR NOT n_transport_live THEN 'source_out_of_support' ELSE 'eligible' END AS reason FROM (SELECT *, substr(run_id, 5, 9)::INT AS run_no FROM feat JOIN sides USING (run_id, episode_no)))"""),
    "outcome": (["support", "contra"], """SELECT s.*, contradiction, f.episode_id, f.revision, NOT (e_missing OR n_missing) AS audit, z, CASE WHEN reason = 'eligible' THEN 1 / (1 + exp(-(CASE WHEN kappa = 'supported_group' THEN 0.8::DOUBLE * z + 0.2::DOUBLE ELSE 1.2::DOUBLE * z - 0.1::DOUBLE END))) END AS p,
        CASE WHEN e_health = 'unknown' OR n_health = 'unknown' THEN 'unknown' WHEN e_health IN ('down', 'not_applicable') OR n_health IN ('down', 'not_applicable') OR NOT e_parser_valid OR NOT n_parser_valid THEN 'unavailable'
            WHEN e_health = 'degraded' OR n_health = 'degraded' THEN 'degraded' ELSE 'complete' END AS coverage,
        CASE WHEN e_missing OR n_missing THEN 'missing' ELSE 'complete' END AS provenance,
        CASE WHEN f.late_evidence_reason = 'accepted_within_horizon' THEN 'late_accepted' WHEN f.state IN ('open', 'finalized') THEN 'revisable' ELSE 'stable' END AS lateness
        FROM (SELECT *, -2.0::DOUBLE + 3.0::DOUBLE * d + c AS z FROM support) s JOIN contra USING (run_id, episode_no) JOIN formed f ON f.run_id = s.run_id AND f.episode_id || '#' || f.revision = s.episode_no"""),
}


def ordered(names: tuple[str, ...], frames: dict[str, tuple[list[str], str]]) -> list[str]:
    """The named frames and all that they need, in an order in which each comes after what it needs."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in frames[name][0]:
                need(other)
            order.append(name)

    for name in names:
        need(name)
    return order


def sql(body: str, *names: str, steps: dict[str, str] | None = None) -> str:
    """A query over the named frames and all that they need, and over steps of its own, in order."""
    frames = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered(names, CTES)] + [f"{n} AS ({text})" for n, text in (steps or {}).items()]
    return "WITH " + ",\n".join(frames) + f"\n{body}"


def formed_sql(body: str, *names: str, builders: tuple[str, ...] = ("full",), norm: str | None = None, order: str = "") -> str:
    """A query over the named frames of formed episodes, and over formed, terminal and late_rows themselves.

    norm: another body for the frame of normalised events, which may read the plain one as `base`; order: how the events of a run arrive.
    """
    before = ["raw", "norm"]
    after = [n for n in ordered(names, FORMED) if n not in before]
    frames = [("raw", FORMED["raw"][1]), ("norm" if norm is None else "base", FORMED["norm"][1])] + ([("norm", norm)] if norm else [])
    ctes = [f"{n} AS MATERIALIZED ({body})" for n, body in frames] + [formation_ctes(list(builders), order=order)] + [f"{n} AS MATERIALIZED ({FORMED[n][1]})" for n in after]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\n{body}"
