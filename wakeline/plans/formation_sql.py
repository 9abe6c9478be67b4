"""Formation once more, as SQL (DuckDB): an oracle that shares nothing with wakeline.operators.formation but the rules.

A recursive query moves all runs and builders forward by one event a step. A row holds a run's clock, its lineages and the events that
can still matter; lineages that closed longer ago than the run's largest lag can reach are let go, which no later event could tell.
"""

from __future__ import annotations

S = 1_000_000
#: name -> hub cutoff, causal, session, endpoint (relations in use), most parents, mode, late. The defaults are those of "full".
POLICIES: dict[str, tuple] = {
    "full": (25, True, True, True, 3, "all", "accept"),
    "sliding_time": (25, True, True, True, 3, "time", "accept"),
    "sliding_entity": (25, True, True, True, 3, "entity", "accept"),
    "no_guards": (1 << 60, True, True, True, 3, "all", "accept"),
    "no_causal": (25, False, True, True, 3, "all", "accept"),
    "no_session": (25, True, False, True, 3, "all", "accept"),
    "no_endpoint": (25, True, True, False, 3, "all", "accept"),
    "no_merge": (25, True, True, True, 1, "all", "accept"),
    "no_late": (25, True, True, True, 3, "all", "record"),
    "reject_late": (25, True, True, True, 3, "all", "reject"),
}
LINEAGE = {"k": "INT", "id": "VARCHAR", "st": "VARCHAR", "t0": "BIGINT", "t1": "BIGINT", "rev": "INT", "fin": "BIGINT", "dl": "BIGINT", "fo": "INT", "par": "VARCHAR[]"}
EVENT = {"n": "INT", "t": "BIGINT", "s": "UBIGINT", "o": "UBIGINT", "g": "UBIGINT", "edr": "BOOLEAN", "ses": "BOOLEAN", "l": "INT", "r": "VARCHAR"}
EMITTED = {"k": "INT", "id": "VARCHAR", "rev": "INT", "st": "VARCHAR", "late": "VARCHAR", "fin": "BIGINT", "dl": "BIGINT", "t0": "BIGINT", "t1": "BIGINT", "par": "VARCHAR[]", "m": "STRUCT(n INT, r VARCHAR)[]"}
LATE = {"id": "VARCHAR", "rev": "INT", "dl": "BIGINT", "reason": "VARCHAR"}


def kind(fields: dict[str, str]) -> str:
    return "STRUCT(" + ", ".join(f"{n} {t}" for n, t in fields.items()) + ")"


def pack(fields: dict[str, str], of: str, **new: str) -> str:
    """The struct `of` with some fields new."""
    return "{" + ", ".join(f"'{n}': ({new[n] if n in new else f'{of}.{n}'})::{t}" for n, t in fields.items()) + "}"


def emitted(of: str, xs: str, late: str = "NULL") -> str:
    return pack(EMITTED, of, late=late, m=f"list_transform(list_filter({xs}, lambda x: x.l = {of}.k), lambda x: {{'n': x.n, 'r': x.r}})")


def formation_ctes(builders: list[str], source: str = "norm", order: str = "") -> str:
    """CTEs revisions (run_id, builder, n, pos, e, wm) and late_rows, over the CTE `source`; pos is the place among those of a step.

    order: how events of a run arrive, if not by ingest time.
    """
    order = order or "ingest_us, event_us, source_instance, event_id"
    told = order.startswith("ingest_us")
    carried, reach = ("", "max(ingest_us - event_us) OVER (PARTITION BY run_id)") if told else (", arr", "1000000000000000")  # in any other order nothing is let go
    policies = ", ".join(f"('{b}', {', '.join(repr(v) if isinstance(v, str) else str(v).lower() for v in POLICIES[b])})" for b in builders)
    session = "coalesce(lower(command_family) IN ('remote_session', 'file_transfer'), false) OR coalesce(lower(protocol) IN ('ssh', 'smb', 'nfs'), false) OR contains(lower(action), 'session')"
    grace = pack(LINEAGE, "l", st="'f'", rev="l.rev + 1", fin="now", dl=f"now + {900 * S}", fo="2 * n")
    again = pack(LINEAGE, "l", st="'f'", rev="l.rev + 1", fin="now", dl=f"now + {900 * S}", fo="2 * n + 1")
    closed = pack(LINEAGE, "l", st="'c'", rev="l.rev + 1")
    # What an event has in common with the members of a lineage, c.mm.
    meets = "(mode = 'time' OR x.s = s OR x.s = o OR x.o = s OR x.o = o OR (mode = 'all' AND x.g = g))"
    both = "(x.s = s OR x.s = o OR x.o = s OR x.o = o)"
    some = lambda cond: f"len(list_filter(c.mm, lambda x: {cond})) > 0"
    return f"""aliased AS (
    SELECT run_id, event_id, event_us, ingest_us, source_family, source_instance, dependency_group{carried}, {session} AS ses,
           coalesce(a.entity, subject) AS subject, coalesce(b.entity, object) AS object FROM {source}
    LEFT JOIN (SELECT DISTINCT subject AS alias, endpoint_key AS entity FROM norm WHERE subject LIKE 'ip:10.%') a ON a.alias = subject
    LEFT JOIN (SELECT DISTINCT subject AS alias, endpoint_key AS entity FROM norm WHERE subject LIKE 'ip:10.%') b ON b.alias = object
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order})::INT AS n, {reach} AS lag FROM aliased
), ev AS MATERIALIZED (
    SELECT run_id, n, ingest_us AS now, event_us AS t, hash(subject) AS s, hash(object) AS o, hash(dependency_group) AS g, source_family = 'EDR' AS edr, ses, event_id, lag FROM placed
    UNION ALL SELECT run_id, max(n) + f, max(ingest_us) + CASE f WHEN 1 THEN 121 ELSE 1143 END * {S}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, any_value(lag) FROM placed, range(1, 3) AS r(f) GROUP BY run_id, f
), policy(builder, cutoff, causal, session, endpoint, parents, mode, late_mode) AS (VALUES {policies}
), st AS (
    SELECT run_id, builder, 0::INT AS n, NULL::BIGINT AS mx, []::{kind(LINEAGE)}[] AS ls, []::{kind(EVENT)}[] AS xs, []::{kind(EMITTED)}[] AS outs, NULL::{kind(LATE)} AS lated
    FROM (SELECT DISTINCT run_id FROM placed), policy
  UNION ALL
    SELECT run_id, builder, n, mx, list_filter(ls3, lambda l: NOT coalesce(l.st = 'c' AND l.t1 < now - lag - {600 * S}, false)),
           list_filter(xs, lambda x: len(list_filter(ls3, lambda l: l.k = x.l AND NOT coalesce(l.st = 'c' AND l.t1 < now - lag - {600 * S}, false))) > 0 OR x.t >= now - lag - {600 * S}),
           em || CASE WHEN touched IS NULL THEN [] ELSE [{emitted("touched", "xs", "late_reason")}] END || list_transform(list_filter(ls3, lambda l: l.fo = 2 * n + 1), lambda l: {emitted("l", "xs")}), lated
    FROM (SELECT *, list_transform(ls2, lambda l: CASE WHEN l.st = 'o' AND l.t1 <= wm THEN {again} ELSE l END) AS ls3
    FROM (SELECT * REPLACE (CASE WHEN t IS NULL THEN xs ELSE list_transform(xs, lambda x: CASE WHEN act = 'merge' AND list_contains(merged, x.l) THEN {pack(EVENT, "x", l="n")} ELSE x END)
                || [{{'n': n, 't': t, 's': s, 'o': o, 'g': g, 'edr': edr, 'ses': ses, 'l': CASE WHEN act IN ('start', 'merge') THEN n WHEN act = 'attach' THEN best.l.k END, 'r': CASE WHEN act <> 'start' THEN best.reason END}}] END AS xs),
            CASE act WHEN 'attach' THEN list_transform(ls1, lambda l: CASE WHEN l.k = best.l.k THEN {pack(LINEAGE, "l", t0="least(l.t0, t)", t1="greatest(l.t1, t)", rev="l.rev + 1")} ELSE l END)
                WHEN 'start' THEN ls1 || [fresh] WHEN 'merge' THEN list_filter(ls1, lambda l: NOT list_contains(merged, l.k)) || [fresh] ELSE ls1 END AS ls2,
            CASE act WHEN 'attach' THEN {pack(LINEAGE, "best.l", t0="least(best.l.t0, t)", t1="greatest(best.l.t1, t)", rev="best.l.rev + 1")} WHEN 'start' THEN fresh WHEN 'merge' THEN fresh END AS touched,
            CASE WHEN act = 'attach' AND best.l.st = 'f' THEN 'accepted_within_horizon' END AS late_reason,
            CASE WHEN act = 'late' THEN {{'id': best.l.id, 'rev': best.l.rev, 'dl': best.l.dl, 'reason': CASE WHEN best.l.st = 'f' AND now <= best.l.dl THEN CASE late_mode WHEN 'reject' THEN 'rejected' ELSE 'late_successor_disabled' END WHEN now > best.l.dl THEN 'beyond_revision_horizon' ELSE 'closed_lineage_match' END}} END AS lated
    FROM (SELECT *, list_transform(open, lambda c: c.l.k) AS merged,
            CASE act WHEN 'start' THEN {{'k': n, 'id': 'ep:' || sha256('{{"policy":"wakeline.policy.v1","start_event_id":"' || event_id || '"}}'), 'st': 'o', 't0': t, 't1': t, 'rev': 0, 'fin': NULL, 'dl': NULL, 'fo': NULL, 'par': []}}
                WHEN 'merge' THEN {{'k': n, 'id': 'ep:' || sha256('{{"event_id":"' || event_id || '","parents":["' || array_to_string(list_sort(list_transform(open, lambda c: c.l.id)), '","') || '"],"policy":"wakeline.policy.v1"}}'), 'st': 'o',
                    't0': least(t, list_min(list_transform(open, lambda c: c.l.t0))), 't1': greatest(t, list_max(list_transform(open, lambda c: c.l.t1))), 'rev': 0, 'fin': NULL, 'dl': NULL, 'fo': NULL, 'par': list_sort(list_transform(open, lambda c: c.l.id))}} END::{kind(LINEAGE)} AS fresh
    FROM (SELECT *, coalesce(done[1], open[1]) AS best, CASE WHEN t IS NULL THEN 'none'
            WHEN done[1] IS NOT NULL THEN CASE WHEN done[1].l.st = 'f' AND now <= done[1].l.dl AND late_mode = 'accept' THEN 'attach' ELSE 'late' END
            WHEN len(open) = 0 THEN 'start'
            WHEN len(open) > 1 AND len(open) <= parents AND len(list_filter(open, lambda c: NOT c.strong)) = 0 AND 1 + list_sum(list_transform(open, lambda c: len(c.mm))) <= 500
                AND len(list_distinct([s, o] || flatten(list_transform(open, lambda c: flatten(list_transform(c.mm, lambda x: [x.s, x.o])))))) <= 200 THEN 'merge'
            ELSE 'attach' END AS act
    FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(found, lambda c: c.l.st <> 'o'), lambda c: {{'a': c.l.st <> 'f', 'p': -c.p, 'q': -c.q, 'd': c.d, 'u': least(c.l.t0, t), 'i': c.l.id, 'c': c}})), lambda z: z.c) AS done,
            list_transform(list_sort(list_transform(list_filter(found, lambda c: c.l.st = 'o'), lambda c: {{'p': -c.p, 'q': -c.q, 'd': c.d, 'u': least(c.l.t0, t), 'i': c.l.id, 'c': c}})), lambda z: z.c) AS open
    FROM (SELECT *, list_transform(list_filter(near, lambda c: (c.c OR c.e OR c.a OR c.y OR mode = 'time') AND c.d <= {300 * S} AND (mode = 'time' OR NOT ((c.hs OR c.ho) AND (NOT c.hs OR hub_s) AND (NOT c.ho OR hub_o)))),
            lambda c: {{'l': c.l, 'mm': c.mm, 'd': c.d, 'p': CASE WHEN mode = 'time' THEN 0 WHEN c.c THEN 4 WHEN c.a THEN 3 WHEN c.y THEN 2 ELSE 1 END, 'q': CASE WHEN mode = 'time' THEN 1 ELSE c.c::INT + c.a::INT + c.y::INT + c.e::INT END, 'strong': mode <> 'time' AND (c.c OR c.a OR c.y),
                'reason': CASE WHEN mode = 'time' THEN 'time_proximity' WHEN c.c THEN 'process_causal' WHEN c.a THEN 'authenticated_session' WHEN c.y THEN 'endpoint_connection' ELSE 'specific_entity' END}}) AS found
    FROM (SELECT *, list_transform(list_filter(list_transform(list_filter(ls1, lambda l: t BETWEEN l.t0 - {300 * S} AND l.t1 + {300 * S} AND greatest(l.t1, t) - least(l.t0, t) <= {3600 * S} AND NOT coalesce(l.st = 'c' AND now > l.dl + {86400 * S}, false)),
                lambda l: {{'l': l, 'mm': list_filter(xs, lambda x: x.l = l.k)}}), lambda c: {some(meets)}),
            lambda c: {{'l': c.l, 'mm': c.mm, 'd': list_min(list_transform(c.mm, lambda x: abs(x.t - t))), 'c': mode = 'all' AND causal AND {some('x.g = g')}, 'e': mode <> 'time' AND {some(both)},
                'a': mode = 'all' AND session AND ses AND {some(f'{both} AND x.ses')}, 'y': mode = 'all' AND endpoint AND {some(f'{both} AND x.edr <> edr')}, 'hs': {some('x.s = s OR x.o = s')}, 'ho': {some('x.s = o OR x.o = o')}}}) AS near,
            len(list_distinct([g] || list_transform(list_filter(xs, lambda x: (x.s = s OR x.o = s) AND x.t BETWEEN t - {600 * S} AND t), lambda x: x.g))) >= cutoff AS hub_s,
            len(list_distinct([g] || list_transform(list_filter(xs, lambda x: (x.s = o OR x.o = o) AND x.t BETWEEN t - {600 * S} AND t), lambda x: x.g))) >= cutoff AS hub_o
    FROM (SELECT * EXCLUDE (ls), list_transform(ls, lambda l: CASE WHEN l.st = 'f' AND now >= l.dl THEN {closed} ELSE l END) AS ls1,
            list_transform(list_filter(ls, lambda l: l.fo = 2 * n), lambda l: {emitted("l", "xs")})
            || list_transform(list_sort(list_transform(list_filter(ls, lambda l: l.st = 'f' AND now >= l.dl), lambda l: {{'fo': l.fo, 'k': l.k, 'l': {closed}}})), lambda z: {emitted("z.l", "xs")}) AS em
    FROM (SELECT e.run_id, st.builder, e.n, greatest(coalesce(mx, now), now) AS mx, greatest(coalesce(mx, now), now) - {120 * S} AS wm, xs, e.* EXCLUDE (run_id, n), p.* EXCLUDE (builder),
            list_transform(ls, lambda l: CASE WHEN l.st = 'o' AND l.t1 <= greatest(coalesce(mx, now), now) - {120 * S} THEN {grace.replace('2 * n', '2 * e.n')} ELSE l END) AS ls
        FROM st JOIN ev e ON e.run_id = st.run_id AND e.n = st.n + 1 JOIN policy p ON p.builder = st.builder)))))))))
), revisions AS MATERIALIZED (
    SELECT run_id, builder, st.n, generate_subscripts(outs, 1) AS pos, unnest(outs) AS e, mx - {120 * S} AS wm FROM st WHERE len(outs) > 0
), late_rows AS (SELECT run_id, builder, st.n, lated AS e, placed.event_id, placed.ingest_us FROM st JOIN placed USING (run_id, n) WHERE lated IS NOT NULL
), formed AS MATERIALIZED (
    SELECT r.run_id, r.builder, (row_number() OVER (PARTITION BY r.run_id, r.builder ORDER BY r.n, r.pos) - 1)::INT AS seq, e.id AS episode_id, e.rev AS revision,
        CASE e.st WHEN 'o' THEN 'open' WHEN 'f' THEN 'finalized' ELSE 'closed' END AS state, ids, reasons, e.par AS parents, CASE WHEN e.rev > 0 THEN e.rev - 1 END AS predecessor_revision, e.late AS late_evidence_reason,
        e.fin AS first_finalized_us, e.dl AS revision_deadline_us, e.t0 AS event_us_start, e.t1 AS event_us_end, wm AS watermark_us
    FROM revisions r JOIN (
        SELECT run_id, builder, n, pos, list(p.event_id ORDER BY p.event_us, p.ingest_us, p.source_instance, p.event_id) AS ids, list(coalesce(u.m.r, 'specific_entity') ORDER BY p.event_us, p.ingest_us, p.source_instance, p.event_id)[2:] AS reasons
        FROM (SELECT run_id, builder, n, pos, unnest(e.m) AS m FROM revisions) u JOIN (SELECT run_id, n AS pn, event_id, event_us, ingest_us, source_instance FROM placed) p USING (run_id) WHERE p.pn = u.m.n GROUP BY ALL) i
    ON i.run_id = r.run_id AND i.builder = r.builder AND i.n = r.n AND i.pos = r.pos
), terminal AS MATERIALIZED (
    SELECT f.* FROM formed f WHERE state = 'finalized' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT run_id, builder, unnest(parents) AS gone FROM formed) g WHERE g.run_id = f.run_id AND g.builder = f.builder AND g.gone = f.episode_id)
    QUALIFY row_number() OVER (PARTITION BY run_id, builder, episode_id ORDER BY seq) = 1
)"""

