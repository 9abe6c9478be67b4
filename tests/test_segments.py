"""Formation by segments equals formation of whole runs, to the row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import formation as fm
from wakeline.operators import segments as sg

SCHEMA = "run_id string, event_id string, event_us long, ingest_us long, source_family string, source_instance string, subject string, object string, dependency_group string, session_like boolean"


def stream(seed, run="r", n=160, length=40_000):
    """Bursts with holes of all widths around the gap and the hub window; lateness, copies, a hub."""
    rng = random.Random(seed)
    out, t = [], 0
    while len(out) < n:
        t += rng.choice([1, 5, 20, 60, 290, 300, 301, 310, 550, 610, 1500])
        us = 1_700_000_000_000_000 + t * fm.SECOND
        lag = rng.choice([0, 0, 1, 5, 60, 119, 120, 121, 400, 900, 1500, 5000, 90_000])
        who = "hub" if rng.random() < 0.3 else f"user:{rng.randrange(4)}"
        row = (run, f"e{len(out):04}", us, us + lag * fm.SECOND, rng.choice(["EDR", "NDR"]), rng.choice(["a", "b"]), who, f"o:{rng.randrange(9)}", f"g{rng.randrange(40)}", rng.random() < 0.3)
        out.append(row)
        if rng.random() < 0.1:
            out.append((*row[:3], row[3], *row[4:]))  # a copy, in any place among equals
        if rng.random() < 0.05:
            late = row[3] + rng.choice([0, 2000]) * fm.SECOND
            out.append((run, f"f{len(out):04}", us, late, *row[4:]))
    return out


def plain(df):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_streams(spark, seed, monkeypatch):
    """Many chunks, few events each; the hub's cutoff is low, so that halo rows decide."""
    policies = {n: fm.replace(p, hub_cutoff=min(p.hub_cutoff, 4)) for n, p in fm.BUILDERS.items()}
    monkeypatch.setattr(fm, "BUILDERS", policies)
    rows = stream(seed) + stream(seed + 100, "q", 60)
    events = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ["full", "sliding_time", "no_late", "reject_late", "no_merge"]
    places = sg.chunked(events, 7)
    assert places.select("run_id", "chunk").distinct().count() > 10 and not places.filter("halo").isEmpty()
    want = {(n, run): fm.run_former([dict(r) for r in _ordered(rows, run)], policies[n]) for n in names for run in ("r", "q")}
    for which in ("revisions", "late", "rejected"):
        got = {}
        monkeypatch.setattr(sg, "BUILDERS", policies)
        for r in sg.form_segments(events, names, which, 7).collect():
            got.setdefault((r["builder"], r["run_id"]), []).append(r.asDict())
        for key, former in want.items():
            mine = sorted(got.get(key, []), key=lambda r: r["seq"])
            assert [r["seq"] for r in mine] == list(range(len(mine)))
            assert [{k: v for k, v in r.items() if k not in ("run_id", "builder", "seq")} for r in mine] == getattr(former, which), (key, which)


def _ordered(rows, run):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    mine = [dict(zip(names, r, strict=True)) for r in rows if r[0] == run]
    mine.sort(key=lambda r: (r["ingest_us"], r["event_us"], r["source_instance"], r["event_id"]))
    return [{k: v for k, v in r.items() if k != "run_id"} for r in mine]


def test_successors(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(10_000) * fm.SECOND for _ in range(80))
    placed = spark.createDataFrame([("r", t, i) for i, t in enumerate(times)], "run_id string, ingest_us long, pos long")
    asked = [rng.randrange(11_000) * fm.SECOND for _ in range(60)]
    got = {r["t"]: (r["due_at"], r["due_us"]) for r in sg.successors(placed, spark.createDataFrame([("r", t) for t in asked], "run_id string, t long")).collect()}
    want = {t: next(((i, u) for i, u in enumerate(times) if u >= t), None) for t in asked}
    assert got == {t: w for t, w in want.items() if w}


def test_conflicts_and_order(spark):
    rows = stream(1, n=20)
    other = list(rows[0])
    other[2], other[3] = other[2] + 9_000 * fm.SECOND, other[3] + 9_000 * fm.SECOND  # the same id, far away in another chunk
    with pytest.raises(ValueError, match="conflicting duplicate"):
        sg.form_segments(spark.createDataFrame([*rows, tuple(other)], SCHEMA), chunk_events=5)
    with pytest.raises(ValueError, match="own order"):
        sg.form_segments(spark.createDataFrame(rows, SCHEMA).withColumn("arrival_seq", F.lit(1)))
    assert sg.form_segments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_determinism_means(spark):
    """Repeats and deliveries that are put in order again equal the control in every run; a reversed delivery does not. All figures against the SQL."""
    import duckdb

    import __spark_entry__ as entry
    from tests.conftest import SF
    from wakeline.plans.catalog_scale import DETERMINISM_SQL, MODES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = {r[0]: r[1:] for r in con.execute(DETERMINISM_SQL).fetchall()}

    got = {r["mode"]: r for r in entry.queries()["determinism_matrix"](spark, SF).collect()}
    assert sorted(got) == sorted(MODES)
    for mode, r in got.items():
        same = mode in ("control", "repeat_1", "resorted_1")
        assert r["n_equal"] == (r["n_runs"] if same else 0), mode
        assert (r["n_runs"], r["n_equal"], r["n_same_episodes"], r["n_revisions"]) == want[mode], mode


def test_late_records_need_no_lists():
    """Where only late or rejected events are asked for, a chunk keeps no revisions; what it does keep stays the same."""
    event = lambda i, at, came: {"event_id": f"e{i}", "event_us": at * 10**6, "ingest_us": came * 10**6, "source_family": "EDR", "source_instance": "s", "subject": "a", "object": f"o{i}", "dependency_group": "g", "session_like": False}
    rows = [event(0, 0, 1), event(1, 10, 11), event(2, 2000, 2001), event(3, 20, 4000)]
    made = []
    for lists in (True, False):
        former = sg.ChunkFormer(sg.FULL, {}, 4000 * 10**6, lists)
        for at, row in enumerate(rows, 1):
            former.handle(row, at)
        former.flush()
        made.append(former)
    assert made[0].late and made[0].late == made[1].late and made[0].late_at == made[1].late_at
    assert made[0].revisions and not made[1].revisions
