"""All children of the replay design, each against its own operator, and the delays of a run's last event."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from wakeline.operators import formation, replay
from wakeline.plans.frames import Frames
from wakeline.sources import adapters


def test_every_child_has_an_outcome(spark):
    f = Frames(spark, SF)
    rows = entry.queries()["replay_outcomes"](spark, SF).collect()
    runs = f.norm.select("run_id").distinct().count()
    assert len(rows) == 41 * runs and set(Counter(r["child"] for r in rows).values()) == {runs}
    assert {r["child"] for r in rows} == {replay.child_key(*c) for c in replay.cells()}
    assert all(r["revision_delta"] == r["episode_delta"] == 0 for r in rows if r["intervention"] == "control")
    got, names = {(r["run_id"], r["child"]): r["revision_delta"] for r in rows}, adapters.aliases(f.table("events"))
    count = lambda e: {r["run_id"]: r["count"] for r in formation.form_episodes(formation.formation_input(e, names)).groupBy("run_id").count().collect()}
    base = count(replay.arrival(f.norm))
    for child, events in (("mask:EDR:all", replay.arrival(replay.mask(f.norm, "EDR"))), ("burst:NDR:300", replay.arrival(replay.burst(f.norm, "NDR", 300))), ("reorder:EDR:120", replay.reorder(f.norm, "EDR", 120)), ("skew:EDR:-30", replay.arrival(replay.skew(f.norm, "EDR", -30)))):
        alone = count(events)
        assert {r: alone.get(r, 0) - n for r, n in base.items()} == {r: got[r, child] for r in base}


def test_seven_delays(spark):
    rows = entry.queries()["ingest_shift_outcomes"](spark, SF).collect()
    by_run = defaultdict(dict)
    for r in rows:
        by_run[r["run_id"]][r["delay_s"]] = r
    assert all(sorted(v) == [0, 60, 119, 120, 121, 901, 1020] for v in by_run.values())
    assert all(v[0]["membership_equal"] and not v[0]["late_changed"] for v in by_run.values())
    norm = Frames(spark, SF).norm
    moved = replay.shifted(norm).alias("s").join(norm.alias("n"), ["run_id", "event_id"]).filter("s.ingest_us <> n.ingest_us")
    moved = moved.groupBy("run_id", "child").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("s.ingest_us") - F.col("n.ingest_us")).alias("by")).collect()
    assert len(moved) == 6 * len(by_run) and all(r["k"] == 1 and r["by"] == int(r["child"]) * 1_000_000 for r in moved)


def test_only_reordered_children_are_numbered(spark):
    """All children were numbered by arrival, which moved every child's rows twice more; formation takes events in that order anyway."""
    events = formation.formation_input(Frames(spark, SF).norm)
    rows = replay.children(events, [c for c in replay.cells() if c[0] in ("delay", "reorder") and c[2] == 30])
    got = {r["child"]: (r["numbered"], r["n"]) for r in rows.groupBy("child").agg(F.count("arrival_seq").alias("numbered"), F.count(F.lit(1)).alias("n")).collect()}
    total = events.count()
    assert got == {"delay:EDR:30": (0, total), "delay:NDR:30": (0, total), "reorder:EDR:30": (total, total), "reorder:NDR:30": (total, total)}
