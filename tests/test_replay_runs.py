"""All children of a run in one task, against the children as rows and the former of one run."""

from __future__ import annotations

import functools
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from wakeline.operators import coded, formation, replay, replay_runs
from wakeline.operators.formation import SECOND
from wakeline.plans.formed import ChildFrames, FormedFrames
from wakeline.plans.frames import Frames
from wakeline.sources import sinks


def made_up(seed: int, n: int = 400) -> list[dict]:
    rng, rows = random.Random(seed), []
    span = rng.choice([2_000, 20_000, 200_000])
    for i in range(n):
        at = rng.randrange(span) * SECOND
        lag = rng.choice([0, 1, 5, 400, 1500, 90_000]) if rng.random() < 0.2 else 1
        family = rng.choice(["EDR", "NDR"])
        rows.append({
            "event_id": f"e{i}", "event_us": at, "ingest_us": at + lag * SECOND, "source_family": family, "source_instance": family + rng.choice("12"), "subject": f"u{rng.randrange(6)}",
            "object": rng.choice([f"o{rng.randrange(20)}", f"u{rng.randrange(6)}", "hub"]), "dependency_group": f"g{rng.randrange(60)}", "session_like": rng.random() < 0.3,
        })
    return rows + rng.sample(rows, 5)


def test_coded_events_form_as_others():
    kinds = set()
    for seed in range(24):
        table, policy = pa.Table.from_pylist(made_up(seed)), formation.Policy(hub_cutoff=[25, 4][seed % 2], max_parents=[3, 6][seed % 2])
        former = formation.run_former(formation.event_rows(formation._in_order(table)), policy)
        closed = [r["watermark_us"] - r["event_us_end"] for r in former.revisions if r["state"] == "closed"]
        run, out = coded.Run(table), coded.Tally()
        coded.form(run.events, len(run.entities), len(run.groups), out, policy)
        assert (out.revisions, out.episodes, out.closed, out.closed_us) == (len(former.revisions), former.made, len(closed), sum(closed))
        kinds |= {r["late_evidence_reason"] for r in former.revisions} | {min(len(r["parent_episode_ids"]), 2) for r in former.revisions} | {r["reason"] for r in former.late + former.rejected}
    assert kinds == {None, "accepted_within_horizon", 0, 2, "closed_lineage_match", "beyond_revision_horizon", "closed_index_expired"}


def test_conflicts_and_nulls_are_refused():
    rows = made_up(1, 10)
    with pytest.raises(ValueError, match="conflicting duplicate"):
        run = coded.Run(pa.Table.from_pylist([*rows, rows[0] | {"object": "x"}]))
        coded.form(run.events, len(run.entities), len(run.groups), coded.Tally())
    with pytest.raises(ValueError, match="without object"):
        coded.Run(pa.Table.from_pylist([rows[0] | {"object": None}, rows[1]]))


def test_children_are_those_made_as_rows(spark):
    """All 41: the same events in the same order."""
    f = Frames(spark, SF)
    events = formation.formation_input(f.norm, f.aliases)
    rows = defaultdict(list)
    for r in replay.children(events).collect():
        rows[r["run_id"], r["child"]].append(r)
    for run_id, of in events.toPandas().groupby("run_id"):
        run = coded.Run(pa.Table.from_pandas(of, preserve_index=False))
        for cell in replay.cells():
            want = sorted(rows[run_id, replay.child_key(*cell)], key=lambda r: (r["arrival_seq"] or 0, r["ingest_us"], r["event_us"], r["source_instance"], r["event_id"]))
            got = replay_runs.child(run_id, run, cell)
            assert [(e[3], e[0], e[1]) for e in got] == [(r["event_id"], r["ingest_us"], r["event_us"]) for r in want], cell
            assert [(run.entities[e[5]], run.entities[e[6]], run.groups[e[7]]) for e in got] == [(r["subject"], r["object"], r["dependency_group"]) for r in want]


def test_events_cross_the_network_once(spark, monkeypatch):
    """41 children were 41 times the events, shuffled as rows."""
    monkeypatch.setattr(replay, "children", None)
    whole = entry.queries()["replay_outcomes"](spark, SF).collect()
    monkeypatch.setattr(replay_runs, "LARGE", 50)
    assert sorted(whole) == sorted(entry.queries()["replay_outcomes"](spark, SF).collect())


class OneChild(FormedFrames):
    """A child as rows, through all that formed episodes go through."""

    def __init__(self, spark, cell, base):
        super().__init__(spark, SF)
        self.cell, self.base = cell, base

    @functools.cached_property
    def norm(self):
        return sinks.materialize(replay.children(sinks.materialize(self.base.norm, "one"), [self.cell]).drop("child"), "one-child")

    @property
    def _norm_by_run(self):
        return self._by_run(self.norm)

    @property
    def coverage(self):
        return self.base.coverage

    @property
    def negative_cohort(self):
        return self.base.negative_cohort


def test_profiles_are_what_a_childs_rows_give(spark, monkeypatch):
    """Counted where they are formed, revisions say what outcomes say row by row; also where a run is dealt to several tasks."""
    control = ("control", "none", "none")
    cells = [control, ("duplicate", "NDR", 0.25), ("skew", "EDR", 120), ("reorder", "EDR", 600), ("mask", "NDR", "all")]
    base = FormedFrames(spark, SF)
    f = ChildFrames(spark, SF, cells)
    values = lambda frame: Counter(tuple(r) for r in frame.select("detector_id", "value").collect())
    assert values(f.negative_cohort) == values(base.negative_cohort)
    monkeypatch.setattr(replay_runs, "LARGE", 50)
    split = ChildFrames(spark, SF, cells)
    assert sorted(map(str, f.profiles.collect())) == sorted(map(str, split.profiles.collect()))
    axes = replay_runs.AXES
    got = {(r["child"], r["run_id"]): r for r in f.profiles.filter("episode_no IS NULL").collect()}
    of_control = None
    for cell in cells:
        one, key = OneChild(spark, cell, base), replay.child_key(*cell)
        rows = {(r["run_id"], r["episode_no"]): r for r in one.outcomes.filter("audit").select("run_id", "episode_no", "d", "c", *axes).collect()}
        of_control = of_control or rows
        counts = {r["run_id"]: r["count"] for r in one.marks.groupBy("run_id").count().collect()}
        assert {run: r["revision_count"] for (child, run), r in got.items() if child == key and r["revision_count"]} == counts
        for run in counts:
            own = [r for (i, _), r in rows.items() if i == run]
            for c in ("d", "c"):
                assert got[key, run][c] == pytest.approx(sum(r[c] for r in own) / len(own) if own else None)
            shared = [(r, of_control[k]) for k, r in rows.items() if k[0] == run and k in of_control]
            assert [got[key, run][f"u_{a}"] for a in axes] == [sum(x[a] != y[a] for x, y in shared) for a in axes]
        views = lambda rows: Counter((r["run_id"], r["start_us"], r["end_us"], *r["entities"], *r["tokens"]) for r in rows.collect())
        assert views(f.views.filter(F.col("child") == key)) == views(one.views)


@pytest.mark.parametrize("name", ["replay_delays", "replay_delay_aggregate"])
def test_no_childs_revisions_are_written(spark, name, monkeypatch):
    """Events and revisions of seven children were written, shuffled and joined row by row."""
    monkeypatch.setattr(replay, "children", None)
    monkeypatch.setattr(formation, "form_rolls", None)
    assert entry.queries()[name](spark, SF).count() > 0
