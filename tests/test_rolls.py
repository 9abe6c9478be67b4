"""Formation without lists: what rolls say is what the revisions with their lists say, and the formed chain needs nothing else."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wakeline.operators import formation as fm
from wakeline.plans import catalog, catalog_formed, catalog_more, catalog_replay, catalog_scale, catalog_study  # noqa: F401  the others register with the first
from wakeline.plans.formed import terminal
from wakeline.sources import adapters


def stream(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    return fm.formation_input(adapters.norm_events(events), adapters.aliases(events)).cache()


@pytest.mark.parametrize("builder", ["full", "no_merge", "sliding_time", "no_late"])
def test_rolls_are_the_revisions(spark, builder):
    events = stream(spark)
    whole = fm.form_episodes(events, [builder]).cache()
    rolls = fm.form_rolls(events, [builder], carry=["event_id", "object"], digests=True).cache()
    same = ["run_id", "builder", "seq", "episode_id", "revision", "state", "late_evidence_reason", "event_us_start", "event_us_end", "watermark_us", "membership_digest"]
    marks = rolls.filter("revision IS NOT NULL")
    want = {tuple(r) for r in whole.select(*same, F.size("ordered_event_ids")).collect()}
    assert {tuple(r) for r in marks.select(*same, "n_events").collect()} == want and marks.count() == len(want)
    key = ["run_id", "episode_id", "revision"]
    assert {tuple(r) for r in marks.filter("is_last").select(*key).collect()} == {tuple(r) for r in terminal(whole).select(*key).collect()}
    held = rolls.filter("since IS NOT NULL")
    pairs = held.select("run_id", "episode_id", "event_id", "since").join(marks.select(*key), ["run_id", "episode_id"]).filter("since <= revision").select(*key, "event_id")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, whole.select(*key, F.explode("ordered_event_ids")).collect()))
    named = events.select("run_id", "event_id", "object")
    assert held.select("run_id", "event_id", "object").exceptAll(held.select("run_id", "event_id").join(named, ["run_id", "event_id"])).isEmpty()


def test_twice_delivered_events_are_carried_twice(spark):
    events = stream(spark)
    one = events.orderBy("ingest_us").limit(1)
    rolls = fm.form_rolls(events.unionByName(one), carry=["event_id"]).filter("since IS NOT NULL").cache()
    first = one.first()["event_id"]
    once = fm.form_rolls(events, carry=["event_id"]).filter("since IS NOT NULL").filter(F.col("event_id") == first).count()
    assert once > 0 and rolls.filter(F.col("event_id") == first).count() == 2 * once


@pytest.mark.parametrize("name", ["formed_models", "formed_outcomes", "formed_support", "outage_completeness", "rt1_by_run", "rt7_categories", "record_digests", "formation_builders", "paired_builders", "hub_injection", "determinism_matrix", "ingest_shift_outcomes", "replay_outcomes"])
def test_no_lists_of_events(spark, monkeypatch, name):
    """Only queries that return the lists of revisions form them."""

    def refuse(*_, **__):
        raise AssertionError("a list of events for every revision")

    monkeypatch.setattr(fm, "form_episodes", refuse)
    assert catalog.QUERIES[name](spark, SF).columns



def test_notes_are_the_late_records(spark):
    events = stream(spark)
    same = ["run_id", "seq", "episode_id", "reason"]
    rolls = fm.form_rolls(events, notes=True).cache()
    want = sorted(map(tuple, fm.late_records(events).select(*same, "event_id").collect()))
    assert want and sorted(map(tuple, rolls.filter("noted_id IS NOT NULL").select(*same, "noted_id").collect())) == want
    assert rolls.filter("revision IS NOT NULL").count() == fm.form_rolls(events).count()
