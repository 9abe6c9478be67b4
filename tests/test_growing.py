"""Episodes that grow: what follows from since when an event belongs, against every revision with every event."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wakeline.operators import detectors, evaluation, formation, stats, support
from wakeline.plans import catalog_replay, formed  # noqa: F401  registers with the first
from wakeline.plans.catalog_formed import QUERIES
from wakeline.plans.formed import FormedFrames
from wakeline.sources import sinks


def test_vectors_and_contradiction(spark):
    rng = random.Random(11)
    members = [(f"run:{i % 3}", f"ep:{i % 5}", f"ev:{i}", i // 12, rng.choice(["EDR", "NDR"]), f"g:{i % 4}", rng.choice(["u1", "u2"]), rng.choice(["h1", "h1", "h1", "h2", None]), rng.choice(["p1", "p1", "p2", None]), rng.random()) for i in range(120)]
    members = spark.createDataFrame(members, "run_id string, episode_id string, event_id string, since int, source_family string, dependency_group string, endpoint_key string, endpoint_host string, parent_pid string, normalized double")
    moments = members.select("run_id", "episode_id").distinct().crossJoin(spark.range(12).select(F.col("id").cast("int").alias("revision")))
    scope = ["run_id", "episode_id", "revision"]
    whole = moments.join(members, ["run_id", "episode_id"]).filter("since <= revision").withColumn("detector_id", F.lower("source_family"))

    best = whole.groupBy(*scope, "source_family", "detector_id", "dependency_group").agg(F.max("normalized").alias("normalized"))
    want = {tuple(r[c] for c in scope): r for r in detectors.feature_vectors(best, scope).collect()}
    values = members.withColumn("detector_id", F.lower("source_family")).select("run_id", "episode_id", "source_family", "detector_id", "dependency_group", "normalized", "since")
    got = detectors.growing_vectors(moments, values, ["run_id", "episode_id"], "revision", []).collect()
    assert len(got) == moments.count() > len(want)
    for r in got:
        w = want.get(tuple(r[c] for c in scope))
        assert [r[c] for c in ("d", "c", "eligible_count", "edr_detected", "ndr_detected")] == ([w[c] for c in ("d", "c", "eligible_count", "edr_detected", "ndr_detected")] if w else [0.0, 0, 0, 0, 0])

    want = {tuple(r[c] for c in scope): r["contradiction"] for r in support.contradiction(whole, scope).collect()}
    got = moments.join(support.contradiction_since(members, ["run_id", "episode_id"]), ["run_id", "episode_id"]).select(*scope, support.contradiction_at("revision").alias("x")).collect()
    assert {"none", "unevaluable", "present"} == set(want.values())
    assert {tuple(r[c] for c in scope): r["x"] for r in got if r["x"]} == want


@pytest.mark.parametrize("name", ["formed_support", "normalizer_cohort", "evaluation_rows"])
def test_no_event_is_repeated_for_each_revision(spark, name, monkeypatch):
    """Every revision with every event took 70 GB and more at 60 times sf0.1; only queries that return it may make it."""

    def refuse(self):
        raise AssertionError("every revision with every event")

    monkeypatch.setattr(FormedFrames, "members", property(refuse))
    assert QUERIES[name](spark, SF).count() > 0


def test_moments_meet_their_steps_as_a_list(spark):
    """Moments times steps were rows that a task sorted and grouped again."""
    moments = spark.createDataFrame([("r", "e", 0)], "run_id string, episode_id string, revision int")
    values = spark.createDataFrame([("r", "e", "EDR", "d", "g", 0.5, 0)], "run_id string, episode_id string, source_family string, detector_id string, dependency_group string, normalized double, since int")
    out = detectors.growing_vectors(moments, values, ["run_id", "episode_id"], "revision", [])
    grouped = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert len(grouped) == 1 and "revision" not in grouped[0]
    assert [(r["d"], r["eligible_count"]) for r in out.collect()] == [(0.5, 1)]


def test_pairs_apart_in_time_are_dropped_where_they_meet(spark):
    """All pairs with a common entity crossed the network, most of them hours apart."""
    views = spark.createDataFrame([("r", 1, 0, 10, ["u"], ["a"]), ("r", 2, 90, 99, ["u"], ["a"])], "run_id string, episode_no long, start_us long, end_us long, entities array<string>, tokens array<string>")
    truth = spark.createDataFrame([("r", "g", 0, 10, ["u"], ["a"])], "run_id string, group_id string, start_us long, end_us long, entities array<string>, required_tokens array<string>")
    edges = evaluation.match_edges(views, truth)
    assert [(r["episode_no"], r["group_id"]) for r in edges.collect()] == [(1, "g")]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    meeting = next(line for line in plan[plan.index("Aggregate [") :].splitlines() if "Join Inner" in line)
    assert "start_us" in meeting and "g0" in meeting


def test_formation_is_dealt_by_run(spark, monkeypatch):
    """Spark put the runs of a small input together into one task a core, of which the last one worked alone."""
    given = []
    form = formation.form_rolls
    monkeypatch.setattr(formation, "form_rolls", lambda events, *a, **k: given.append(events) or form(events, *a, **k))
    assert FormedFrames(spark, SF).marks.count() > 0
    assert "RepartitionByExpression [run_id" in given[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("many_aliases", [False, True])
def test_episodes_are_joined_where_they_lie(spark, monkeypatch, many_aliases):
    """Events, revisions and what follows from them were shuffled by episode, again for each step: 50 MB a copy of sf0.1's events."""
    if many_aliases:
        monkeypatch.setattr(formed, "few", lambda *_: False)
    f = FormedFrames(spark, SF)
    seen = []
    for way in ("materialize", "materialize_dealt"):
        monkeypatch.setattr(formed, way, lambda df, name, *a, go=getattr(sinks, way), **k: seen.append((name, df)) or go(df, name, *a, **k))
    assert f.outcomes.count() == f.marks.count()
    plans = dict(seen)
    assert {"formed-rolls", "formed-views", "formed-edges", "formed-support"} <= set(plans)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with sinks._settings(spark, sinks._DEALT):
            for name in ("formed-views", "formed-edges", "formed-support"):
                plan = plans[name].select("*")._jdf.queryExecution().executedPlan().toString()
                assert "Join" in plan or name == "formed-views"
                assert not re.search(r"Exchange hashpartitioning\(run_id#\d+, (episode|entity)", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups = f.truth.select("run_id", "group_id")
    assert groups.count() == groups.distinct().count() > 0


def test_a_write_drops_its_shuffles(spark):
    """Shuffles of what was written long since stayed on disk until the query's end."""
    files = lambda: {n for n in (x.getName() for x in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))) if n.startswith("shuffle_") and n.endswith(".data")}
    before = files()
    rows = sinks.materialize(spark.range(1000).repartition(3, "id"), "small")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert rows.count() == 1000
    assert spark.conf.get(next(iter(sinks._WRITING)), None) in (None, "false")


def test_outage_counts_need_no_join_with_revisions(spark):
    """Outcomes met the revisions again, by episode and revision, only for their watermark."""
    f = FormedFrames(spark, SF)
    want = f.marks.select("run_id", "episode_id", "revision", "watermark_us")
    got = f.outcomes.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_fit_scorer_runs_the_chain_once(spark, monkeypatch):
    """Labels were made for the training rows, the calibration rows and the normaliser, and a calibrator was fitted that nobody asked for."""
    made = []
    label = evaluation.episode_labels
    monkeypatch.setattr(evaluation, "episode_labels", lambda *a, **k: made.append(1) or label(*a, **k))
    monkeypatch.setattr(stats, "affine_calibrators", None)
    assert {r["kind"] for r in QUERIES["fit_scorer"](spark, SF).collect()} == {"raw_model", "d_only_model"}
    assert len(made) == 1
