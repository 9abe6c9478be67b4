from __future__ import annotations

import hashlib

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from wakeline.operators import detectors
from wakeline.plans.frames import Frames


def test_values_without_a_cohort_are_not_dropped(spark):
    values = spark.createDataFrame([("a", 0.2), ("a", 0.5), ("b", 0.4)], "detector_id string, value double")
    cohort = spark.createDataFrame([("a", 0.2), ("a", 0.3)], "detector_id string, value double")
    got = {(r["detector_id"], r["value"]): r["normalized"] for r in detectors.ecdf(values, cohort, uncovered="null").collect()}
    assert got == {("a", 0.2): 0.25, ("a", 0.5): 1.0, ("b", 0.4): None}
    with pytest.raises(Exception, match="the cohort does not cover b"):
        detectors.ecdf(values, cohort).collect()
    with pytest.raises(Exception, match="does not cover"):
        detectors.ecdf(values, cohort.limit(0)).collect()


def test_cohort_of_training_negatives(spark):
    f = Frames(spark, SF)
    runs = sorted((r["run_id"] for r in f.norm.select("run_id").distinct().collect()), key=lambda r: hashlib.sha256(f"7\x1f{r}".encode()).hexdigest())
    train = {r for i, r in enumerate(runs) if i % 10 < 5}
    negative = {(r["run_id"], r["episode_no"]) for r in f.labelled.filter("label = 'negative'").collect() if r["run_id"] in train}
    values = [(r["run_id"], r["episode_no"], r["detector_id"], r["value"]) for r in f.dedup.collect()]
    cohort = {}
    for run, no, d, v in values:
        cohort.setdefault(d, []).extend([v] if (run, no) in negative else [])
    want = sorted((run, no, d, round((sum(c < v for c in cohort[d]) + 0.5 * sum(c == v for c in cohort[d])) / len(cohort[d]), 7) if cohort[d] else None) for run, no, d, v in values)
    rows = entry.queries()["ecdf_train_negatives"](spark, SF).collect()
    assert negative and any(r["normalized"] is not None for r in rows)
    assert sorted((r["run_id"], r["episode_no"], r["detector_id"], None if r["normalized"] is None else round(r["normalized"], 7)) for r in rows) == want
