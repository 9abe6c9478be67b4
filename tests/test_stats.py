"""The fits, the gate and the bootstraps against plain Python over the same rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import stats


def affine(z, y):
    """The free optimum by damped Newton; if its slope is below the bound, the best offset on the bound."""

    def loss(b):
        t = b[0] + b[1] * z
        return np.mean(np.logaddexp(0, t) - y * t) + 1e-6 * b @ b

    for x, fixed in ((np.stack([np.ones_like(z), z], 1), False), (np.stack([np.ones_like(z), 0 * z], 1), True)):
        b = np.array([0.0, 1e-6 if fixed else 1.0])
        for _ in range(2000):
            q = 1 / (1 + np.exp(-(b[0] + b[1] * z)))
            grad = x.T @ (q - y) / len(z) + 2e-6 * b * [1, not fixed]
            step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) / len(z) + 2e-6 * np.eye(2), grad)
            rate = 1.0
            while rate > 1e-9 and loss(b - rate * step) > loss(b):
                rate /= 2
            b = b - rate * step
            if np.abs(grad).max() < 1e-13:
                break
        if b[1] >= 1e-6:
            return b
    return b


def gate_rows():
    rng, rows = random.Random(5), []
    for group, runs, shift, slope in (("good", 12, 2.5, 2.0), ("same", 12, 0.0, 1.0), ("few", 9, 2.5, 2.0), ("back", 11, 0.0, -1.0)):
        for i in range(runs * 30):
            z = rng.gauss(0, 1.5)
            rows.append((group, f"r{i % runs}", z, int(rng.random() < 1 / (1 + math.exp(-(shift + slope * z))))))
    return rows


def brute_gate(rows, folds):
    z, y = (np.array([r[i] for r in rows], float) for i in (2, 3))
    p = lambda b, x: 1 / (1 + math.exp(-(b[0] + b[1] * x)))
    whole, out = affine(z, y), {}
    for g in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == g]
        pos = sum(r[3] for r in mine)
        if pos < 50 or len(mine) - pos < 50 or len({r[1] for r in mine}) < 10:
            out[g] = ("minimum_cohort_not_met",)
            continue
        fits = {f: affine(*(np.array([r[i] for r in mine if folds[g, r[1]] != f], float) for i in (2, 3))) for f in range(5)}
        lost, by_fold = {}, {}
        for _, run, x, label in mine:
            f = folds[g, run]
            q, own = p(whole, x), p(fits[f], x)
            d = ((q - label) ** 2 - (own - label) ** 2, -math.log(q if label else 1 - q) + math.log(own if label else 1 - own))
            lost.setdefault(run, []).append(d)
            by_fold.setdefault(f, []).append(d)
        means, lows = [], []
        for i in (0, 1):
            rng, runs = np.random.default_rng(20_260_710 + i), sorted(lost)
            means.append(np.mean([d[i] for v in lost.values() for d in v]))
            boot = [np.mean([d[i] for at in rng.integers(0, len(runs), size=len(runs)) for d in lost[runs[at]]]) for _ in range(2000)]
            lows.append(np.percentile(boot, 2.5))
        ok = min(means) >= 0.01 and min(lows) > 0 and all(np.mean([d[i] for d in v]) >= 0 for v in by_fold.values() for i in (0, 1))
        out[g] = ("all_gate_predicates_pass" if ok else "improvement_gate_not_met", *means, *lows)
    return out


def test_group_gate(spark):
    rows = gate_rows()
    df = spark.createDataFrame(rows, "group_key string, run_id string, z double, label int")
    folds = {(r["group_key"], r["run_id"]): r["fold"] for r in stats.balanced_folds(df).collect()}
    want, got = brute_gate(rows, folds), {r["group_key"]: r for r in stats.group_gate(df).collect()}
    assert {g: r["reason"] for g, r in got.items()} == {g: w[0] for g, w in want.items()}
    assert got["good"]["decision"] == "enabled" and got["few"]["reason"] == "minimum_cohort_not_met"
    for g, w in want.items():
        if len(w) > 1:
            assert np.allclose([got[g][c] for c in ("mean_brier", "mean_nll", "low_brier", "low_nll")], w[1:], atol=1e-6)
    mine = [r for r in rows if r[0] == "good"]
    assert np.allclose([got["good"]["offset"], got["good"]["slope"]], affine(*(np.array([r[i] for r in mine], float) for i in (2, 3))), atol=1e-5)
    assert got["same"]["slope"] is None


def test_fits_at_their_bounds_and_separable(spark):
    rows = [("down", float(i), int(i < 0)) for i in range(-20, 21)] + [("apart", i / 10, int(i > 0)) for i in range(-20, 21)]
    df = spark.createDataFrame(rows, "g string, z double, label int")
    got = {r["g"]: r for r in stats.affine_calibrators(df, ["g"]).collect()}
    assert got["down"]["slope"] == 1e-6
    want = affine(*(np.array([r[i] for r in rows if r[0] == "apart"], float) for i in (1, 2)))
    assert np.allclose([got["apart"]["offset"], got["apart"]["slope"]], want, rtol=1e-2)


def test_scalar_and_row_bootstrap(spark):
    values = {f"r{i:02}": (i * 7 % 11) / 3 if i % 5 else None for i in range(20)}
    df = spark.createDataFrame([("g", r, v) for r, v in values.items()], "group_key string, run_id string, value double")
    kept = [v for _, v in sorted(values.items()) if v is not None]
    rng = np.random.default_rng(20_260_710)
    want = np.percentile([np.mean([kept[i] for i in rng.integers(0, len(kept), size=len(kept))]) for _ in range(2000)], [2.5, 97.5])
    r = stats.scalar_bootstrap(df).first()
    assert np.allclose([r["low"], r["high"]], want)
    rng, runs, boot = np.random.default_rng(20_260_710), sorted(values), []
    for _ in range(50):
        picked = [values[runs[i]] for i in rng.integers(0, len(runs), size=len(runs))]
        boot.append(np.mean([v for v in picked if v is not None]))
    r = stats.row_bootstrap(df, lambda x: x.groupBy("draw").agg(F.avg("value").alias("m"), F.countDistinct("run_id").alias("k").cast("double").alias("k")), ["m", "k"], draws=50).collect()
    r = {x["field"]: x for x in r}
    assert np.allclose([r["m"]["low"], r["m"]["high"]], np.percentile(boot, [2.5, 97.5]))
    assert r["k"]["low"] == r["k"]["high"] == 20  # a run drawn twice counts twice


def test_gate_refuses_bad_rows(spark):
    with pytest.raises(ValueError, match="finite z"):
        stats.group_gate(spark.createDataFrame([("g", "r", float("nan"), 1)], "group_key string, run_id string, z double, label int"))


def test_paired_bootstrap_draws_in_tasks(spark):
    deltas = [((i * 37) % 101 - 40) / 7 for i in range(23)]
    state, means = 20_260_710, []
    for _ in range(2000):
        total = 0.0
        for _ in deltas:
            state = (1_103_515_245 * state + 12_345) % 2**31
            total += deltas[int(state / 2**31 * len(deltas)) % len(deltas)]
        means.append(total / len(deltas))
    means.sort()
    df = spark.createDataFrame(list(enumerate(deltas)), "at long, delta double")
    r = stats.paired_bootstrap(df).first()
    assert np.allclose([r["low"], r["high"]], [means[49], means[1949]])
    drawn = [r["at"] for r in stats.lcg_draws(spark, 2, 40_000).filter("draw = 1").collect()]
    a, c = stats.lcg_power(40_000)
    s = (a * 20_260_710 + c) % 2**31
    for at in drawn:
        s = (1_103_515_245 * s + 12_345) % 2**31
        assert at == int(s / 2**31 * 40_000) % 40_000
    assert stats.paired_bootstrap(df.limit(0)).first()["low"] is None


def test_registered_draws(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(stats, "paired_bootstrap", lambda paired, draws=2000: asked.append(draws) or paired)
    import __spark_entry__ as entry
    from tests.conftest import SF

    entry.queries()["paired_bootstrap"](spark, SF)
    assert asked == [2000]


def test_shift_wording(spark):
    rows = [(0.2, 0.1, 0.3), (-0.2, -0.3, -0.1), (0.2, -0.1, 0.5), (0.2, 0.0, 0.5), (-0.2, -0.4, 0.0), (None, None, None)]
    df = spark.createDataFrame(rows, "m double, l double, h double")
    got = [r[0] for r in df.select(stats.shift_wording(F.col("m"), F.col("l"), F.col("h"))).collect()]
    assert got == ["observed_positive_shift", "observed_negative_shift", *["not_statistically_resolved"] * 3, None]
