"""The weighted bootstrap against copies of rows, draw by draw, and the cut generator against one stream."""

from __future__ import annotations

import random

import numpy as np

from wakeline.operators import stats


def metrics(rows):
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    q = np.clip(s, 1e-15, 1 - 1e-15)
    out = {"brier": np.mean((s - y) ** 2), "nll": np.mean(-(y * np.log(q) + (1 - y) * np.log(1 - q)))}
    if len(pos):
        out["step_precision"] = sum((pos == x).sum() * (pos >= x).sum() / (s >= x).sum() for x in np.unique(pos)) / len(pos)
        if len(neg):
            out["auroc"] = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    return out


def test_weights_equal_copies(spark):
    rng = random.Random(3)
    rows = [(f"run:{i % 7}", round(rng.random(), 1), int(rng.random() < 0.3)) for i in range(60)]
    got = {r["field"]: r for r in stats.weighted_bootstrap(spark.createDataFrame(rows, "run_id string, score double, label int"), seed=5, draws=60).collect()}
    runs, gen, values = sorted({r[0] for r in rows}), np.random.default_rng(5), {}
    for _ in range(60):
        drawn = [r for i in gen.integers(0, len(runs), size=len(runs)) for r in rows if r[0] == runs[i]]
        for k, v in metrics(drawn).items():
            values.setdefault(k, []).append(v)
    assert sorted(got) == sorted(values)
    for k, v in values.items():
        assert got[k]["n"] == len(v) and np.allclose([got[k]["low"], got[k]["high"]], np.percentile(v, [2.5, 97.5]), atol=1e-12)


def test_cut_generator(spark):
    got = sorted((r["draw"], r["place"], r["at"]) for r in stats.bootstrap_draws(spark, 23, 1000, 9, block=4).collect())
    gen = np.random.default_rng(9)
    assert got == [(d, p, int(a)) for d in range(23) for p, a in enumerate(gen.integers(0, 1000, size=1000))]
    assert stats.bootstrap_draws(spark, 5, 0, 9).count() == 0


def test_draws_are_not_broadcast(spark, capsys):
    """With 9000 runs, 18 million draws were built into a table on the driver."""
    stats.resampled_means(spark.range(9000).selectExpr("id AS at", "1.0 AS delta"), 9000, 2000, 1).explain()
    plan = capsys.readouterr().out
    assert "Inner, BuildRight" in plan and plan.index("MapInPandas") < plan.index("BroadcastExchange")


def test_weights_are_not_broadcast(spark, capsys):
    weights = stats.bootstrap_draws(spark, 50, 200, 9, counted=True)
    stats._weighed(weights, spark.range(400_000).selectExpr("id AS at", "0.5D AS score", "1L AS pos", "0L AS neg")).explain()
    assert "Inner, BuildRight" in capsys.readouterr().out
