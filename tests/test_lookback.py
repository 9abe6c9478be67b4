"""Looking back and selection against plain loops, over slices of all widths."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wakeline.operators import lookback, selection

S = 1_000_000


@pytest.mark.parametrize("seed", range(2))
def test_trailing_distinct(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(2)}", f"x{rng.randrange(2)}", f"g{rng.randrange(5)}", rng.randrange(6000) * S // rng.choice([1, 7]), i) for i in range(300)]
    rows += [("r0", "x0", "g0", 100 * S, 900), ("r0", "x0", "g1", 700 * S, 901), ("r0", "x0", "g0", 700 * S, 902), ("r0", "x0", "g2", 700 * S + 1, 903)]
    frame = spark.createDataFrame(rows, "run_id string, entity string, g string, t long, id int")
    got = {r["id"]: r["n"] for r in lookback.trailing_distinct(frame, ["run_id", "entity"], "g", "t", 600 * S, "n").collect()}
    assert got == {i: len({g2 for a, b, g2, t2, _ in rows if (a, b) == (run, x) and t - 600 * S <= t2 <= t}) for run, x, _, t, i in rows}


@pytest.mark.parametrize("slice_s", [1, 50, 100_000])
def test_previous(spark, slice_s):
    rng = random.Random(slice_s)
    rows = sorted({(f"k{rng.randrange(3)}", rng.randrange(400) * S, f"e{i:03}") for i in range(120)})
    got = {r["id"]: (r["prev"] and tuple(r["prev"]), r["start_us"]) for r in lookback.previous(spark.createDataFrame(rows, "k string, t long, id string"), ["k"], "t", "id", 5 * S, slice_s * S).collect()}
    for k in ("k0", "k1", "k2"):
        last, start = None, None
        for _, t, i in (r for r in rows if r[0] == k):
            start = t if last is None or t - last[0] > 5 * S else start
            assert got[i] == (last, start)
            last = (t, i)


def test_percentiles(spark):
    rng = np.random.default_rng(4)
    of = {"a": rng.standard_normal(1000), "b": np.array([3.0]), "c": np.repeat([1.0, 2.0], 50), "d": 10.0 ** rng.uniform(-300, 300, 99), "e": np.array([-1e308, 1e308])}
    rows = [(g, float(v)) for g, values in of.items() for v in values] + [("a", None), ("f", None), ("a", float("nan"))]
    shares = {"low": 0.025, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["g"]: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares, fan=8).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e"] and got["a"]["n"] == 1000
    for g, values in of.items():
        if g != "e":
            assert all(np.isclose(got[g][name], np.quantile(values, q), rtol=1e-12) for name, q in shares.items())
    assert got["e"]["top"] == 1e308
