"""Artefacts: which rows make them, what their digests tell, and that scoring refuses what does not match."""

from __future__ import annotations

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import hashing
from wakeline.operators import models

ROW = "run_id string, episode_no long, d double, c int, y int"


def rows_of(seed, runs, n=60):
    rng, out = random.Random(seed), []
    for i in range(n):
        d, c = rng.random(), rng.randrange(2)
        out.append((runs[i % len(runs)], i, d, c, int(rng.random() < 1 / (1 + math.exp(-(4 * d + c - 2.5))))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    scale = spark.createDataFrame([("x", 0.5), ("y", 0.1)], "detector_id string, value double")
    return lambda a, b: {r["kind"]: r for r in models.fit_artifacts(spark.createDataFrame(a, ROW), spark.createDataFrame(b, ROW), scale, ["run_id", "episode_no"]).collect()}


def loss(b, rows):
    x = np.array([(1, d, c) for _, _, d, c, _ in rows])
    y = np.array([r[4] for r in rows])
    t = x @ b
    return np.mean(np.logaddexp(0, t) - y * t)


def test_fits_and_digests(made):
    a, b = rows_of(1, ["t1", "t2"]), rows_of(2, ["c1"])
    got = made(a, b)
    best = np.array([got["raw_model"][f"b{i}"] for i in range(3)])
    assert best[1] >= 0 and best[2] >= 0 and got["d_only_model"]["b2"] == 0
    for i in range(3):  # no step in any direction does better (the ridge is 1e-4)
        for step in (-0.05, 0.05):
            other = best + step * np.eye(3)[i]
            assert other.min(initial=0, where=np.array([False, True, True])) < 0 or loss(other, a) > loss(best, a) - 1e-4
    for r in got.values():
        assert r["digest"] == hashlib.sha256(r["payload"].encode()).hexdigest() and json.loads(r["payload"])["kind"] == r["kind"]
    # Order does not matter, other rows do; a calibrator knows its model.
    shuffled = made(a[::-1], b)
    assert [r["digest"] for r in shuffled.values()] == [r["digest"] for r in got.values()]
    other = made([*a[:-1], (*a[-1][:2], 0.123, *a[-1][3:])], b)
    assert all(other[k]["digest"] != got[k]["digest"] for k in got)
    recalibrated = made(a, rows_of(3, ["c1"]))
    assert recalibrated["raw_model"]["digest"] == got["raw_model"]["digest"] and recalibrated["global_calibrator"]["digest"] != got["global_calibrator"]["digest"]


def test_no_fit_of_one_class_and_no_shared_run(made):
    a, b = rows_of(1, ["t1"]), rows_of(2, ["c1"])
    one = [(*r[:4], 0) for r in a]
    got = made(one, b)
    assert {(r["kind"], r["status"], r["reason"]) for r in got.values()} == {("raw_model", "not_fitted", "one_class"), ("d_only_model", "not_fitted", "one_class"), ("global_calibrator", "not_fitted", "no_model")}
    assert made(a, [(*r[:4], 1) for r in b])["global_calibrator"]["reason"] == "one_class"
    with pytest.raises(ValueError, match="in the training and in the calibration"):
        made(a, rows_of(2, ["t1"]))


def test_scoring_by_digest(spark, made):
    got = made(rows_of(1, ["t1"]), rows_of(2, ["c1"]))
    table = spark.createDataFrame([tuple(r) for r in got.values()], models.ARTIFACT)
    m, c = got["raw_model"], got["global_calibrator"]
    rows = spark.createDataFrame([(1, 0.3, 1), (2, 0.9, 0)], "id int, d double, c int")
    for r in models.score(rows, table, F.lit(m["digest"]), F.lit(c["digest"])).collect():
        z = m["b0"] + m["b1"] * r["d"] + m["b2"] * r["c"]
        assert math.isclose(r["z"], z) and math.isclose(r["p"], 1 / (1 + math.exp(-(c["b0"] + c["b1"] * z))))
    for a, b in ((c["digest"], c["digest"]), (m["digest"], m["digest"]), ("0" * 64, c["digest"])):
        with pytest.raises(ValueError, match="no fitted"):
            models.score(rows, table, F.lit(a), F.lit(b))


def test_canonical_records(spark):
    """Nested records against plain Python; keys by UTF-16 units, ECMAScript numbers."""
    schema = "b double, a string, `\U0001f600` int, `דּ` boolean, s struct<z:array<struct<y:int,x:string>>,m:map<string,double>>, n string"
    rows = [(1.0, 'é"\n\x1f/', 1, True, ([(1, "q"), (None, None)], {"k2": 1e21, "k1": 1e-7}), None), (0.1, "", None, None, None, "t")]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(F.struct("*").alias("r")).select(hashing.canonical(F.col("r"))).collect()]
    assert got[0] == '{"a":"é\\"\\n\\u001f/","b":1,"n":null,"s":{"m":{"k1":1e-7,"k2":1e+21},"z":[{"x":"q","y":1},{"x":null,"y":null}]},"\U0001f600":1,"דּ":true}'
    assert got[1] == '{"a":"","b":0.1,"n":"t","s":null,"\U0001f600":null,"דּ":null}'
    with pytest.raises(Exception, match="beyond 2"):
        spark.sql(f"SELECT struct({1 << 53} AS a) AS r").select(hashing.canonical(F.col("r"))).collect()


@pytest.mark.parametrize("value", ["double('NaN')", "double('Infinity')", "float('-Infinity')", "-0D"])
@pytest.mark.parametrize("shape", ["struct({} AS a)", "struct('t' AS t, array(struct(1D AS x), struct({} AS x)) AS a)", "map('k', array({}))"])
def test_canonical_refuses_what_json_has_no_number_for(spark, value, shape):
    with pytest.raises(Exception, match="finite"):
        spark.sql(f"SELECT {shape.format(value)} AS r").select(hashing.canonical(F.col("r"))).collect()


def test_canonical_takes_the_word(spark):
    assert spark.sql("SELECT struct('NaN' AS a, CAST(NULL AS double) AS b) AS r").select(hashing.canonical(F.col("r"))).first()[0] == '{"a":"NaN","b":null}'
