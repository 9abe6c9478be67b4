from __future__ import annotations

import hashlib
import hmac
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import hashing
from wakeline.operators import evaluation, stats
from wakeline.sources import sinks


def test_hmac_and_draws(spark):
    key = bytes(range(20))
    df = spark.createDataFrame([("a",), ("é\x1f",), ("",)], "k string")
    rows = df.select("k", hashing.hmac_sha256(key, F.col("k")).alias("h"), hashing.uniform(key.hex(), "d", F.col("k")).alias("u")).collect()
    for r in rows:
        assert r["h"] == hmac.new(key, r["k"].encode(), hashlib.sha256).hexdigest()
        want = int.from_bytes(hmac.new(key, b"d\x1f" + r["k"].encode(), hashlib.sha256).digest()[:8], "big") / 2**64
        assert math.isclose(r["u"], want, rel_tol=1e-15)


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (1e-5, "0.00001"), (1e-7, "1e-7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (0.1, "0.1"), (-1.5, "-1.5"), (1.25e-9, "1.25e-9"), (5e-324, "5e-324"), (1e22, "1e+22"), (1.5e300, "1.5e+300")])
def test_canonical_numbers(x, text):
    assert hashing.es6_number(x) == text
    assert float(text) == x


def test_canonical_json():
    assert hashing.canonical_json({"b": [1, 2.0, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,2,null,true]}'
    for bad in (float("nan"), float("inf"), -0.0):
        with pytest.raises(ValueError, match="finite"):
            hashing.canonical_json([bad])


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_the_best(spark, seed):
    """Most edges first, then the largest weight."""
    rng = random.Random(seed)
    density = rng.choice((0.3, 0.7))
    edges = [("r", e, f"g{g}", round(rng.random(), 3), rng.random(), rng.randrange(1000)) for e in range(4) for g in range(5) if rng.random() < density]
    schema = "run_id string, episode_no long, group_id string, weight double, jaccard double, apart_us long"
    got = evaluation.assignment(spark.createDataFrame(edges, schema)).collect()
    weight = {(e, g): w for _, e, g, w, _, _ in edges}
    found = ([(e, f"g{g}") for e, g in enumerate(p) if (e, f"g{g}") in weight] for p in itertools.permutations(range(5), 4))
    most, best = max((len(pairs), sum(weight[x] for x in pairs)) for pairs in found)
    assert len(got) == most and math.isclose(sum(r["weight"] for r in got), best, abs_tol=1e-9)
    assert len({r["group_id"] for r in got}) == len(got) == len({r["episode_no"] for r in got})


def test_bounded_logistic(spark):
    rows = [(0.1, 0), (0.2, 0), (0.75, 1), (0.9, 1), (0.5, 0), (0.55, 1)]
    df = spark.createDataFrame([(d, 1 if d > 0.7 else 0, y) for d, y in rows], "d double, c int, y int")
    b = stats.bounded_logistic(df, ["d", "c"], "y", ridge=1e-2, lower=[0.0, 0.0])
    assert b[0] < 0 < b[1] and b[2] >= 0
    flipped = stats.bounded_logistic(df.withColumn("y", 1 - F.col("y")), ["d", "c"], "y", ridge=1e-2, lower=[0.0, 0.0])
    assert flipped[1:] == [0.0, 0.0]


def test_sign_test():
    assert stats.sign_test(0, 0) == 1.0
    assert stats.sign_test(5, 0) == 2 / 32
    assert stats.sign_test(3, 3) == 1.0


def test_terminal_store(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("m", 1, None), ("m", 2, None)], "key string, t int, c string")
    got = {(r["key"], r["t"]): r["outcome"] for r in sinks.terminal_store(df, ["key"], ["t"], "c").collect()}
    assert got == {("k", 1): "stored", ("k", 2): "idempotent", ("k", 3): "rejected", ("m", 1): "stored", ("m", 2): "idempotent"}


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "b")
    sinks.write_bundle({"x": spark.range(5)}, path)
    stored = sinks.materialize(sinks.manifest(spark, path), "m")
    assert sinks.compare_manifests(stored, sinks.manifest(spark, path)).count() == 0
    changed = next((tmp_path / "b" / "x").glob("*.json"))
    changed.write_text(changed.read_text() + " ")
    changed.with_name(f".{changed.name}.crc").unlink()  # the local file system's own checksum
    assert {r["problem"] for r in sinks.compare_manifests(stored, sinks.manifest(spark, path)).collect()} == {"changed"}
    with pytest.raises(Exception, match="already exists"):
        sinks.write_bundle({"x": spark.range(5)}, path)


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n\n[1]\nnot json\n{"id": 2}\n')
    good, bad = sinks.read_ndjson(spark, str(tmp_path / "a.json"), "id int")
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert sorted(r["value"] for r in bad.collect()) == ["[1]", "not json"]
