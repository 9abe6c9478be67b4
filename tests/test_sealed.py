"""Sealed runs: what was sealed comes back; unsealed, unknown and changed runs fail."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wakeline.functions.hashing import canonical_json, text_digest
from wakeline.sources import bundles, sealed


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sealed") / "runs")
    events = spark.range(90).repartition(3).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), "id")
    truth = spark.createDataFrame([("r0", [1, 2])], "run_id string, groups array<int>")
    registry = spark.createDataFrame([("r0", "locked", "sealed"), ("r1", "train", "sealed"), ("r2", "train", "open"), ("r9", "train", "sealed")], "run_id string, partition string, status string")
    rows = [tuple(r) for r in sealed.seal({"inputs/events": events, "offline/truth": truth}, registry, path).collect()]
    return path, spark.createDataFrame(rows, sealed.REGISTRY)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "run_id string")


def test_loaded(spark, stored):
    path, registry = stored
    got = [tuple(r) for r in sealed.load_sealed(spark, path, registry, ids(spark, "r0", "r1", "r9")).collect()]
    assert len(got) == 61 and {r[0] for r in got} == {"r0", "r1"}
    assert ("r0", "offline/truth", '{"groups":[1,2],"run_id":"r0"}') in got
    rows = {r["run_id"]: r for r in registry.collect()}
    digests = [text_digest("\x1f".join(r[1:])) for r in got if r[0] == "r1"]
    sums = [sum(int(d[16 * i : 16 * i + 15], 16) for d in digests) for i in range(4)]
    assert rows["r1"]["run_digest"] == text_digest("|".join(map(str, [30, *sums]))) and rows["r9"]["n_objects"] == 0 and rows["r9"]["run_digest"] is None


def test_refused(spark, stored):
    path, registry = stored
    for run, problem in (("r2", "unsealed"), ("r7", "unregistered")):
        with pytest.raises(ValueError, match=problem):
            sealed.load_sealed(spark, path, registry, ids(spark, "r0", run))
    for change in ("NULL", "repeat('0', 64)"):
        other = registry.withColumn("run_digest", F.when(F.col("run_id") == "r1", F.expr(change)).otherwise(F.col("run_digest")))
        with pytest.raises(ValueError, match=r"\('r1', 'changed'\)"):
            sealed.load_sealed(spark, path, other, ids(spark, "r0", "r1"))


def test_changed_behind_a_new_manifest(spark, stored):
    """Someone who changes an object and writes a fitting manifest is still found out by the registry."""
    path, registry = stored
    manifest = bundles.load_manifest(path)
    entry = next(e for e in manifest["files"] if e["name"] == "inputs/events")
    file = Path(path, entry["path"])
    kept, kept_manifest = file.read_text(), Path(path, bundles.MANIFEST).read_text()
    lines = kept.splitlines()
    lines[0] = lines[0].replace('{"id":', '{"id":7')
    file.write_text("\n".join(lines) + "\n")
    entry |= {"bytes": file.stat().st_size, "sha256": "sha256:" + text_digest(file.read_text())}
    manifest["bundle_digest"] = "sha256:" + text_digest(canonical_json(manifest["files"]))
    Path(path, bundles.MANIFEST).write_text(json.dumps(manifest))
    try:
        assert bundles.bundle_problems(spark, path).count() == 0
        with pytest.raises(ValueError, match="changed"):
            sealed.load_sealed(spark, path, registry.withColumn("status", F.lit("sealed")), ids(spark, "r0", "r1", "r2"))
    finally:
        file.write_text(kept)
        Path(path, bundles.MANIFEST).write_text(kept_manifest)
