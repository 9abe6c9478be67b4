"""Bundles: commit by manifest, refusals, damage; scans of many files with rejects."""

from __future__ import annotations

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wakeline.functions.hashing import canonical_json
from wakeline.sources import bundles


def frames(spark, n=500):
    a = spark.range(n).repartition(3).select("id", F.concat(F.lit("é\n\"x"), F.col("id")).alias("text"), (F.col("id") / 7).alias("z"), F.lit(None).cast("string").alias("none"))
    return {"online/a": a, "b": spark.range(3).select(F.array("id").alias("list"))}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "one")
    bundles.save_bundle(frames(spark), path, "test", {"seed": 7}, max_bytes=2000)
    rows = bundles.read_bundle(spark, path).collect()
    want = {canonical_json({"id": i, "text": f'é\n"x{i}', "z": i / 7, "none": None}) for i in range(500)}
    assert {r["record"] for r in rows if r["name"] == "online/a"} == want and len(rows) == 503
    assert sorted(r["record"] for r in bundles.read_bundle(spark, path, ["b"]).collect()) == ['{"list":[0]}', '{"list":[1]}', '{"list":[2]}']
    assert bundles.read_bundle(spark, path, ["none such"]).count() == 0
    manifest = json.loads(Path(path, bundles.MANIFEST).read_text())
    assert manifest["metadata"] == {"seed": 7} and sum(e["rows"] for e in manifest["files"]) == 503 and len(manifest["files"]) > 12  # files are rolled
    by_file: dict = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r["line"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_file.values())
    assert bundles.bundle_problems(spark, path).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["one"]  # nothing is left beside it


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "two")
    for name in ["", "/a", "../a", "a/../b", "a//b", "./a", "a\\b", "c:a", bundles.MANIFEST, f"x/{bundles.MANIFEST}", "a\nb"]:
        with pytest.raises(ValueError):
            bundles.save_bundle({name: spark.range(1)}, path, "test")
    with pytest.raises(ValueError):
        bundles.save_bundle({"a": spark.range(1)}, "file:///", "test")
    assert not Path(path).exists()
    bundles.save_bundle({"a": spark.range(4)}, path, "test")
    with pytest.raises(Exception, match="not empty"):
        bundles.save_bundle({"a": spark.range(5)}, path, "test")
    with pytest.raises(Exception, match="finite"):  # a job that fails leaves the old bundle as it was
        bundles.save_bundle({"a": spark.range(9).select(F.when(F.col("id") == 8, math.nan).otherwise(1.0).alias("x"))}, path, "test", force=True)
    assert bundles.read_bundle(spark, path).count() == 4
    Path(path, "stray").write_text("x")
    bundles.save_bundle({"c": spark.range(6)}, path, "test", force=True)
    assert {r["name"] for r in bundles.read_bundle(spark, path).collect()} == {"c"} and not Path(path, "stray").exists()
    assert [p.name for p in tmp_path.iterdir()] == ["two"]


def test_damage(spark, tmp_path):
    path = tmp_path / "three"
    bundles.save_bundle({"a": spark.range(50).repartition(2), "empty": spark.range(0)}, str(path), "test")
    file = next(iter(sorted(path.glob("a/*"))))
    text = file.read_text()
    problems = lambda: [(r["file"].split("/")[0], r["problem"]) for r in bundles.bundle_problems(spark, str(path)).collect()]
    file.write_text(text.replace('"id":1', '"id":2', 1) if '"id":1' in text else text.replace('"id":2', '"id":3', 1))
    assert problems() == [("a", "changed")]
    with pytest.raises(Exception, match="digest differs"):  # same size: found while reading
        bundles.read_bundle(spark, str(path)).count()
    file.write_text(text + "{}\n")
    with pytest.raises(Exception, match="another size"):
        bundles.read_bundle(spark, str(path)).count()
    file.write_text(text)
    (path / "more").write_text("{}\n")
    assert problems() == [("more", "unexpected")]
    (path / "more").unlink()
    file.unlink()
    assert problems() == [("a", "missing")]
    file.write_text(text)
    assert bundles.read_bundle(spark, str(path)).count() == 50
    manifest = path / bundles.MANIFEST
    manifest.write_text(manifest.read_text().replace('"rows": ', '"rows": 1'))
    with pytest.raises(Exception, match="bundle's digest"):
        bundles.read_bundle(spark, str(path)).count()


def test_empty_bundle(spark, tmp_path):
    path = str(tmp_path / "empty")
    bundles.save_bundle({"a": spark.range(0)}, path, "test")
    assert bundles.load_manifest(path)["files"] == [] and bundles.read_bundle(spark, path).count() == 0 and bundles.bundle_problems(spark, path).count() == 0


def test_scan(spark, tmp_path):
    one, two = tmp_path / "one.ndjson", tmp_path / "two.ndjson"
    one.write_text('{"object_type": "A", "k": 1}\n\n{"object_type": "B", "k": 2}\n[1]\n{"k": 3}\n')
    two.write_text('{"object_type": "A", "k": -4}\n{"object_type": "A", "k": NaN}\n  \n{"object_type": "A"\n{"object_type": "A", "k": 9007199254740993}\n{"object_type": 7, "k": 5}')
    good, bad = bundles.scan_objects(spark, [str(one), str(two)], ["A"], "try_variant_get(v, '$.k', 'long') > 0 OR object_type = 'B'")
    at = lambda r: (r["file"].split("/")[-1], r["line"])
    assert {(*at(r), r["object_type"]) for r in good.collect()} == {("one.ndjson", 1, "A")}
    assert {(*at(r), r["reason"]) for r in bad.collect()} == {
        ("one.ndjson", 4, "not_object"), ("one.ndjson", 5, "no_type"), ("two.ndjson", 1, "contract"), ("two.ndjson", 2, "invalid"), ("two.ndjson", 4, "invalid"), ("two.ndjson", 5, "range"),
    }


def test_pretty():
    assert bundles.pretty_json({"b": 1, "a": ["é"]}) == '{\n  "a": [\n    "é"\n  ],\n  "b": 1\n}\n'
    with pytest.raises(ValueError):
        bundles.pretty_json({"a": math.inf})
