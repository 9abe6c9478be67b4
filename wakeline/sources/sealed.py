"""Runs that are sealed: their objects in a bundle, and a registry with a digest of each run, written when it was sealed.

A run's digest is folded from its objects' digests by sums, so it is found in one aggregation, whatever the order, and no run is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.hashing import canonical
from wakeline.sources.bundles import read_bundle, save_bundle

REGISTRY = "run_id string, partition string, status string, n_objects long, run_digest string"


def run_digests(records: DataFrame) -> DataFrame:
    """run_id, n_objects, run_digest of (run_id, name, record): SHA-256 over the number of objects and the sum of the four quarters of their digests."""
    own = F.sha2(F.concat_ws("\x1f", "name", "record"), 256)
    quarter = lambda i: F.sum(F.conv(F.substring("_d", 16 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    sums = records.select("run_id", own.alias("_d")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_objects"), *[quarter(i).alias(f"_s{i}") for i in range(4)])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("n_objects", "_s0", "_s1", "_s2", "_s3")])
    return sums.select("run_id", "n_objects", F.sha2(text, 256).alias("run_digest"))


def seal(frames: dict[str, DataFrame], registry: DataFrame, path: str) -> DataFrame:
    """Writes every frame (each has run_id, not null) as one bundle under path and returns the registry (run_id, partition, status; a row a run), with the
    number of objects and the digest of each run from what was given, not from what was written. A run without objects has 0 and no digest."""
    save_bundle(frames, path, "sealed-runs")
    records = None
    for name, df in frames.items():
        part = df.select("run_id", F.lit(name).alias("name"), canonical(F.struct(*df.columns)).alias("record"))
        records = part if records is None else records.unionByName(part)
    rows = registry.select("run_id", "partition", "status").join(run_digests(records), "run_id", "left")
    return rows.select("run_id", "partition", "status", F.coalesce("n_objects", F.lit(0)).cast("long").alias("n_objects"), "run_digest")


def load_sealed(spark: SparkSession, path: str, registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, name, record of the wanted runs (run_id, distinct). The job fails if a wanted run is not registered, not sealed, or holds other objects
    than those that were sealed. Objects of other runs are not given out; those of runs that nobody registered are ignored."""
    records = read_bundle(spark, path).select(F.get_json_object("record", "$.run_id").alias("run_id"), "name", "record")
    chosen = records.join(wanted.select("run_id").distinct(), "run_id", "left_semi")
    checked = check_runs(registry, run_digests(chosen), wanted)
    if (bad := checked.filter("problem IS NOT NULL").orderBy("run_id").limit(20).collect()):
        raise ValueError(f"runs that can't be loaded: {[(r['run_id'], r['problem']) for r in bad]}")
    return chosen


def check_runs(registry: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, problem (unregistered, unsealed, missing, changed; null: none) of every wanted run."""
    stated = registry.select("run_id", "status", F.col("n_objects").alias("_n"), F.col("run_digest").alias("_digest"), F.lit(True).alias("_there"))
    rows = wanted.select("run_id").distinct().join(stated, "run_id", "left").join(found, "run_id", "left")
    return rows.select("run_id", _problem().alias("problem"))


def _problem() -> Column:
    gone = F.col("n_objects").isNull() & (F.col("_n") > 0)
    same = F.col("_digest").eqNullSafe(F.col("run_digest")) & (F.col("_n") == F.coalesce("n_objects", F.lit(0)))
    sealed = F.coalesce(F.col("status") == "sealed", F.lit(False))
    return F.when(F.col("_there").isNull(), "unregistered").when(~sealed, "unsealed").when(gone, "missing").when(~F.coalesce(same, F.lit(False)), "changed")
