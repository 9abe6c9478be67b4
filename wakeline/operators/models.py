"""Fitted models as versioned artefacts: rows under the digest of what they are, found by it, and refused where it does not match.

An artefact's payload is a canonical JSON record of its kind, its coefficients, and the digests of the rows and of the normaliser that it was made
from; its digest is that of the payload. Coefficients have nine digits, beyond which the order of a sum would show. So a model fitted on other rows is another model, and a row that names a digest is scored by that model or
by none.

A fit needs both classes. Without them its artefact has the status "not_fitted" and no coefficients, and scoring with it is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import hashing
from wakeline.operators import detectors, stats
from wakeline.sources.sinks import materialize

ARTIFACT = "kind string, status string, reason string, b0 double, b1 double, b2 double, payload string, digest string"


def rows_digest(rows: DataFrame, columns: list[str]) -> str:
    """SHA-256 of a set of rows, whatever their order and partitions: rows in 4096 buckets by digest, each bucket's sorted, then the buckets'."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    each = rows.select(F.sha2(F.concat_ws("\x1f", *texts), 256).alias("h"))
    buckets = each.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)).first()[0]
    return whole


def classes(rows: DataFrame, label: str) -> tuple[int, int]:
    """How many rows are of class 0 and of class 1."""
    r = rows.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return r[0], r[1]


def _artifact(kind: str, coefficients: list[float] | None, made_from: dict[str, str], reason: str = "") -> tuple:
    status = "fitted" if coefficients is not None else "not_fitted"
    coefficients = coefficients and [float(f"{x:.9g}") for x in coefficients]
    payload = hashing.canonical_json({"kind": kind, "coefficients": coefficients, "status": status, **made_from})
    b = [*(coefficients or []), *[None] * 3][:3]
    return (kind, status, reason, *b, payload, hashing.text_digest(payload))


def fit_artifacts(training: DataFrame, calibration: DataFrame | None, normalizer: DataFrame, key: list[str]) -> DataFrame:
    """training, calibration: key, d, c, y (0 or 1), of runs of their own. normalizer: detector_id, value. Returns the artefacts (ARTIFACT).

    raw_model has weights for d and c, d_only_model for d alone; global_calibrator is fitted to the raw model's logits of the calibration rows.
    Runs that are in both fail the job. Without calibration rows there is no calibrator among them.
    """
    training = materialize(training.select(*key, "d", "c", "y"), "models-training")
    if calibration is not None:
        calibration = materialize(calibration.select(*key, "d", "c", "y"), "models-calibration")
    if calibration is not None and not training.join(calibration.select("run_id").distinct(), "run_id", "left_semi").isEmpty():
        raise ValueError("a run is in the training and in the calibration rows")
    scale = {"normalizer": rows_digest(normalizer, ["detector_id", "value"])}
    of_training = scale | {"rows": rows_digest(training, [*key, "d", "c", "y"])}
    made, both = [], None
    if min(classes(training, "y")):
        both = stats.bounded_logistic(training, ["d", "c"], "y", lower=[0.0, 0.0])
        alone = stats.bounded_logistic(training.withColumn("c", F.lit(0)), ["d", "c"], "y", lower=[0.0, 0.0])
        made += [_artifact("raw_model", both, of_training), _artifact("d_only_model", [*alone[:2], 0.0], of_training)]
    else:
        made += [_artifact(k, None, of_training, "one_class") for k in ("raw_model", "d_only_model")]
    if calibration is None:
        return training.sparkSession.createDataFrame(made, ARTIFACT)
    of_calibration = scale | {"rows": rows_digest(calibration, [*key, "d", "c", "y"]), "raw_model": made[0][-1]}
    if both is None or not min(classes(calibration, "y")):
        made.append(_artifact("global_calibrator", None, of_calibration, "one_class" if both else "no_model"))
    else:
        z = calibration.select(detectors.logit(F.col("d"), F.col("c"), *both).alias("z"), F.col("y").alias("label"))
        fit = stats.affine_calibrators(z, []).first()
        made.append(_artifact("global_calibrator", [fit["offset"], fit["slope"]], of_calibration))
    return training.sparkSession.createDataFrame(made, ARTIFACT)


def version_set(artifacts: DataFrame) -> str:
    """One digest for all artefacts that belong together."""
    return hashing.text_digest(",".join(sorted(f"{r['kind']}:{r['digest']}" for r in artifacts.select("kind", "digest").collect())))


def score(rows: DataFrame, artifacts: DataFrame, model: Column, calibrator: Column) -> DataFrame:
    """Adds z and p to rows with d and c; model and calibrator are the digests that a row is to be scored by.

    Fails before any row is scored if a digest is unknown, of another kind, or of something that was not fitted.
    """
    named = rows.withColumn("model_digest", model).withColumn("calibrator_digest", calibrator)
    of = {k: artifacts.filter((F.col("kind") == k) & (F.col("status") == "fitted")) for k in ("raw_model", "global_calibrator")}
    asked = named.select("model_digest", "calibrator_digest").distinct()
    for column, kind in (("model_digest", "raw_model"), ("calibrator_digest", "global_calibrator")):
        bad = asked.join(of[kind].select(F.col("digest").alias(column)), column, "left_anti").select(column).first()
        if bad is not None:
            raise ValueError(f"no fitted {kind} has the digest {bad[0]}")
    m = of["raw_model"].select(F.col("digest").alias("model_digest"), F.col("b0").alias("_m0"), F.col("b1").alias("_m1"), F.col("b2").alias("_m2"))
    c = of["global_calibrator"].select(F.col("digest").alias("calibrator_digest"), F.col("b0").alias("_c0"), F.col("b1").alias("_c1"))
    z = F.col("_m0") + F.col("_m1") * F.col("d") + F.col("_m2") * F.col("c")
    joined = named.join(m, "model_digest").join(c, "calibrator_digest").withColumn("z", z)
    return joined.withColumn("p", detectors.sigmoid(F.col("_c0") + F.col("_c1") * F.col("z"))).drop("_m0", "_m1", "_m2", "_c0", "_c1")
