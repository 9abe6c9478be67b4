"""The one terminal record of a revision: a success, or a failure with the first code, in contract order, that its inputs give cause for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the inputs of an assembly and the codes of its failures, both in order.
INPUTS = ["EpisodeRevision", "FeatureVector", "RawLogit", "SupportDecision", "CalibratedProbability", "UProfile", "SourceCoverage"]
CODES = ["schema_invalid", "key_mismatch", "conflicting_duplicate", "digest_mismatch", "version_mismatch", "missing_input", "assembly_timeout"]


def in_order(names: Column, order: list[str]) -> Column:
    """The values of a fixed list that an array holds, in the order of the list. Null is no value."""
    held = F.coalesce(names, F.array().cast("array<string>"))
    return F.filter(F.array(*[F.lit(n) for n in order]), lambda n: F.array_contains(held, n))


def first_code(signs: dict[str, Column]) -> Column:
    """The first code in contract order whose sign is true; null if none is. Null signs are false."""
    return F.coalesce(*[F.when(signs[c], F.lit(c)) for c in CODES if c in signs])


def assemble(revisions: DataFrame, inputs: DataFrame, key: list[str], versions: dict[str, str], limit_us: int) -> DataFrame:
    """key, outcome (success, failure), failure_code, observed (input types in contract order), n_inputs; one row a revision, whatever its inputs are.

    revisions: key (unique), revision_digest, elapsed_us (null: none). inputs: key, input_type, valid (boolean; null: not), revision_digest (the one
    the input was made for), content, stated_digest (of the content), version. An input is wrong by its

        schema     it is not valid, or its type is none of the seven
        key        it was made for another revision
        duplicate  inputs of one type differ in content; equal ones are one input
        digest     the digest stated is not the content's SHA-256
        version    the version is not its type's in `versions` (types that are not listed: any)

    then come types that are missing, and a time above the limit. Inputs of revisions that do not exist are dropped. Inputs are folded by
    (key, type) first, so that copies of one input, however many, are pre-aggregated; a revision has at most the eight rows that come out.
    """
    kind = F.when(F.col("input_type").isin(INPUTS), F.col("input_type"))
    want = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]) if versions else F.create_map().cast("map<string,string>")
    own = revisions.select(*key, F.col("revision_digest").alias("_own"), "elapsed_us")
    wrong = lambda c: F.max(F.coalesce(c, F.lit(True)))
    contents = F.struct(F.col("content").isNull().alias("_null"), "content")
    by_type = inputs.withColumn("_kind", kind).groupBy(*key, "_kind").agg(
        wrong(~F.col("valid") | F.col("_kind").isNull()).alias("_schema"),
        F.min("revision_digest").alias("_low"), F.max("revision_digest").alias("_high"), F.max(F.col("revision_digest").isNull()).alias("_keyless"),
        (~F.min(contents).eqNullSafe(F.max(contents))).alias("_conflict"),
        wrong(F.col("stated_digest") != F.sha2(F.col("content").cast("binary"), 256)).alias("_digest"),
        F.max(F.coalesce(F.col("version") != want[F.col("_kind")], want[F.col("_kind")].isNotNull())).alias("_version"), F.count(F.lit(1)).alias("_n"),
    )
    matched = own.join(by_type, key, "left")
    other = F.col("_n").isNotNull() & F.coalesce(F.col("_keyless") | (F.col("_low") != F.col("_own")) | (F.col("_high") != F.col("_own")), F.lit(True))
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    folded = matched.groupBy(*key).agg(
        some(F.col("_schema")).alias("_schema"), some(other).alias("_key"), some(F.col("_conflict")).alias("_conflict"), some(F.col("_digest")).alias("_digest"),
        some(F.col("_version")).alias("_version"), F.collect_set("_kind").alias("_kinds"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_inputs"), F.max("elapsed_us").alias("_elapsed"),
    )
    signs = dict(zip(CODES, [F.col("_schema"), F.col("_key"), F.col("_conflict"), F.col("_digest"), F.col("_version"), F.size("_kinds") < len(INPUTS), F.col("_elapsed") > limit_us], strict=True))
    code = folded.withColumn("failure_code", first_code(signs))
    return code.select(*key, F.when(F.col("failure_code").isNull(), "success").otherwise("failure").alias("outcome"), "failure_code", in_order(F.col("_kinds"), INPUTS).alias("observed"), "n_inputs")
