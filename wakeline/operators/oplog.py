"""A log of operations on records, folded by four designs of a store: what each operation does, what is left, which properties hold.

Operations on a key, in order: success and failure (the outcome of an attempt), late (evidence that comes after it), update, delete.

    mutable      one record a key that everything changes in place; failures leave nothing
    noncanonical records are appended, references as they came; late evidence takes the place of the newest; failures leave nothing
    silent       records and successors are appended, references in order; failures leave nothing
    append_only  the first outcome of a key stays: the same again is idempotent, any other is rejected; failures are records; late evidence
                 makes a successor within the horizon and a record of its own beyond it; update and delete are rejected

What an operation meets depends on its key's earlier ones. Keys are cut into slices: each slice is aggregated, the aggregates of a key's slices are
merged in order, and a slice starts from what is merged before it. So a hot key is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.hashing import sha256_text
from wakeline.operators.numbering import numbered

VARIANTS = ["mutable", "noncanonical", "silent", "append_only"]
#: Outcomes that leave a record which was not there before, and those that alter or remove one.
LEAVES, ALTERS = ["stored", "appended", "successor", "late_record"], ["changed", "replaced", "removed"]


def fold_log(ops: DataFrame, key: list[str], order: list[str], slice_of: Column) -> DataFrame:
    """key, order, n (the place in the key's log, from 1), variant, op, outcome, revision, record_digest, replays; a row for each operation and variant.

    ops: key, order, op, content (text), refs (array of text), within (boolean: inside the horizon; null: not). slice_of must rise with the order.
    outcome: stored, appended, successor, late_record, idempotent, rejected, changed, replaced, removed, lost (an attempt of which nothing is left)
    or ignored (there is nothing to act on, or the operation is none of the five). revision: how many successors the key has so far. The digest, of
    outcomes that leave or change a record, is over key, revision, content and references; replays: the same references in the opposite order
    give it again. Null keys are a key; operations that are alike in everything are told apart by their place.
    """
    names = [*key, *order, "op", "content", "refs", "within"]
    rows = numbered(ops.select(*names).withColumn("_s", slice_of).withColumn("_key", F.to_json(F.array(*[F.col(c).cast("string") for c in key]))), ["_key"], F.col("_s"), [*order, "op", "content", "refs", "within"], "n")
    op = F.col("op")
    here = F.struct("n", "op", "content")
    slices = rows.groupBy("_key", "_s").agg(
        F.min(F.when(op.isin("success", "failure"), here)).alias("_outcome"), F.min(F.when(op == "success", F.col("n"))).alias("_success"),
        F.max(F.when(op.isin("success", "update", "delete"), here)).alias("_control"),
    )
    of_key = Window.partitionBy("_key").orderBy("_s")
    whole, before = Window.partitionBy("_key"), of_key.rowsBetween(Window.unboundedPreceding, -1)
    merged = slices.select("_key", "_s", F.min("_outcome").over(whole).alias("_outcome"), F.min("_success").over(whole).alias("_success"), F.max("_control").over(before).alias("_control"))
    earlier = Window.partitionBy("_key", "_s").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    control = F.coalesce(F.max(F.when(op.isin("success", "update", "delete"), F.struct("n", "op"))).over(earlier)["op"], F.col("_control.op"))
    met = rows.join(merged.withColumnRenamed("_control", "_c").withColumn("_control", F.struct(F.col("_c.op").alias("op"))).drop("_c"), ["_key", "_s"]).withColumn("_there", F.coalesce(control != "delete", F.lit(False)))
    late, after_success = op == "late", F.coalesce(F.col("_success") < F.col("n"), F.lit(False))
    succeeds = late & after_success & (F.col("_outcome.op") == "success")
    met = met.withColumn("_after", after_success.cast("long")).withColumn("_silent", F.coalesce(late & after_success, F.lit(False)).cast("long"))
    met = met.withColumn("_strict", F.coalesce(succeeds & F.col("within"), F.lit(False)).cast("long")).withColumn("_beyond", F.coalesce(succeeds, F.lit(False)))
    met = numbered(met.withColumnRenamed("_s", "_slice"), ["_key"], F.col("_slice"), ["n"], "_again", {"_r_silent": "_silent", "_r_strict": "_strict"})
    cases = F.array(*[F.struct(F.lit(v).alias("variant"), outcome.alias("outcome"), r.alias("revision")) for v, (outcome, r) in _outcomes().items()])
    out = met.select("_key", *names, "n", F.inline(cases))
    digest = lambda refs: F.when(F.col("outcome").isin(*LEAVES, "changed", "replaced"), _digest(refs))
    plain = F.col("variant") == "noncanonical"
    given, turned = F.when(plain, F.col("refs")).otherwise(F.array_sort("refs")), F.when(plain, F.reverse("refs")).otherwise(F.array_sort(F.reverse("refs")))
    return out.select(*key, *order, "n", "variant", "op", "outcome", "revision", digest(given).alias("record_digest"), (digest(given) == digest(turned)).alias("replays"))


def _digest(refs: Column) -> Column:
    parts = [F.col("_key"), F.col("revision").cast("string"), F.coalesce("content", F.lit("")), F.array_join(F.coalesce(refs, F.array().cast("array<string>")), "\x1e", "")]
    return sha256_text(F.concat_ws("\x1f", *parts))


def _outcomes() -> dict[str, tuple[Column, Column]]:
    """Outcome and revision of each variant, from what an operation meets."""
    op, there, after = F.col("op"), F.col("_there"), F.col("_after") == 1
    first, same = F.col("n") == F.col("_outcome.n"), (op == F.col("_outcome.op")) & F.col("content").eqNullSafe(F.col("_outcome.content"))
    attempts = F.when(op == "failure", "lost")
    mutable = attempts.when(op.isin("success", "update"), F.when(there, "changed").otherwise("stored")).when(op == "delete", F.when(there, "removed").otherwise("ignored"))
    mutable = mutable.when(op == "late", F.when(there, "changed").otherwise("ignored"))
    appends = attempts.when(op == "success", "appended").when(op.isin("update", "delete"), "rejected")
    strict = F.when(op.isin("success", "failure"), F.when(first, "stored").when(same, "idempotent").otherwise("rejected")).when(op.isin("update", "delete"), "rejected")
    strict = strict.when(op == "late", F.when(F.col("_strict") == 1, "successor").when(F.col("_beyond"), "late_record").otherwise("rejected"))
    none, ignored = F.lit(0).cast("long"), "ignored"
    return {
        "mutable": (mutable.otherwise(ignored), none),
        "noncanonical": (appends.when((op == "late") & after, "replaced").otherwise(ignored), F.col("_r_silent")),
        "silent": (appends.when((op == "late") & after, "successor").otherwise(ignored), F.col("_r_silent")),
        "append_only": (strict.otherwise(ignored), F.col("_r_strict")),
    }


def store_state(folded: DataFrame, key: list[str]) -> DataFrame:
    """For each key and variant: operations, records that were left, alterations of earlier ones, attempts without any record, rejections, revision."""
    count = lambda c, name: F.count_if(c).alias(name)
    outcome = F.col("outcome")
    return folded.groupBy(*key, "variant").agg(
        F.count(F.lit(1)).alias("n_ops"), count(outcome.isin(LEAVES), "records"), count(outcome.isin(ALTERS), "altered"), count(outcome == "lost", "lost"),
        count(outcome == "rejected", "rejected"), count(outcome == "idempotent", "idempotent"), F.max("revision").alias("revision"),
    )


def store_properties(folded: DataFrame) -> DataFrame:
    """For each variant: which properties its store kept over the whole log, and the share of records that a replay gives byte by byte (null: no record)."""
    op, outcome = F.col("op"), F.col("outcome")
    never = lambda c, name: (F.count_if(c) == 0).alias(name)
    return folded.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_ops"),
        never((op == "late") & outcome.isin(ALTERS), "immutable_under_late"),
        never(~F.col("replays"), "byte_identical_replay"),
        F.round(F.count_if("replays") / F.nullif(F.count("record_digest"), F.lit(0)), 9).alias("replay_rate"),
        never((op == "failure") & (outcome == "lost"), "explicit_failure"),
        never(op.isin("success", "update", "delete") & outcome.isin(ALTERS), "append_only"),
        F.count_if(op.isin("success", "failure") & (outcome == "rejected")).alias("conflicts_found"),
    )
