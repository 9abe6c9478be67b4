"""Mixing sources to target weights by entropy balancing (operator 1).

A document of size n may be taken r times on average, 0 <= r <= cap. Among all rates whose tokens sum to each source's target T,
entropy balancing takes those nearest to "once each" (generalised Kullback-Leibler divergence). Its convex dual has one
variable a source, and the rates are exponentially tilted: r = min(cap, exp(lambda * n / mean size)).

* The dual is solved by Newton steps, all sources at once, each step one distributed aggregation over the (source, size)
  histogram, which is all that the dual needs. A bracket keeps every step safe; a step that leaves it is halved instead.
* Rates become whole copies by error diffusion: a source is dealt into hash buckets of bounded size, and in each bucket, from
  large to small documents, a document gets the floor or the ceiling of its rate, whichever keeps the running sum nearest.
  What the large documents of a bucket leave over, its small ones take as further copies (or give back), up to the cap; what a bucket can't place
  goes on to the source's other buckets, until the source is off its target by less than its smallest document
  or a two-thousandth, or has no room left.

Targets: sources in code point order, nulls last, weigh 1, 2, 3, repeating; targets share all tokens by weight, none above
cap times its source's tokens, the excess reshared by weight.

Defined results: null or wordless texts have size 0 and are never taken; a source without any words gets target 0; repeated
rows count as documents of their own; documents of equal size are taken in the order of a hash of their ids; a very long text that its source's target
has no room for is left out; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, parts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """Adds rank (from 0) in code point order, nulls last. The sort is by range, so no task holds all sources."""
    spark = sizes.sparkSession
    ordered = sizes.withColumn("no_source", F.col("source").isNull())
    ordered = ordered.repartitionByRange(parts(spark), "no_source", "source").sortWithinPartitions("no_source", "source")
    # Written once, so that a later run of a task can't deal the ranges differently.
    ordered = materialize(ordered.select("*", F.spark_partition_id().alias("range_no"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "mix-sources")
    before, starts = 0, []
    for r in ordered.groupBy("range_no").count().orderBy("range_no").collect():  # a row for each range, not for each source
        starts.append((r["range_no"], before))
        before += r["count"]
    starts = spark.createDataFrame(starts, "range_no int, start long")
    return ordered.join(F.broadcast(starts), "range_no").withColumn("rank", F.col("start") + F.col("at")).drop("range_no", "at", "start", "no_source")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size -> adds target: min(cap * size, level * weight), at the level where targets share all tokens.

    Each round stops the sources above their cap and reshares the rest by weight; only three sums reach the driver.
    """
    ranked = source_ranks(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "mix-ranks")
    most = F.col("source_size") * F.lit(float(cap))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stopped = F.lit(level) * F.col("weight") > most if level else F.lit(False)
        row = ranked.agg(F.sum(F.when(stopped, most).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))), F.count_if(stopped)).first()
        fixed, free = row[0] or 0.0, row[1] or 0.0
        new = (total - fixed) / free if free > 0 else math.inf
        if new <= level or not free:
            break
        level = new
    level_col = F.least(most, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", level_col).select("source", "source_size", "target")


def dual(hist: DataFrame, goals: DataFrame, cap: float = 3.0, steps: int = 80, tol: float = 1e-9) -> DataFrame:
    """Newton on the dual. hist: source, size > 0, docs. goals: source, source_size, target. Returns source, scale, lam."""
    shape = hist.groupBy("source").agg(F.min("size").alias("least"), F.sum(F.col("size") * F.col("docs")).alias("words"), F.sum("docs").alias("n"))
    scale = F.col("words") / F.col("n")
    first = F.log(F.col("target") / F.col("words"))
    state = shape.join(goals.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s").filter("target > 0")
    state = state.withColumn("scale", scale).withColumn("x0", F.col("least") / F.col("scale"))
    # At lo even the smallest document is at the mean rate needed, so the sum is at most T; at hi all are at the cap.
    state = state.withColumn("lo", F.least(F.lit(0.0), first / F.col("x0"))).withColumn("hi", F.when(F.col("target") <= F.col("words"), 0.0).otherwise(F.log(F.lit(cap)) / F.col("x0")))
    state = state.withColumn("lam", F.greatest(F.col("lo"), F.least(F.col("hi"), first))).withColumn("done", F.col("target") >= cap * F.col("words") * (1 - 1e-12))
    state = materialize(state.withColumn("lam", F.when(F.col("done"), F.col("hi")).otherwise(F.col("lam"))).select("source", "scale", "target", "lo", "hi", "lam", "done"), "mix-dual")
    for _ in range(steps):
        if state.filter(~F.col("done")).isEmpty():
            break
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        rate = F.least(raw, F.lit(float(cap)))
        mass = F.col("size") * F.col("docs")
        sums = hist.join(state.filter(~F.col("done")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(F.sum(mass * rate).alias("got"), F.sum(F.when(raw < cap, mass * rate * x).otherwise(0.0)).alias("slope"))
        state = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        low = F.col("got") <= F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        newton = F.when(F.col("slope") > 0, F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope"))
        new = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        near = (F.abs(F.col("got") - F.col("target")) <= F.lit(tol) * F.col("target")) | (hi - lo <= 1e-14)
        moved = ~F.col("done") & F.col("got").isNotNull()
        state = materialize(
            state.select("source", "scale", "target", F.when(moved, lo).otherwise(F.col("lo")).alias("lo"), F.when(moved, hi).otherwise(F.col("hi")).alias("hi"), F.when(moved & ~near, new).otherwise(F.col("lam")).alias("lam"), (F.col("done") | (moved & near)).alias("done")),
            "mix-dual",
        )
    _unsolved(state)
    return state.select("source", "scale", "lam")


def _copies(size: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Error diffusion over one bucket, large documents first."""
    out = np.floor(rate).astype(np.int64)
    left = rate - out
    short = 0.0
    for i in np.flatnonzero(left > 1e-9):
        short += left[i] * size[i]
        if 2 * short >= size[i]:
            out[i] += 1
            short -= size[i]
    return out


def _settle(size: np.ndarray, copies: np.ndarray, short: float, cap: int) -> np.ndarray:
    """Further copies (or fewer) where words are still lacking (or too many), large documents first, so that less than the smallest is left."""
    out = copies.copy()
    for i in range(len(size)):
        if size[i] <= 0 or 2 * abs(short) < size[-1]:
            break
        more = round(short / size[i]) if i == len(size) - 1 else int(short / size[i])  # towards zero, so smaller ones can fill up
        out[i] = min(cap, max(0, out[i] + more))
        short -= (out[i] - copies[i]) * size[i]
    return out


def _round(cap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "pick", "doc_id"], ascending=[False, True, True], kind="stable")
        size, rate = pdf["size"].to_numpy(np.int64), pdf["rate"].to_numpy(float)
        copies = _copies(size, rate)
        pdf["copies"] = _settle(size, copies, float((rate - copies) @ size), math.floor(cap))
        return pdf[_ROUNDED]

    return run


def _further(cap: float):
    """One bucket's part in what its source still lacks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "pick", "doc_id"], ascending=[False, True, True], kind="stable")
        pdf["copies"] = _settle(pdf["size"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), float(pdf["share"].iloc[0]), math.floor(cap))
        return pdf[_ROUNDED]

    return run


#: A source is at its target if it is off by less than this share, or by less than its smallest document.
NEAR = 0.0005
_ROUNDED = ["doc_id", "source", "size", "source_size", "target", "rate", "pick", "bucket", "copies"]
_ROUNDED_TYPES = "doc_id long, source string, size long, source_size long, target double, rate double, pick long, bucket long, copies long"


def _carried(copies: DataFrame, cap: float, rounds: int = 4) -> DataFrame:
    """Sources that are off their target: the rest is dealt to their buckets by the room these have, again and again."""
    taken = F.col("copies") * F.col("size")
    goal = copies.groupBy("source").agg(F.max("target").alias("target"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goal = materialize(goal.withColumnRenamed("source", "s"), "mix-goals")
    for _ in range(rounds):
        sums = copies.groupBy("source").agg(F.sum(taken).alias("taken")).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        short = F.col("target") - F.col("taken")
        off = sums.filter(F.abs(short) >= F.greatest(F.col("least"), NEAR * F.col("target"))).select(F.col("source").alias("s"), short.alias("short"))
        off = materialize(off, "mix-off")
        if off.isEmpty():
            break
        # Only documents no larger than what is lacking can help.
        room = F.when(F.col("short") > 0, (math.floor(cap) - F.col("copies")) * F.col("size")).otherwise(taken)
        able = copies.join(off, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("size") > 0) & (F.col("size") <= F.abs("short")))
        buckets = materialize(able.groupBy("s", F.col("bucket").alias("b"), "short").agg(F.sum(room).alias("room")).filter("room > 0"), "mix-rooms")
        whole = buckets.groupBy(F.col("s").alias("s2")).agg(F.sum("room").alias("whole"))
        shares = buckets.join(whole, F.col("s").eqNullSafe(F.col("s2"))).select("s", "b", (F.col("short") * F.least(F.lit(1.0), F.col("room") / F.col("whole"))).alias("share"))
        marked = copies.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left").drop("s", "b")
        again = marked.filter("share IS NOT NULL").groupBy("source", "bucket").applyInPandas(_further(cap), _ROUNDED_TYPES)
        before, copies = copies, materialize(marked.filter("share IS NULL").select(*_ROUNDED).unionByName(again), "mix-copies")
        if before.agg(F.sum(taken)).first() == copies.agg(F.sum(taken)).first():
            break
    return copies


def _unsolved(state: DataFrame) -> None:
    if not state.filter(~F.col("done")).isEmpty():
        raise RuntimeError("the dual is not solved: some source has not come to its target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, rows_per_bucket: int = 8192) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken (copies times size)."""
    spark = docs.sparkSession
    light = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    hist = materialize(light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size"), F.sum("docs").alias("n_docs"))
    goals = materialize(targets(sizes.drop("n_docs"), weights, cap), "mix-targets")
    lams = dual(hist.filter("size > 0"), goals, cap)
    plan = goals.alias("g").join(lams.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left").join(sizes.alias("z"), F.col("g.source").eqNullSafe(F.col("z.source")))
    plan = materialize(plan.select(F.col("g.source").alias("s"), F.col("g.source_size").alias("source_size"), "target", "scale", "lam", F.ceil(F.col("n_docs") / rows_per_bucket).alias("buckets")), "mix-plan")
    rated = light.join(plan, F.col("source").eqNullSafe(F.col("s")))
    rate = F.when((F.col("size") > 0) & F.col("lam").isNotNull(), F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0))))).otherwise(0.0)
    pick = F.xxhash64("doc_id", "size")
    rated = rated.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), pick.alias("pick"), F.pmod(F.xxhash64(F.lit("bucket"), "doc_id"), F.col("buckets")).alias("bucket"))
    copies = materialize(rated.groupBy("source", "bucket").applyInPandas(_round(cap), _ROUNDED_TYPES), "mix-copies")
    return _carried(copies, cap).drop("pick", "bucket").withColumn("taken", F.col("copies") * F.col("size"))
