"""Summaries, paired comparisons, bootstraps, fits: small results of large tables.

What reaches the driver is always aggregated first: rows per run, counts per distinct value, sums of a fit.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.detectors import sigmoid
from wakeline.operators.evaluation import clipped_nll
from wakeline.operators.numbering import numbered
from wakeline.operators.selection import percentiles
from wakeline.sources.sinks import materialize


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), bounds, and how many values are defined."""
    n = F.count(value)
    return rows.groupBy(*group).agg(n.alias("defined"), (F.count(F.lit(1)) - n).alias("undefined"), F.avg(value).alias("mean"), F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))


#: Rows of two numbers that may be broadcast: some 32 MB.
BROADCAST_ROWS = 1_000_000

LCG_A, LCG_C, LCG_BITS = 1_103_515_245, 12_345, 31


def lcg_power(n: int) -> tuple[int, int]:
    """(a, c) so that n steps of the generator take a state s to (a s + c) mod 2**31, by squaring."""
    mod, (a, c), (pa, pc) = 1 << LCG_BITS, (1, 0), (LCG_A, LCG_C)
    while n:
        if n & 1:
            a, c = pa * a % mod, (pa * c + pc) % mod
        pa, pc, n = pa * pa % mod, (pa * pc + pc) % mod, n >> 1
    return a, c


def _lcg(size: int, seed: int, block: int = 16_384):
    def run(batches):
        mask = np.uint64((1 << LCG_BITS) - 1)
        a, c = (np.array(x, np.uint64) for x in zip(*[lcg_power(i) for i in range(1, min(block, size) + 1)], strict=True))
        for batch in batches:
            for d in batch["id"]:
                pa, pc = lcg_power(int(d) * size)
                state, left = np.uint64((pa * seed + pc) % (1 << LCG_BITS)), size
                while left:
                    k = min(left, len(a))
                    states = (a[:k] * state + c[:k]) & mask
                    yield pd.DataFrame({"draw": int(d), "at": (states.astype(float) / 2**31 * size).astype(np.int64) % size})
                    state, left = states[-1], left - k

    return run


def lcg_draws(spark, draws: int, size: int, seed: int = 20_260_710) -> DataFrame:
    """draw, at: indices of a linear congruential generator, as a table to join with. A task jumps to its draws' first states."""
    schema = "draw long, at long"
    return spark.range(draws).mapInPandas(_lcg(size, seed), schema) if size else spark.createDataFrame([], schema)


def resampled_means(paired: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    """draw, m: the mean delta of each draw of n rows. The draws are draws * n rows, which Spark can't tell of a mapped range: unasked, it takes them
    for the small side and sends them all to the driver."""
    side = F.broadcast(paired) if n <= BROADCAST_ROWS else paired.hint("merge")
    return lcg_draws(paired.sparkSession, draws, n, seed).join(side, "at").groupBy("draw").agg(F.avg("delta").alias("m"))


def paired_bootstrap(paired: DataFrame, draws: int = 2000, seed: int = 20_260_710) -> DataFrame:
    """paired: at (0 to n - 1), delta. Mean delta, nearest-rank 95 % interval of resampled means, wins, ties, losses, sign test."""
    spark, n = paired.sparkSession, paired.count()
    means = resampled_means(paired, n, draws, seed)
    m = sorted(r["m"] for r in means.collect())  # one number a draw
    low, high = (m[int(q * (draws - 1))] for q in (0.025, 0.975)) if n else (None, None)
    row = paired.agg(F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses")).first()
    return spark.createDataFrame([(row["mean"], low, high, row["wins"], row["ties"], row["losses"], sign_test(row["wins"], row["losses"]))], "mean_delta double, low double, high double, wins long, ties long, losses long, p_value double")


def shift_wording(mean: Column, low: Column, high: Column) -> Column:
    """What a paired difference may be called: its interval must leave out zero (ends included) for its sign to count. Null where nothing was paired."""
    resolved = F.when(mean > 0, "observed_positive_shift").otherwise("observed_negative_shift")
    return F.when(mean.isNull() | low.isNull() | high.isNull(), None).when((low <= 0) & (high >= 0), "not_statistically_resolved").otherwise(resolved)


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided binomial test that wins and losses are equally likely."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def grouped_logistic(rows: DataFrame, keys: list[str], features: list[str], label: str, ridge: float = 1e-4, lower: list[float | None] | None = None, start: list[float] | None = None, passes: int = 400) -> DataFrame:
    """Ridge logistic regressions with lower bounds on weights, one for each value of keys: keys, b0 (intercept), b1, b2 ...

    Minimises mean loss + ridge / 2 * the sum of all squared coefficients, by projected Newton with step halving. Rows are folded to one
    per distinct features and label; each pass then is one aggregation of loss, gradient and Hessian by key for all fits at once, so only
    those sums reach the driver. Raises if a fit does not come to rest.
    """
    xs = [f"x{i}" for i in range(1, len(features) + 1)]
    folded = rows.select(*keys, *[F.col(c).cast("double").alias(x) for x, c in zip(xs, features, strict=True)], F.col(label).cast("double").alias("y"))
    folded = materialize(folded.groupBy(*keys, *xs, "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "fit-folded")
    schema = folded.select(*keys).schema
    k, low = len(features) + 1, np.array([-np.inf, *(-np.inf if b is None else b for b in (lower or [None] * len(features)))])
    at = [F.lit(1.0), *[F.col(x) for x in xs]]
    state = {tuple(r): {"try": np.array(start or [0.0] * k, float), "best": None, "loss": np.inf} for r in folded.select(*keys).distinct().collect()} if keys else {(): {"try": np.array(start or [0.0] * k, float), "best": None, "loss": np.inf}}
    for _ in range(passes):
        asked = [key for key, s in state.items() if not s.get("done")]
        if not asked:
            break
        names = [f"b{i}" for i in range(k)]
        if keys:
            fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + [f"{n} double" for n in names])
            table = F.broadcast(folded.sparkSession.createDataFrame([(*key, *map(float, state[key]["try"])) for key in asked], fields))  # a row a fit
            each = folded.join(table, [folded[c].eqNullSafe(table[c]) for c in keys]).select(*[folded[c] for c in keys], *xs, "y", "w", *names)
        else:
            each = folded.withColumns({n: F.lit(float(v)) for n, v in zip(names, state[()]["try"], strict=True)})
        each = each.withColumn("z", sum((F.col(n) * x for n, x in zip(names[1:], at[1:], strict=True)), F.col("b0")))
        # log(1 + exp(z)) - y z, and 1 / (1 + exp(-z)), without overflow on either side
        small = F.exp(-F.abs("z"))
        each = each.withColumns({"p": F.when(F.col("z") >= 0, 1 / (1 + small)).otherwise(small / (1 + small)), "l": F.greatest("z", F.lit(0.0)) + F.log1p(small) - F.col("y") * F.col("z")})
        sums = [F.sum("w"), F.sum(F.col("w") * F.col("l"))] + [F.sum(F.col("w") * (F.col("p") - F.col("y")) * x) for x in at] + [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * at[i] * at[j]) for i in range(k) for j in range(i, k)]
        for r in each.groupBy(*keys).agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).collect():
            key, got = tuple(r[: len(keys)]), np.array([v or 0.0 for v in r[len(keys) :]])
            if not got[0]:
                raise ValueError("no rows to fit")
            _newton(state[key], got[1:] / got[0], ridge, low, k)
    if not all(s.get("done") for s in state.values()):
        raise RuntimeError(f"a logistic fit has not come to rest after {passes} passes")
    fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + [f"b{i} double" for i in range(k)])
    return folded.sparkSession.createDataFrame([(*key, *map(float, s["best"])) for key, s in state.items()], fields)


def _newton(s: dict, means: np.ndarray, ridge: float, low: np.ndarray, k: int) -> None:
    """One fit's next point to try, from mean loss, gradient and Hessian at the last: half the step back if the loss rose."""
    new, loss = s["try"], means[0] + ridge / 2 * s["try"] @ s["try"]
    if loss > s["loss"] + 1e-14 * abs(s["loss"]):
        s["try"] = (s["best"] + new) / 2
        s["done"] = np.abs(s["try"] - s["best"]).max() < 1e-11
        return
    s["best"], s["loss"] = new, loss
    grad, hess = means[1 : k + 1] + ridge * new, np.zeros((k, k))
    hess[np.triu_indices(k)] = means[k + 1 :]
    hess = hess + np.triu(hess, 1).T + np.eye(k) * (ridge + 1e-12)
    free = ~((new <= low) & (grad > 0))
    step = np.zeros(k)
    while True:  # a weight that the step would push through its bound stays there, and the others are solved for again
        step[:] = 0
        if free.any():
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        through = free & (new - step < low) & (new <= low)
        if not through.any():
            break
        free &= ~through
    # As far along the step as the bounds allow: the loss falls on the way, so halving ends.
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(new - step < low, (new - low) / step, 1.0)
    share = min(1.0, float(room.min()))
    hit = (share < 1.0) & (room <= share)
    s["try"] = np.where(hit, low, np.maximum(new - share * step, low))  # exactly on the bound, so that the next step holds it
    s["done"] = not hit.any() and np.abs(s["try"] - new).max() < 1e-10 * (1 + np.abs(new).max())


def bounded_logistic(rows: DataFrame, features: list[str], label: str, ridge: float = 1e-4, lower: list[float | None] | None = None) -> list[float]:
    """The one fit of all rows: an intercept, then a weight a feature. See grouped_logistic."""
    return [float(b) for b in grouped_logistic(rows, [], features, label, ridge, lower).first()]


def affine_calibrators(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, offset, slope: p = sigmoid(offset + slope * z) fitted to z and label, the slope at least 1e-6."""
    fits = grouped_logistic(rows, keys, ["z"], "label", ridge=2e-6, lower=[1e-6], start=[0.0, 1.0])
    return fits.select(*keys, F.col("b0").alias("offset"), F.col("b1").alias("slope"))


def split_rank(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}\x1f"), key).cast("binary"), 256)


def _folds(folds: int, seed: int):
    import hashlib

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        draw = {r: hashlib.sha256(f"{seed}\x1f{key[0]}\x1f{r}".encode()).digest() for r in pdf["run_id"]}
        rows = sorted(pdf.itertuples(), key=lambda r: (-(r.pos + r.neg), draw[r.run_id], r.run_id))
        totals = np.array([max(1, pdf["pos"].sum()), max(1, pdf["neg"].sum()), len(pdf)], float)
        load, out = np.zeros((folds, 3)), []
        for r in rows:
            after = (load + [r.pos, r.neg, 1]) / totals
            best = min(range(folds), key=lambda f: (after[f].max(), after[f].sum(), f))
            load[best] += [r.pos, r.neg, 1]
            out.append((key[0], r.run_id, r.pos, r.neg, best))
        return pd.DataFrame(out, columns=["group_key", "run_id", "pos", "neg", "fold"])

    return run


def balanced_folds(rows: DataFrame, folds: int = 5, seed: int = 20_260_710) -> DataFrame:
    """rows: group_key, run_id, label. Runs go, largest first, to the fold that stays the least loaded in positives, negatives and runs."""
    counts = rows.groupBy("group_key", "run_id").agg(F.sum("label").alias("pos"), (F.count(F.lit(1)) - F.sum("label")).alias("neg"))
    return counts.groupBy("group_key").applyInPandas(_folds(folds, seed), "group_key string, run_id string, pos long, neg long, fold int")


# ---------------------------------------------------------------- bootstraps over runs
def _cluster_intervals(draws: int, seeds: dict[str, int]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[sorted(range(len(pdf)), key=pdf["run_id"].tolist().__getitem__)]
        sums, sizes = pdf["total"].to_numpy(float), pdf["n"].to_numpy(float)
        rng, means = np.random.default_rng(seeds[key[1]]), np.empty(draws)
        for i in range(draws):
            at = rng.integers(0, len(sums), size=len(sums))
            means[i] = sums[at].sum() / sizes[at].sum()
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([(*key, float(low), float(high))], columns=["group_key", "metric", "low", "high"])

    return run


def cluster_bootstrap(sums: DataFrame, seeds: dict[str, int], draws: int = 2000) -> DataFrame:
    """sums: group_key, metric, run_id, total, n. Per group and metric the percentile interval of the mean when whole runs are drawn again.

    A task holds one row a run. Draws of a group come from one generator in sequence, as its bounded integers can't be jumped ahead.
    """
    return sums.groupBy("group_key", "metric").applyInPandas(_cluster_intervals(draws, seeds), "group_key string, metric string, low double, high double")


def scalar_bootstrap(rows: DataFrame, seed: int = 20_260_710, draws: int = 2000) -> DataFrame:
    """rows: group_key, run_id, value. The interval of the mean of a value per run; runs without one are left out."""
    sums = rows.filter("value IS NOT NULL").select("group_key", F.lit("value").alias("metric"), "run_id", F.col("value").cast("double").alias("total"), F.lit(1).cast("long").alias("n"))
    return cluster_bootstrap(sums, {"value": seed}, draws).drop("metric")


def _states(seed: int, draws: int, size: int, block: int):
    """The generator's state before each block of draws. Bounded integers reject some numbers of the stream, so it can't be jumped ahead: one task
    runs it through, without keeping what it draws."""

    def run(batches):
        import pickle

        for batch in batches:
            for _ in batch["id"]:
                rng = np.random.default_rng(seed)
                for first in range(0, draws if size else 0, block):
                    yield pd.DataFrame({"first": [first], "state": [pickle.dumps(rng.bit_generator.state)]})
                    for _ in range(min(block, draws - first)):
                        rng.integers(0, size, size=size)

    return run


def _of_states(draws: int, size: int, block: int, counted: bool):
    def run(batches):
        import pickle

        for batch in batches:
            for first, state in zip(batch["first"], batch["state"], strict=True):
                rng = np.random.default_rng()
                rng.bit_generator.state = pickle.loads(state)
                for draw in range(int(first), min(int(first) + block, draws)):
                    at = rng.integers(0, size, size=size)
                    if counted:
                        times = np.bincount(at, minlength=size)
                        at = np.flatnonzero(times)
                        yield pd.DataFrame({"draw": draw, "at": at, "times": times[at]})
                    else:
                        yield pd.DataFrame({"draw": draw, "place": np.arange(size), "at": at})

    return run


def bootstrap_draws(spark, draws: int, size: int, seed: int, counted: bool = False, block: int = 25) -> DataFrame:
    """draw, place, at: which of size runs is drawn at a place, by one generator in sequence; counted: draw, at, times instead. Blocks of draws are made in
    tasks of their own from the generator's states."""
    states = materialize(spark.range(1).mapInPandas(_states(seed, draws, size, block), "first int, state binary"), "bootstrap-states")
    schema = "draw int, at long, times long" if counted else "draw int, place long, at long"
    return states.repartition(max(1, draws // block), "first").mapInPandas(_of_states(draws, size, block, counted), schema)


def _weighed(weights: DataFrame, of_run: DataFrame) -> DataFrame:
    """Draws joined with what their runs hold. The draws must not be broadcast (see resampled_means); where the runs' rows may be, whole draws stay in the
    task that made them, and only a row for each of a draw's distinct scores goes on."""
    return weights.join(F.broadcast(of_run) if of_run.count() <= BROADCAST_ROWS // 2 else of_run.hint("merge"), "at")


def weighted_bootstrap(rows: DataFrame, seed: int = 20_260_710, draws: int = 2000) -> DataFrame:
    """rows: run_id, score (0 to 1), label (0 or 1). field, n, low, high: intervals of the metrics of rows when whole runs are drawn again.

    No row is copied: a draw is how often it takes each run, which weighs the counts of the run's distinct scores. Fields: auroc (ties count half), brier,
    nll, and step_precision (precision at each distinct score, by its share of the positives, so ties need no order). n is the number of draws
    in which a field has a value; auroc and step_precision need both classes and a positive.
    """
    hist = rows.groupBy("run_id", "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    runs = numbered(rows.select("run_id").distinct(), [], F.substring("run_id", 1, 8), ["run_id"], "at")
    runs = materialize(runs.select("run_id", (F.col("at") - 1).alias("at")), "bootstrap-runs")
    weights = bootstrap_draws(rows.sparkSession, draws, runs.count(), seed, counted=True)
    of_run = materialize(hist.join(runs, "run_id").select("at", "score", "pos", (F.col("n") - F.col("pos")).alias("neg")), "bootstrap-scores")
    counts = _weighed(weights, of_run).groupBy("draw", "score").agg(F.sum(F.col("times") * F.col("pos")).alias("pos"), F.sum(F.col("times") * F.col("neg")).alias("neg"))
    falling = Window.partitionBy("draw").orderBy(F.desc("score"))
    upto = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"hits": F.sum("pos").over(upto), "taken": F.sum(F.col("pos") + F.col("neg")).over(upto)})
    above = F.col("hits") - F.col("pos")  # positives with a larger score
    s = F.col("score")
    p, q = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (above + F.col("pos") * 0.5))
    metrics = counts.groupBy("draw").agg(
        F.when((p > 0) & (q > 0), wins / (p * q)).alias("auroc"),
        (F.sum(F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s) / (p + q)).alias("brier"),
        (F.sum(F.col("pos") * clipped_nll(s, F.lit(1.0)) + F.col("neg") * clipped_nll(s, F.lit(0.0))) / (p + q)).alias("nll"),
        F.when(p > 0, F.sum(F.col("pos") * F.col("hits") / F.col("taken")) / p).alias("step_precision"),
    )
    long = metrics.unpivot(["draw"], ["auroc", "brier", "nll", "step_precision"], "field", "value")
    return percentiles(long, ["field"], "value", {"low": 0.025, "high": 0.975})


def row_bootstrap(rows: DataFrame, metric, fields: list[str], seed: int = 20_260_710, draws: int = 2000) -> DataFrame:
    """field, low, high: runs are drawn again, and metric(rows with draw and new run_id) is evaluated for each draw; it returns draw and fields.

    A run drawn twice is two runs, under boot-<place>:<run>. Draws without a value are left out of a field's interval.
    """
    runs = rows.select("run_id").distinct()
    runs = numbered(runs, [], F.substring("run_id", 1, 8), ["run_id"], "at").withColumn("at", F.col("at") - 1)
    size = runs.count()

    picks = bootstrap_draws(rows.sparkSession, draws, size, seed)
    drawn_runs = picks.join(runs, "at").select("draw", "place", "run_id")
    resampled = drawn_runs.join(rows, "run_id").withColumn("run_id", F.concat(F.lit("boot-"), F.col("place").cast("string"), F.lit(":"), F.col("run_id"))).drop("place")
    long = metric(resampled).unpivot(["draw"], fields, "field", "value").filter("value IS NOT NULL")
    return long.groupBy("field").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))


#: Fixed values of the gate.
GATE = {"positives": 50, "negatives": 50, "runs": 10, "folds": 5, "seed": 20_260_710, "brier": 0.01, "nll": 0.01}


def group_gate(rows: DataFrame, draws: int = 2000, gate: dict | None = None) -> DataFrame:
    """rows: group_key, run_id, z, label. Is a calibrator of its own worth it for a group? A row a group, with its calibrator if it is enabled.

    With enough of both classes and runs, a calibrator is fitted outside each fold of whole runs and compared with the global one on the
    fold. Enabled if both mean improvements (Brier, NLL) reach their least, both lower bootstrap bounds are above 0 and no fold is worse.
    """
    g = gate or GATE
    rows = materialize(rows.select("group_key", "run_id", F.col("z").cast("double").alias("z"), F.col("label").cast("int").alias("label")), "gate-rows")
    if not rows.filter("z IS NULL OR isnan(z) OR abs(z) = double('infinity') OR label IS NULL OR label NOT IN (0, 1)").isEmpty():
        raise ValueError("a row of the gate needs a finite z and a label of 0 or 1")
    counts = rows.groupBy("group_key").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"), F.countDistinct("run_id").alias("runs"))
    enough = (F.col("positives") >= g["positives"]) & (F.col("negatives") >= g["negatives"]) & (F.col("runs") >= g["runs"])
    candidates = rows.join(counts.filter(enough).select("group_key"), "group_key")
    folds = materialize(balanced_folds(candidates, g["folds"], g["seed"]), "gate-folds")
    if not folds.groupBy("group_key").agg(F.countDistinct("fold").alias("n")).filter(F.col("n") < g["folds"]).isEmpty():
        raise ValueError("a group's balanced folds leave one empty")
    held = candidates.join(folds.select("group_key", "run_id", "fold"), ["group_key", "run_id"])
    # A fit for each fold without its rows, and one (fold -1) of all rows, the final refit.
    fits = held.select("group_key", "z", "label", F.explode(F.array_append(F.filter(F.sequence(F.lit(0), F.lit(g["folds"] - 1)), lambda i: i != F.col("fold")), -1)).alias("fold"))
    own = affine_calibrators(fits, ["group_key", "fold"])
    everything = affine_calibrators(rows, []).select(F.col("offset").alias("g_offset"), F.col("slope").alias("g_slope")) if not candidates.isEmpty() else rows.sparkSession.createDataFrame([], "g_offset double, g_slope double")
    y = F.col("label")
    each = held.join(F.broadcast(own), ["group_key", "fold"]).crossJoin(F.broadcast(everything))  # a row a fit, one row
    each = each.withColumns({"p": sigmoid(F.col("offset") + F.col("slope") * F.col("z")), "q": sigmoid(F.col("g_offset") + F.col("g_slope") * F.col("z"))})
    each = each.withColumns({"brier": (F.col("q") - y) ** 2 - (F.col("p") - y) ** 2, "nll": clipped_nll(F.col("q"), y) - clipped_nll(F.col("p"), y)})
    by_run = materialize(each.groupBy("group_key", "fold", "run_id").agg(F.sum("brier").alias("brier"), F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("n")), "gate-runs")
    by_fold = by_run.groupBy("group_key", "fold").agg(*[(F.sum(m) / F.sum("n")).alias(f"fold_{m}") for m in ("brier", "nll")], *[F.sum(m).alias(m) for m in ("brier", "nll", "n")])
    means = by_fold.groupBy("group_key").agg(*[(F.sum(m) / F.sum("n")).alias(f"mean_{m}") for m in ("brier", "nll")], *[F.min(f"fold_{m}").alias(f"least_{m}") for m in ("brier", "nll")])
    bounds = cluster_bootstrap(by_run.unpivot(["group_key", "run_id", "n"], ["brier", "nll"], "metric", "total"), {"brier": g["seed"], "nll": g["seed"] + 1}, draws)
    bounds = bounds.groupBy("group_key").agg(*[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in ("brier", "nll") for side in ("low", "high")])
    found = means.join(bounds, "group_key").join(own.filter("fold = -1").drop("fold"), "group_key")
    better = [F.col(f"mean_{m}") >= g[m] for m in ("brier", "nll")] + [F.col(f"low_{m}") > 0 for m in ("brier", "nll")] + [F.col(f"least_{m}") >= 0 for m in ("brier", "nll")]
    passed = F.coalesce(better[0] & better[1] & better[2] & better[3] & better[4] & better[5], F.lit(False))
    out = counts.join(found, "group_key", "left").withColumn("passed", passed)
    reason = F.when(~enough, "minimum_cohort_not_met").when(F.col("passed"), "all_gate_predicates_pass").otherwise("improvement_gate_not_met")
    return out.select(
        "group_key", "positives", "negatives", "runs", *[f"{a}_{m}" for m in ("brier", "nll") for a in ("mean", "least", "low", "high")],
        F.when(F.col("passed"), "enabled").otherwise("fallback_supported_global").alias("decision"), reason.alias("reason"), *[F.when(F.col("passed"), F.col(c)).alias(c) for c in ("offset", "slope")],
    )
