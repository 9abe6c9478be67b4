"""Offline evaluation: episodes against ground truth, and ranking and calibration quality of scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.numbering import numbered

BENIGN = ["network.flow"]


def episode_views(members: DataFrame, scope: list[str]) -> DataFrame:
    """Per episode: bounds, entities (the users seen) and distinct action tokens."""
    return members.groupBy(*scope).agg(F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us"), F.array_sort(F.collect_set("endpoint_key")).alias("entities"), F.array_sort(F.collect_set("action")).alias("tokens"))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap by union of two intervals; two points count as 1 if equal, else 0."""
    union = F.greatest(a1, b1) - F.least(a0, b0)
    overlap = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return F.when(union > 0, overlap / union).otherwise(F.when(a0 == b0, 1.0).otherwise(0.0))


def match_edges(views: DataFrame, truth: DataFrame, jaccard: float = 0.5, iou: float = 0.1, weight: float = 0.5) -> DataFrame:
    """Qualified pairs of episode and truth group of a run, with `attack`: the group's tokens that the episode has.

    A pair needs a common entity for any Jaccard above 0, so pairs are formed on entities and no run is crossed with itself. Times come along, so that
    pairs apart in time are dropped where they meet.
    """
    o = temporal_iou(F.col("start_us"), F.col("end_us"), F.col("g0"), F.col("g1"))
    e = views.select("run_id", "episode_no", "start_us", "end_us", F.explode("entities").alias("entity"))
    t = truth.select("run_id", "group_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"), F.explode("entities").alias("entity"))
    meet = e.join(t, ["run_id", "entity"]).filter(o >= iou).groupBy("run_id", "episode_no", "group_id").agg(F.count(F.lit(1)).alias("common"))
    pairs = meet.join(views.select("run_id", "episode_no", "start_us", "end_us", "tokens", F.size("entities").alias("n_e")), ["run_id", "episode_no"])
    pairs = pairs.join(truth.select("run_id", "group_id", F.col("start_us").alias("g0"), F.col("end_us").alias("g1"), "required_tokens", F.size("entities").alias("n_g")), ["run_id", "group_id"])
    attack = F.array_intersect("tokens", "required_tokens")
    pairs = pairs.withColumns({"attack": attack, "jaccard": F.col("common") / (F.col("n_e") + F.col("n_g") - F.col("common")), "iou": o, "apart_us": F.abs(F.col("start_us") - F.col("g0"))}).filter(F.size("attack") > 0)
    pairs = pairs.withColumn("coverage", F.size("attack") / F.size("required_tokens"))
    pairs = pairs.withColumn("weight", 0.5 * F.col("coverage") + 0.3 * F.col("jaccard") + 0.2 * F.col("iou"))
    return pairs.filter((F.col("jaccard") >= jaccard) & (F.col("iou") >= iou) & (F.col("weight") >= weight)).select("run_id", "episode_no", "group_id", "coverage", "jaccard", "iou", "weight", "attack", "apart_us")


def best_edges(edges: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id", "episode_no").orderBy(F.desc("coverage"), F.desc("weight"), "group_id")
    return edges.withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def contamination() -> Column:
    """Benign tokens among an episode's benign tokens and those of its best group; null if it has none of either."""
    benign = F.array_intersect("tokens", F.array(*[F.lit(b) for b in BENIGN]))
    return F.try_divide(F.size(benign), F.nullif(F.size(F.array_union(benign, "attack")), F.lit(0)))


def episode_labels(views: DataFrame, edges: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """positive, mixed, ambiguous or negative, from the best edge's coverage and contamination. conflicts: runs whose truth contradicts itself."""
    both = views.join(best_edges(edges), ["run_id", "episode_no"], "left").withColumn("contamination", contamination())
    matched = F.col("group_id").isNotNull()
    benign = F.exists("tokens", lambda t: t.isin(*BENIGN))
    label = F.when(~matched, F.when(benign, "negative").otherwise("ambiguous")).when((F.col("coverage") < 0.5) | F.col("contamination").isNull(), "ambiguous").when(F.col("contamination") >= 0.25, "mixed").otherwise("positive")
    if conflicts is not None:
        both = both.join(conflicts.select("run_id", F.lit(True).alias("conflict")), "run_id", "left")
        sound = F.col("conflict").isNull()
        label, matched = F.when(sound, label).otherwise("ambiguous"), matched & sound
    return both.select("run_id", "episode_no", F.when(matched, F.col("group_id")).alias("group_id"), F.when(matched, F.col("coverage")).otherwise(0.0).alias("coverage"), F.when(matched, F.col("contamination")).alias("contamination"), label.alias("label"))


def hungarian(w: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of largest total; every row or every column is used, whichever are fewer."""
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            free = ~used[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


#: What a pair without an edge counts: as many edges as possible come first, then their weight.
NO_EDGE = -1e3


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """The assignment of one run, solved apart for each connected part of its edges."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for e, g in zip(pdf["episode_no"], pdf["group_id"], strict=True):
        up[root(("e", e))] = root(("g", g))
    chosen = []
    for _, part in pdf.groupby([str(root(("e", e))) for e in pdf["episode_no"]], sort=True):
        rows, cols = np.unique(part["episode_no"].astype(object), return_inverse=True), np.unique(part["group_id"].astype(object), return_inverse=True)
        w = np.full((len(rows[0]), len(cols[0])), NO_EDGE)
        tie = 1e-12 * (part["jaccard"].to_numpy(float) - part["apart_us"].to_numpy(float) / 1e15)
        w[rows[1], cols[1]] = part["weight"].to_numpy(float) + tie
        chosen += [(pdf["run_id"].iloc[0], rows[0][i], cols[0][j]) for i, j in hungarian(w) if w[i, j] > NO_EDGE]
    return pd.DataFrame(chosen, columns=["run_id", "episode_no", "group_id"])


def assignment(edges: DataFrame) -> DataFrame:
    """Each run's one-to-one matching: as many edges as possible, then of largest weight; equal weights by Jaccard, then nearer starts."""
    kind = edges.schema["episode_no"].dataType.simpleString()
    slim = edges.select("run_id", "episode_no", "group_id", "weight", "jaccard", "apart_us")
    chosen = slim.groupBy("run_id").applyInPandas(_assign, f"run_id string, episode_no {kind}, group_id string")
    return chosen.join(edges, ["run_id", "episode_no", "group_id"])


def formation_metrics(views: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: coverage, fragmentation, over-merging and mean contamination of matched episodes; null where nothing defines it."""
    per_group = truth.select("run_id", "group_id").join(edges.groupBy("run_id", "group_id").agg(F.max("coverage").alias("coverage"), F.count(F.lit(1)).alias("degree")), ["run_id", "group_id"], "left")
    groups = per_group.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_groups"), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), F.avg(F.greatest(F.coalesce("degree", F.lit(0)) - 1, F.lit(0)).cast("double")).alias("fragmentation"))
    degree = edges.groupBy("run_id", "episode_no").agg(F.count(F.lit(1)).alias("degree"))
    best = best_edges(edges).select("run_id", "episode_no", "attack")
    per_episode = views.join(degree, ["run_id", "episode_no"], "left").join(best, ["run_id", "episode_no"], "left").withColumn("contamination", contamination())
    episodes = per_episode.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_episodes"), F.avg((F.coalesce("degree", F.lit(0)) > 1).cast("double")).alias("over_merge"), F.avg("contamination").alias("contamination"))
    return episodes.join(groups, "run_id", "left").select("run_id", "n_episodes", F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"), "coverage", "fragmentation", "over_merge", "contamination")


def assignment_metrics(metrics: DataFrame, assigned: DataFrame) -> DataFrame:
    """Adds n_assigned, precision, recall and f1 to formation_metrics. f1 is 0 where both are 0, null where one is undefined."""
    n = assigned.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_assigned"))
    rows = metrics.join(n, "run_id", "left").withColumn("n_assigned", F.coalesce("n_assigned", F.lit(0)).cast("long"))
    rows = rows.withColumns({"precision": F.try_divide("n_assigned", "n_episodes"), "recall": F.try_divide("n_assigned", F.nullif("n_groups", F.lit(0)))})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), 0.0))


# ---------------------------------------------------------------- ranking and calibration
def by_score(rows: DataFrame, group: list[str]) -> DataFrame:
    """score (0 to 1), label (0 or 1) counted per group and distinct score: all that the metrics below need, and small."""
    return rows.groupBy(*group, "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))


def auroc(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rank-sum form, ties counting half; null unless a group has both classes."""
    c = by_score(rows, group)
    w = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("neg", F.col("n") - F.col("pos")).withColumn("below", F.sum("neg").over(w) - F.col("neg"))
    sums = c.groupBy(*group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)).alias("wins"))
    return sums.select(*group, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auroc"))


def ranked(rows: DataFrame, group: list[str], key: str, buckets: int = 4096) -> DataFrame:
    """Adds at (rank by falling score, then key) and hits (labels up to it)."""
    falling = F.floor(buckets / (1 + F.exp(F.col("score"))))  # falls with the score, whatever its range
    return numbered(rows, group, falling, [F.desc("score"), key], "at", {"hits": "label"})


def average_precision(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Mean precision at the rank of each positive; null without positives."""
    return ranked(rows, group, key).groupBy(*group).agg(F.avg(F.when(F.col("label") == 1, F.col("hits") / F.col("at"))).alias("average_precision"))


def rank_metrics(rows: DataFrame, group: list[str], key: str, share: float = 0.1, k: int = 10) -> DataFrame:
    """Recall within the best share of a group (one row at least) and precision within its k best."""
    r = ranked(rows, group, key).join(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total")), group)
    budget = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    sums = r.groupBy(*group, "n", "total").agg(F.sum(F.when(F.col("at") <= budget, F.col("label")).otherwise(0)).alias("in_budget"), F.sum(F.when(F.col("at") <= k, F.col("label")).otherwise(0)).alias("in_k"))
    return sums.select(*group, F.col("n").alias("n_rows"), (F.col("in_budget") / F.nullif(F.col("total"), F.lit(0))).alias("recall_at_budget"), (F.col("in_k") / F.least(F.col("n"), F.lit(k))).alias("precision_at_k"))


def clipped_nll(p: Column, y: Column, least: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def calibration_metrics(rows: DataFrame, group: list[str]) -> DataFrame:
    p, y = F.col("p"), F.col("label")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(clipped_nll(p, y)).alias("nll"))


def reliability_bins(rows: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """Bins with edges i / 10 as doubles, the last one closed."""
    at = F.lit(0)
    for i in range(1, bins):
        at = F.when(F.col("p") >= i / bins, i).otherwise(at)
    return rows.withColumn("bin", at).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("rate"))
