"""Intermediate frames of the registered queries: the DataFrame side of wakeline.plans.ctes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import builders, detectors, evaluation, stats, support
from wakeline.operators.numbering import numbered
from wakeline.sources import adapters
from wakeline.sources.sinks import materialize, sized

EPISODE = ["run_id", "episode_no"]
ALIAS_BYTES = 60
#: Thresholds of the registered queries: bins of five minutes hold many users, so matches are looser than for linked episodes.
LOOSE = {"jaccard": 0.2, "iou": 0.02, "weight": 0.3}


class Frames:
    """Built once a query, lazily; nothing runs until the query's result is asked for."""

    dealt = False  # are episodes, their events and truth written in buckets by run

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    @property
    def norm(self) -> DataFrame:
        return adapters.norm_events(self.table("events"))

    @functools.cached_property
    def aliases(self) -> DataFrame:
        """Broadcast where they are few, so that events do not cross the network for each of their two names."""
        return sized(adapters.aliases(self.table("events")), "aliases", ALIAS_BYTES)

    @property
    def coverage(self) -> DataFrame:
        return adapters.coverage(self.norm)

    @property
    def truth(self) -> DataFrame:
        return adapters.truth_groups(self.norm)

    @functools.cached_property
    def members(self) -> DataFrame:
        return builders.fixed_bins(self.norm)

    @property
    def bounds(self) -> DataFrame:
        return builders.episode_bounds(self.members, EPISODE)

    @functools.cached_property
    def dedup(self) -> DataFrame:
        """Written once: the normaliser reads it as cohort, as values and for their counts."""
        return materialize(detectors.deduplicate(detectors.detector_values(self.members), EPISODE), "dedup")

    @property
    def ecdf(self) -> DataFrame:
        values = self.dedup
        return detectors.ecdf(values, values.filter(F.substring("run_id", -1, 1).isin("0", "2", "4", "6", "8")))

    @property
    def ranked_runs(self) -> DataFrame:
        """run_id, at: the runs in the order of a seeded hash as in split_assignment, from 0."""
        runs = self.norm.select("run_id").distinct().withColumn("h", stats.split_rank(F.col("run_id"), 7))
        return numbered(runs, [], F.substring("h", 1, 3), ["h", "run_id"], "at").select("run_id", (F.col("at") - 1).alias("at"))

    @property
    def train_runs(self) -> DataFrame:
        """Five runs of ten."""
        return self.ranked_runs.filter("at % 10 < 5").select("run_id")

    @property
    def calibration_runs(self) -> DataFrame:
        """Two more of ten; the other three are for tests."""
        return self.ranked_runs.filter("at % 10 BETWEEN 5 AND 6").select("run_id")

    @functools.cached_property
    def labels(self) -> DataFrame:
        """Each episode's label, written once for queries that ask for it more than once."""
        return materialize(self.labelled.select(*EPISODE, "label"), "labels", self.dealt)

    @property
    def negative_cohort(self) -> DataFrame:
        """The reference's cohort: the detector values of negative episodes of the training runs."""
        negative = self.labels.filter("label = 'negative'").join(self.train_runs, "run_id").select(*EPISODE)
        return self.dedup.join(negative, EPISODE, "left_semi")

    @property
    def features(self) -> DataFrame:
        return detectors.feature_vectors(self.ecdf, EPISODE)

    @property
    def at_end(self) -> DataFrame:
        return support.coverage_at(self.bounds, self.coverage, "end_us", EPISODE)

    @property
    def health(self) -> DataFrame:
        return support.family_health(self.at_end, EPISODE)

    @property
    def supported(self) -> DataFrame:
        sides = support.both_families(self.health, EPISODE)
        return support.decide_support(support.observed(self.features.join(sides, EPISODE)))

    @property
    def views(self) -> DataFrame:
        return evaluation.episode_views(self.members, EPISODE)

    @property
    def edges(self) -> DataFrame:
        return evaluation.match_edges(self.views, self.truth, **LOOSE)

    @property
    def labelled(self) -> DataFrame:
        return evaluation.episode_labels(self.views, self.edges)

    @property
    def scored(self) -> DataFrame:
        """Documents with a label: a score and a probability by length, grouped by source."""
        score = F.least(F.col("n_chars") / 5000, F.lit(1.0))
        return self.table("documents").join(self.table("labels"), "doc_id").select(F.col("source").alias("grp"), "doc_id", score.alias("score"), score.alias("p"), F.col("quality").alias("label"))
