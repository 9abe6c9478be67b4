"""Frames over formed episodes: every revision with its events, features, support, sufficiency, label and outcome.

A revision is the unit up to the outcome, as each is assembled on its own; truth meets only the terminal revisions, and after the outcome.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators import detectors, evaluation, formation, replay_runs, support
from wakeline.plans.frames import ALIAS_BYTES, EPISODE, Frames
from wakeline.sources import adapters
from wakeline.sources.sinks import few, materialize, materialize_dealt, sized

#: Which runs' versions, calibrators and truth are not in order, by number of the run.
VERSIONS_DIFFER, NOT_CALIBRATED, GROUPED, CONFLICTING = (11, 7), (13, 4), (3, 1), (7, 5)
#: Slope and offset of the global calibrator and of the group's.
GLOBAL, GROUP = (1.2, -0.1), (0.8, 0.2)


#: What of an event its episodes are described by.
_EVENT = ["event_us", "source_family", "action", "dependency_group", "command_family", "protocol", "subject", "object", "eve_event_type", "severity", "endpoint_key", "endpoint_host", "parent_pid"]

#: What of it formation hands on beside its own columns.
_CARRIED = [c for c in _EVENT if c not in formation.EVENT_COLUMNS] + ["own_subject", "own_object"]


def marked(rule: tuple[int, int]) -> Column:
    return F.substring("run_id", 5, 9).cast("int") % rule[0] == rule[1]


def terminal(revisions: DataFrame) -> DataFrame:
    """First finalized revision of each episode that no merge has swallowed."""
    gone = revisions.select("run_id", "builder", F.explode("parent_episode_ids").alias("episode_id")).distinct()
    final = revisions.filter(F.col("state") == "finalized").join(gone, ["run_id", "builder", "episode_id"], "left_anti")
    first = final.groupBy("run_id", "builder", "episode_id").agg(F.min("seq").alias("seq"))
    return final.join(first, ["run_id", "builder", "episode_id", "seq"])


def episode_no() -> Column:
    return F.concat("episode_id", F.lit("#"), F.col("revision").cast("string"))


class FormedFrames(Frames):
    """As Frames, but `members` are the events of formed revisions; episode_no is the episode's id and revision.

    An episode only grows, so what its revisions hold follows from the revision since which each event belongs to it (`since`): a row for an event and
    episode, made by formation itself with the event's columns. Every revision with every event (`members`, `revisions`) is many times the input, and is
    made only for queries that return it.

    All is done run by run, so formation's output and what follows from it are written in buckets by run, and no event or revision crosses the network again.
    """

    dealt = True

    @functools.cached_property
    def aliased(self) -> DataFrame:
        """The input of formation, and what describes an event; `own_` the names before aliases."""
        return materialize(self._described(self.norm), "formed-events")

    def _described(self, norm: DataFrame) -> DataFrame:
        own = [F.col(c).alias(f"own_{c}") for c in ("subject", "object")]
        return formation.formation_input(norm.select("*", *own), self.aliases, _CARRIED)

    @functools.cached_property
    def revisions(self) -> DataFrame:
        """Every revision with its lists of events and reasons: only for queries that return these."""
        return materialize(formation.form_episodes(self.aliased), "revisions")

    @functools.cached_property
    def _rolls(self) -> DataFrame:
        carry = ["event_id", *[c for c in formation.EVENT_COLUMNS if c in _EVENT or c in ("ingest_us", "source_instance")], *_CARRIED]
        return materialize_dealt(formation.form_rolls(self._dealt, carry=carry), "formed-rolls", self._parts, "run_id")

    @functools.cached_property
    def _parts(self) -> int:
        """How many tasks runs are dealt to. Left alone, Spark joins partitions that are small in bytes until each core has one or two, which are long in
        time: the last one works alone, and each holds a share of the whole input."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.norm.count() // 20_000)

    def _by_run(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self._parts, "run_id")

    @property
    def _dealt(self) -> DataFrame:
        """The input of formation, dealt by run. Where aliases need no shuffle, events cross the network before they are described, at a third of the size."""
        return self._described(self._norm_by_run) if few(self.aliases, ALIAS_BYTES) else self._by_run(self._described(self.norm))

    @property
    def _norm_by_run(self) -> DataFrame:
        return adapters.norm_events(self._by_run(self.table("events").withColumn("run_id", adapters.run_id())))

    @property
    def marks(self) -> DataFrame:
        """Every revision, without its events."""
        return self._rolls.filter("revision IS NOT NULL").select("run_id", "episode_id", "revision", "seq", "state", "late_evidence_reason", "n_events", "event_us_start", "event_us_end", "watermark_us", "is_last")

    @property
    def members(self) -> DataFrame:
        """The events of every revision."""
        each = self.marks.select("run_id", "episode_id", "revision", episode_no().alias("episode_no"))
        return self.since.join(each, ["run_id", "episode_id"]).filter("since <= revision")

    @property
    def since(self) -> DataFrame:
        """The events of every episode, with the revision since which they belong to it, and the terminal revision of the episode or null."""
        names = [F.col(f"own_{c}").alias(c) for c in ("subject", "object")] + [F.col(c).alias(f"{c}_entity") for c in ("subject", "object")]
        return self._rolls.filter("since IS NOT NULL").select("run_id", "event_id", "episode_id", "since", "last", "ingest_us", "source_instance", *[c for c in _EVENT if c not in ("subject", "object")], *names)

    @property
    def last_members(self) -> DataFrame:
        """The events of terminal revisions."""
        return self.since.filter("since <= last").withColumn("episode_no", F.concat("episode_id", F.lit("#"), F.col("last").cast("string")))

    @property
    def bounds(self) -> DataFrame:
        return self.marks.select("run_id", episode_no().alias("episode_no"), F.col("event_us_start").alias("start_us"), F.col("event_us_end").alias("end_us"), "n_events")

    @functools.cached_property
    def truth(self) -> DataFrame:
        rows = self._dealt.filter("source_family = 'EDR'").select("run_id", "event_us", "endpoint_key", "action", "command_family", "subject", "object")
        bucket = F.floor(F.col("event_us") / (adapters.TRUTH_S * adapters.SECOND))
        groups = rows.groupBy("run_id", "endpoint_key", bucket.alias("bucket")).agg(
            F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us"), F.count(F.lit(1)).alias("n"), _flat_set(F.array("subject", "object")).alias("entities"),
            _flat_set(F.array("action", F.concat(F.lit("command_family:"), "command_family"))).alias("required_tokens"),
        ).filter("n >= 2")
        groups = groups.select("run_id", F.concat("endpoint_key", F.lit("@"), F.col("bucket").cast("string")).alias("group_id"), "start_us", "end_us", "entities", "required_tokens")
        return materialize_dealt(groups, "formed-truth", self._parts, "run_id")

    @functools.cached_property
    def views(self) -> DataFrame:
        tokens = F.array_compact(F.array("action", F.concat(F.lit("command_family:"), "command_family")))
        views = self.last_members.groupBy(*EPISODE).agg(F.min("event_us").alias("start_us"), F.max("event_us").alias("end_us"), _flat_set(F.array("subject_entity", "object_entity")).alias("entities"), _flat_set(tokens).alias("tokens"))
        return materialize_dealt(views, "formed-views", self._parts, "run_id")

    @functools.cached_property
    def edges(self) -> DataFrame:
        return materialize(evaluation.match_edges(self.views, self.truth), "formed-edges", self.dealt)

    @property
    def conflicts(self) -> DataFrame:
        return self.norm.select("run_id").distinct().filter(marked(CONFLICTING))

    @property
    def labelled(self) -> DataFrame:
        return evaluation.episode_labels(self.views, self._by_run(self.edges), self.conflicts)

    @property
    def negative_cohort(self) -> DataFrame:
        """As detectors.deduplicate gives them, without the event that a value comes from."""
        negative = self._by_run(self.labels.filter("label = 'negative'").join(self.train_runs, "run_id").select(*EPISODE))
        values = detectors.detector_values(self.last_members.join(negative, EPISODE, "left_semi"))
        return values.groupBy(*EPISODE, "source_family", "detector_id", "dependency_group").agg(F.max("value").alias("value"))

    @functools.cached_property
    def _moments(self) -> DataFrame:
        """Every revision with its features (against the negative episodes of the training runs; a detector that none of them has a value of gives nothing),
        its support and what contradicts in it."""
        key = ["run_id", "episode_id"]
        # All sides lie in buckets by run, which are cut by their events: an event makes a revision or two, so what a task puts together stays small.
        table = sized(detectors.ecdf_table(detectors.detector_values(self.since), self.negative_cohort, uncovered="null").filter("normalized IS NOT NULL"), "formed-shares", dealt=True)
        steps = detectors.detector_values(self.since.select(*key, "since", *detectors.READS)).select(*key, "source_family", "detector_id", "dependency_group", "value", "since").join(table, ["detector_id", "value"]).drop("value")
        own = self.marks.select(*key, "revision", "state", "late_evidence_reason", "watermark_us", F.floor(F.col("event_us_end") / (adapters.COVERAGE_S * adapters.SECOND)).alias("slot"))
        facts = support.contradiction_since(self.since.select(*key, "since", "source_family", "dependency_group", "endpoint_key", "endpoint_host", "parent_pid"), key)
        own = own.join(facts, key).withColumn("contradiction", support.contradiction_at("revision")).filter("contradiction IS NOT NULL").drop("fact_since", "gap_since", "clash_since")
        rows = detectors.growing_vectors(own, steps, key, "revision", ["state", "late_evidence_reason", "watermark_us", "slot", "contradiction"])
        return materialize(self._decided(rows), "formed-support", self.dealt).withColumn("episode_no", episode_no())

    @property
    def _slots(self) -> DataFrame:
        """run_id, slot: the intervals in which revisions end."""
        return self.marks.select("run_id", F.floor(F.col("event_us_end") / (adapters.COVERAGE_S * adapters.SECOND)).alias("slot")).distinct()

    @functools.cached_property
    def _sides(self) -> DataFrame:
        """Both families' health by run and interval: what covers an episode's end depends on the interval that it lies in."""
        width = adapters.COVERAGE_S * adapters.SECOND
        at = support.coverage_at(self._slots.withColumn("at_us", F.col("slot") * width), self.coverage, "at_us", ["run_id", "slot"])
        return sized(support.both_families(support.family_health(at, ["run_id", "slot"]), ["run_id", "slot"]), "formed-sides", dealt=True, otherwise=self._by_run)

    def _decided(self, rows: DataFrame) -> DataFrame:
        """Adds the health of both families in a row's interval, and reason and kappa."""
        rows = support.observed(rows.join(self._sides, ["run_id", "slot"])).drop("slot")
        return support.decide_support(rows, ~marked(VERSIONS_DIFFER), ~marked(NOT_CALIBRATED), F.when(marked(GROUPED), F.lit("group")))

    @property
    def features(self) -> DataFrame:
        """Also for revisions without any eligible value: d and c are 0."""
        return self._moments.select(*EPISODE, "d", "c", "eligible_count", "edr_detected", "ndr_detected")

    @property
    def supported(self) -> DataFrame:
        return self._moments.drop("episode_id", "revision", "state", "late_evidence_reason", "watermark_us", "contradiction")

    @property
    def outcomes(self) -> DataFrame:
        """A row for each revision, with its watermark: an audit, or a failure where a source's record is missing; logit, probability, and the five axes."""
        return _assessed(self._moments)


def _probability(z: Column) -> Column:
    p = lambda c: detectors.sigmoid(c[0] * z + c[1])
    return F.when(F.col("kappa") == "supported_group", p(GROUP)).when(F.col("kappa") == "supported_global", p(GLOBAL))


def _assessed(rows: DataFrame) -> DataFrame:
    """Adds logit, probability, whether there is an audit, and the axes to rows that are decided."""
    missing = F.col("e_missing") | F.col("n_missing")
    return rows.withColumn("z", detectors.logit(F.col("d"), F.col("c"))).withColumns({
        "p": _probability(F.col("z")), "audit": ~missing, "coverage": support.sufficiency_coverage(),
        "provenance": F.when(missing, "missing").otherwise("complete"), "lateness": support.lateness(),
    })


def _flat_set(values: Column) -> Column:
    """Distinct values of the arrays of a group, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(values))))


class ChildFrames(FormedFrames):
    """All cells of a replay design at once, beside the runs themselves. Sources' records and truth stay those of the run.

    A run and its children are formed in one task (replay_runs.profiles), which counts the revisions that say the same; so no child's events or revisions
    are written or shuffled, and whatever follows works on those counts and on terminal episodes. All lies in buckets by run.
    """

    def __init__(self, spark, sf_dir: str, cells: list[tuple]):
        super().__init__(spark, sf_dir)
        self.cells = cells

    @functools.cached_property
    def _dealt(self) -> DataFrame:
        """The events of the runs, with what detectors give for each: the same for a run and its children."""
        named = super()._dealt.withColumnsRenamed({c: f"{c}_entity" for c in ("subject", "object")} | {f"own_{c}": c for c in ("subject", "object")})
        rows = named.withColumn("given", detectors.event_values()).drop("subject", "object").withColumnsRenamed({f"{c}_entity": c for c in ("subject", "object")})
        return materialize_dealt(rows.select("run_id", *formation.EVENT_COLUMNS, *replay_runs.DESCRIBED, "given"), "replay-events", self._parts, "run_id")

    @property
    def _values(self) -> DataFrame:
        return self._dealt.select("run_id", "event_id", F.inline("given"))

    @functools.cached_property
    def negative_cohort(self) -> DataFrame:
        """What the models were made from is not replayed: the negatives of the runs themselves."""
        rows = replay_runs.profiles(self._dealt, self._values.withColumnRenamed("value", "share"), self._verdicts, [replay_runs.CONTROL], self._parts, best=True)
        views = materialize_dealt(rows.filter("episode_no IS NOT NULL"), "replay-controls", self._parts, "run_id")
        edges = materialize(evaluation.match_edges(views, self.truth), "replay-edges", True)
        labels = evaluation.episode_labels(views, self._by_run(edges), self.conflicts)
        negative = self._by_run(labels.filter("label = 'negative'").join(self.train_runs, "run_id").select(*EPISODE))
        values = views.join(negative, EPISODE, "left_semi").select(F.inline(F.arrays_zip(F.col("detectors").alias("detector_id"), F.col("shares").alias("value"))))
        return materialize(values, "replay-cohort", True)

    @functools.cached_property
    def profiles(self) -> DataFrame:
        """See replay_runs.PROFILE."""
        table = sized(detectors.ecdf_table(self._values, self.negative_cohort, uncovered="null").filter("normalized IS NOT NULL"), "replay-shares", dealt=True)
        shares = self._values.join(table, ["detector_id", "value"]).select("run_id", "event_id", "detector_id", F.col("normalized").alias("share"))
        return materialize_dealt(replay_runs.profiles(self._dealt, shares, self._verdicts, self.cells, self._parts), "replay-profiles", self._parts, "run_id")

    @property
    def views(self) -> DataFrame:
        return self.profiles.filter("episode_no IS NOT NULL").select(*EPISODE, "child", "start_us", "end_us", "entities", "tokens")

    @property
    def _slots(self) -> DataFrame:
        """All in which a child's revision may end: a clock that is off moves an event by less than an interval."""
        slot = F.floor(F.col("event_us") / (adapters.COVERAGE_S * adapters.SECOND))
        return self._dealt.groupBy("run_id").agg(F.min(slot).alias("a"), F.max(slot).alias("b")).select("run_id", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("slot"))

    @functools.cached_property
    def _verdicts(self) -> DataFrame:
        """What the rules make of a revision, by the interval in which it ends and by what was eligible and detected: all else that they ask is the run's."""
        cases = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("eligible_count", "edr_detected", "ndr_detected"), case, strict=True)], F.lit(case[0] << 2 | case[1] << 1 | case[2]).alias("detected")) for case in replay_runs.DETECTED])
        other = {"d": F.lit(0.0), "c": F.lit(0.0), "state": F.lit("open"), "late_evidence_reason": F.lit(None).cast("string")}
        rows = _assessed(self._decided(self._slots.select("run_id", "slot", F.col("slot").alias("at"), F.inline(cases)).withColumns(other)))
        return materialize_dealt(self._by_run(rows.select("run_id", F.col("at").alias("slot"), "detected", "audit", "coverage", "provenance", "kappa")), "replay-verdicts", self._parts, "run_id")


def replay_statistics(f: ChildFrames) -> DataFrame:
    """Per run and child: formation against truth, mean logit, calibration of supported binary episodes, revisions, seconds until episodes close, and on how many
    revisions that the control has too each axis of the profile differs."""
    key = ["run_id", "child"]
    mean_z = detectors.logit(F.col("d"), F.col("c")).alias("mean_z")  # linear in d and c
    counts = f.profiles.filter("episode_no IS NULL").select(*key, "revision_count", "stabilization_s", mean_z, *[f"u_{a}" for a in replay_runs.AXES])
    found = f.edges.join(f.views.select(*EPISODE, "child"), EPISODE).groupBy(*key, "group_id").agg(F.max("coverage").alias("coverage"), (F.count(F.lit(1)) - 1).alias("more"))
    found = found.groupBy(*key).agg(F.sum("coverage").alias("coverage"), F.sum("more").alias("more"))
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("n_groups")
    groups = f.truth.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_groups"))
    metrics = counts.select(*key).join(groups, "run_id").join(found, key, "left").select(*key, share("coverage").alias("action_coverage"), share("more").alias("fragmentation"))
    z = detectors.logit(F.col("d"), F.col("c"))
    ends = f.profiles.filter("episode_no IS NOT NULL AND audit IS NOT NULL").select(*EPISODE, "child", "audit", _probability(z).alias("p")).join(f.labelled.select(*EPISODE, "label"), EPISODE)
    scored = F.col("audit") & F.col("p").isNotNull()
    binary, y = scored & F.col("label").isin("positive", "negative"), (F.col("label") == "positive").cast("int")
    calibration = ends.groupBy(*key).agg(F.avg(F.when(binary, (F.col("p") - y) ** 2)).alias("brier"), F.avg(F.when(binary, evaluation.clipped_nll(F.col("p"), y))).alias("nll"), (F.count_if(scored) / F.count(F.lit(1))).alias("supported_coverage"))
    return counts.join(metrics, key, "left").join(calibration, key, "left")
