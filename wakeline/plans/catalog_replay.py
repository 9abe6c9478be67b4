"""More registered queries: perturbations, outages, paired statistics, fits, splits and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import hashing
from wakeline.operators import detectors, formation, replay, replay_runs, stats, support
from wakeline.operators.numbering import numbered
from wakeline.plans.catalog import QUERIES, query, r9
from wakeline.plans.catalog_formed import artifacts, rounded
from wakeline.plans.ctes import HEX_XOR, formed_sql, sql
from wakeline.plans.frames import EPISODE, Frames
from wakeline.sources import sinks


def draw_sql(intervention: str, family: str, level, key: str, run: str = "run_id") -> str:
    """replay.drawn as SQL."""
    pad = bytes.fromhex(replay.SEED).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in pad).hex() for p in (0x36, 0x5C))
    seed = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({run} || chr(31) || '{intervention}' || chr(31) || '{family}' || chr(31) || '{level}'))))"
    h = f"sha256({HEX_XOR.format(seed, 0x5C)} || unhex(sha256({HEX_XOR.format(seed, 0x36)} || encode('{intervention}' || chr(31) || {key}))))"
    return f"(('0x' || substr({h}, 1, 8))::BIGINT::DOUBLE / 4294967296 + ('0x' || substr({h}, 9, 8))::BIGINT::DOUBLE / 18446744073709551616::DOUBLE)"


KEYS = ["run_id", "event_id", "event_us", "ingest_us", "source_family"]


@query(sql("SELECT run_id, event_id, event_us, ingest_us, source_family FROM norm WHERE source_family <> 'EDR'", "norm"))
def replay_mask(f: Frames) -> DataFrame:
    return replay.mask(f.norm, "EDR").select(KEYS)


@query(sql(f"SELECT run_id, event_id, event_us, ingest_us, source_family FROM norm WHERE source_family <> 'NDR' OR {draw_sql('drop', 'NDR', 0.25, 'event_id')} >= 0.25::DOUBLE", "norm"))
def replay_drop(f: Frames) -> DataFrame:
    return replay.drop(f.norm, "NDR", 0.25).select(KEYS)


@query(sql(f"""SELECT n.run_id, event_id, event_us, ingest_us, source_family FROM norm n LEFT JOIN (
    SELECT run_id, event_us AS s FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_us) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS m FROM (
        SELECT DISTINCT run_id, event_us FROM norm JOIN (SELECT run_id, max(event_us) AS e FROM norm GROUP BY run_id) USING (run_id) WHERE source_family = 'NDR' AND event_us + 300000000 <= e))
    WHERE pos = floor({draw_sql('burst', 'NDR', 300, 'run_id')} * m)) b ON b.run_id = n.run_id WHERE NOT coalesce(source_family = 'NDR' AND event_us >= s AND event_us < s + 300000000, false)""", "norm"))  # fmt: skip
def replay_burst(f: Frames) -> DataFrame:
    return replay.burst(f.norm, "NDR", 300).select(KEYS)


@query(sql("SELECT run_id, event_id, event_us, CASE WHEN source_family = 'EDR' THEN ingest_us + 120000000 ELSE ingest_us END AS ingest_us, source_family FROM norm", "norm"))
def replay_delay(f: Frames) -> DataFrame:
    return replay.delay(f.norm, "EDR", 120).select(KEYS)


@query(sql("SELECT run_id, event_id, CASE WHEN source_family = 'EDR' THEN event_us - 30000000 ELSE event_us END AS event_us, ingest_us, source_family FROM norm", "norm"))
def replay_skew(f: Frames) -> DataFrame:
    return replay.skew(f.norm, "EDR", -30).select(KEYS)


@query(sql(f"""SELECT event_id, arrival_seq FROM placed WHERE source_family <> 'NDR' UNION ALL
    SELECT d.event_id, s.arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, buffer ORDER BY {draw_sql('reorder', 'NDR', 600, 'event_id')}, event_id) AS pos FROM moving) d
    JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, buffer ORDER BY arrival_seq) AS pos FROM moving) s ON d.run_id = s.run_id AND d.buffer = s.buffer AND d.pos = s.pos""", "norm").replace("\nSELECT event_id, arrival_seq FROM placed", """,
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ingest_us, event_us, source_instance, event_id) - 1 AS arrival_seq, min(ingest_us) OVER (PARTITION BY run_id) AS i0 FROM norm),
moving AS (SELECT *, (ingest_us - i0) // 600000000 AS buffer FROM placed WHERE source_family = 'NDR')
SELECT event_id, arrival_seq FROM placed"""))  # fmt: skip
def replay_reorder(f: Frames) -> DataFrame:
    return replay.reorder(f.norm, "NDR", 600).select("event_id", "arrival_seq")


@query(sql(f"""SELECT run_id, event_id, event_us, ingest_us, source_family FROM norm UNION ALL
    SELECT run_id, 'dup:' || sha256(event_id), event_us, ingest_us + 1, source_family FROM norm WHERE source_family = 'NDR' AND {draw_sql('duplicate', 'NDR', 0.25, 'dependency_group')} < 0.25::DOUBLE""", "norm"))  # fmt: skip
def replay_duplicate(f: Frames) -> DataFrame:
    return replay.duplicate(f.norm, "NDR", 0.25).select(KEYS)


_DESIGN_SQL = ", ".join(["('control', 'none', 'none')"] + [f"('{n}', '{s}', '{level}')" for n, levels in replay.DESIGN.items() for s in ("EDR", "NDR") for level in levels])


@query(sql(f"""SELECT run_id, i AS intervention, s AS source_family, l AS level, n_source, sha256(run_id || chr(31) || i || chr(31) || s || chr(31) || l) AS child_id FROM (
    SELECT run_id, i, s, l, count_if(source_family = s)::BIGINT AS n_source FROM norm, (VALUES {_DESIGN_SQL}) AS d(i, s, l) GROUP BY ALL)""", "norm"))  # fmt: skip
def replay_children(f: Frames) -> DataFrame:
    """Every run in every cell of the design: the children to replay, and how many events the intervention can touch."""
    counts = f.norm.groupBy("run_id").agg(F.count_if(F.col("source_family") == "EDR").alias("EDR"), F.count_if(F.col("source_family") == "NDR").alias("NDR"))
    cells = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("intervention", "source_family", "level"), r, strict=True)]) for r in [("control", "none", "none")] + [(n, s, str(v)) for n, levels in replay.DESIGN.items() for s in ("EDR", "NDR") for v in levels]])
    rows = counts.select("*", F.inline(cells))
    touched = F.when(F.col("source_family") == "EDR", F.col("EDR")).when(F.col("source_family") == "NDR", F.col("NDR")).otherwise(F.lit(0))
    return rows.select("run_id", "intervention", "source_family", "level", touched.cast("long").alias("n_source"), hashing.sha256_text(F.concat_ws("\x1f", "run_id", "intervention", "source_family", "level")).alias("child_id"))


@query(sql("""SELECT c.run_id, c.source_family, stop_us, stop_us + 600000000 AS ready_us, count(e.event_id) AS n_in_outage, round(count(e.event_id) / c.n, 9) AS fraction FROM (
    SELECT run_id, source_family, min(event_us) + (max(event_us) - min(event_us)) // 2 AS stop_us, count(*) AS n FROM norm GROUP BY ALL) c
    LEFT JOIN norm e ON e.run_id = c.run_id AND e.source_family = c.source_family AND e.event_us BETWEEN stop_us AND stop_us + 600000000 GROUP BY c.run_id, c.source_family, stop_us, c.n""", "norm"))  # fmt: skip
def outage_rows(f: Frames) -> DataFrame:
    """A source stops half way through a run and is ready 600 s later: what falls into the closed window, as a share of its events."""
    spans = f.norm.groupBy("run_id", "source_family").agg(F.min("event_us").alias("a"), F.max("event_us").alias("b"), F.count(F.lit(1)).alias("n"))
    spans = spans.select("run_id", "source_family", (F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)).alias("stop_us"), "n").withColumn("ready_us", F.col("stop_us") + 600_000_000)
    hit = f.norm.join(spans, ["run_id", "source_family"]).groupBy("run_id", "source_family", "stop_us", "ready_us", "n").agg(F.count_if(F.col("event_us").between(F.col("stop_us"), F.col("ready_us"))).alias("n_in_outage"))
    return hit.select("run_id", "source_family", "stop_us", "ready_us", "n_in_outage", r9(F.col("n_in_outage") / F.col("n")).alias("fraction"))


# ---------------------------------------------------------------- paired comparisons
_PER_RUN = """SELECT run_id, avg(d) AS base, avg(d) FILTER (c = 1) AS other FROM feat GROUP BY run_id"""


def _paired(f: Frames) -> DataFrame:
    """Per run: the mean feature of all episodes, and of those that both sources saw."""
    return f.features.groupBy("run_id").agg(F.avg("d").alias("base"), F.avg(F.when(F.col("c") == 1, F.col("d"))).alias("other"))


@query(sql(f"SELECT run_id, round(base, 9) AS base, round(other, 9) AS other, round(other - base, 9) AS delta FROM ({_PER_RUN})", "feat"))
def paired_deltas(f: Frames) -> DataFrame:
    return _paired(f).select("run_id", r9("base").alias("base"), r9("other").alias("other"), r9(F.col("other") - F.col("base")).alias("delta"))


def _numbered_deltas(f: Frames) -> DataFrame:
    rows = paired_deltas(f).filter("delta IS NOT NULL").select("run_id", "delta")
    return sinks.materialize(numbered(rows, [], F.substring("run_id", 1, 10), ["run_id"], "at").withColumn("at", F.col("at") - 1), "deltas")  # a row for each run


@query()
def paired_bootstrap(f: Frames) -> DataFrame:
    rows = stats.paired_bootstrap(_numbered_deltas(f))
    return rows.withColumn("interpretation", stats.shift_wording(F.col("mean_delta"), F.col("low"), F.col("high")))


@query()
def sign_test(f: Frames) -> DataFrame:
    row = paired_deltas(f).agg(F.count_if(F.col("delta") > 0), F.count_if(F.col("delta") < 0)).first()
    return f.spark.createDataFrame([(row[0], row[1], stats.sign_test(row[0], row[1]))], "wins long, losses long, p_value double")


@query(sql("""SELECT detector_id, count(value) AS defined, count(*) - count(value) AS undefined, round(avg(value), 9) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 9) AS sd, min(value) AS least, max(value) AS most FROM dedup GROUP BY detector_id""", "dedup"))
def summary_stats(f: Frames) -> DataFrame:
    return stats.summary(f.dedup, ["detector_id"], "value").withColumns({c: r9(c) for c in ("mean", "sd")})


@query(sql("""SELECT coalesce(source_family, 'all') AS source_family, coalesce(detector_id, 'all') AS detector_id, count(*) AS n, round(avg(value), 9) AS mean FROM dedup GROUP BY ROLLUP (source_family, detector_id)""", "dedup"))
def cell_rollup(f: Frames) -> DataFrame:
    rows = f.dedup.rollup("source_family", "detector_id").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("value")).alias("mean"))
    return rows.select(F.coalesce("source_family", F.lit("all")).alias("source_family"), F.coalesce("detector_id", F.lit("all")).alias("detector_id"), "n", "mean")


_STAGES = ["k % 31 <> 0", "k % 29 <> 0", "k % 23 <> 0", "protocol IS NOT NULL OR command_family IS NOT NULL", "k % 19 <> 0", "k % 17 <> 0"]


@query(sql("SELECT loss_class, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN NOT ({c}) THEN '{x}'" for x, c in zip("ABCDEF", _STAGES, strict=True)) + " ELSE 'G' END AS loss_class FROM norm) GROUP BY loss_class", "norm"))
def loss_taxonomy(f: Frames) -> DataFrame:
    """The first stage at which an event is lost: receipt, raw, normalise, tokens, membership, attribution; G if none."""
    kind = F.lit("G")
    for name, stage in reversed(list(zip("ABCDEF", _STAGES, strict=True))):
        kind = F.when(~F.expr(stage), name).otherwise(kind)
    return f.norm.select(kind.alias("loss_class")).groupBy("loss_class").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT unnest(['received', 'raw', 'normalized', 'tokens', 'member', 'attributed']) AS stage, unnest([" + ", ".join("count_if(" + " AND ".join(f"({c})" for c in _STAGES[: i + 1]) + ")" for i in range(6)) + "]::BIGINT[]) AS n FROM norm", "norm"))
def waterfall(f: Frames) -> DataFrame:
    names = ["received", "raw", "normalized", "tokens", "member", "attributed"]
    counts = [F.count_if(F.expr(" AND ".join(f"({c})" for c in _STAGES[: i + 1]))).alias(n) for i, n in enumerate(names)]
    return f.norm.agg(*counts).unpivot([], names, "stage", "n")


# ---------------------------------------------------------------- splits, folds, fits
@query(sql("""SELECT grp, doc_id, CASE WHEN pos % 10 < 5 THEN 'train' WHEN pos % 10 < 7 THEN 'dev' WHEN pos % 10 < 8 THEN 'calibration' ELSE 'locked_test' END AS part FROM (
    SELECT grp, doc_id, row_number() OVER (PARTITION BY grp ORDER BY sha256('7' || chr(31) || doc_id), doc_id) - 1 AS pos FROM scored)""", "scored"))  # fmt: skip
def split_assignment(f: Frames) -> DataFrame:
    """In each stratum, by the order of a seeded hash, cycles of ten: five, two, one, two."""
    w = Window.partitionBy("grp").orderBy(stats.split_rank(F.col("doc_id").cast("string"), 7), "doc_id")
    at = (F.row_number().over(w) - 1) % 10
    return f.scored.select("grp", "doc_id", F.when(at < 5, "train").when(at < 7, "dev").when(at < 8, "calibration").otherwise("locked_test").alias("part"))


@query(sql("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN label = 'ambiguous' THEN 'ambiguous' WHEN label = 'mixed' THEN 'mixed' WHEN eligible_count = 0 THEN 'no_detector' WHEN reason <> 'eligible' THEN reason ELSE 'included' END AS reason FROM support JOIN labelled USING (run_id, episode_no)) GROUP BY reason""", "support", "labelled"))
def cohort_exclusions(f: Frames) -> DataFrame:
    rows = f.supported.join(f.labelled.select(*EPISODE, "label"), EPISODE)
    why = F.when(F.col("label") == "ambiguous", "ambiguous").when(F.col("label") == "mixed", "mixed").when(F.col("eligible_count") == 0, "no_detector").when(F.col("reason") != "eligible", F.col("reason")).otherwise("included")
    return rows.select(why.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT a.source_family, a.health AS at_start, b.health AS at_end, count(*) AS n FROM (
    SELECT b.run_id, b.episode_no, f AS source_family, i AS source_instance, coalesce(c.health, 'none') AS health FROM bounds b CROSS JOIN (VALUES ('EDR', 'edr-target-01'), ('EDR', 'edr-target-02'), ('NDR', 'ndr-gateway-01')) AS s(f, i)
    LEFT JOIN cov c ON c.run_id = b.run_id AND c.source_family = f AND c.source_instance = i AND c.start_us <= b.start_us AND b.start_us < c.end_us) a
    JOIN (SELECT *, coalesce(health, 'none') AS h FROM at_end) e USING (run_id, episode_no, source_family, source_instance), LATERAL (SELECT e.h AS health) b GROUP BY ALL""", "bounds", "cov", "at_end"))  # fmt: skip
def u_transitions(f: Frames) -> DataFrame:
    """How a source's health differs between the start and the end of an episode."""
    key = [*EPISODE, "source_family", "source_instance"]
    ends = [support.coverage_at(f.bounds, f.coverage, c, EPISODE).select(*key, F.coalesce("health", F.lit("none")).alias(n)) for c, n in (("start_us", "at_start"), ("end_us", "at_end"))]
    return ends[0].join(ends[1], key).groupBy("source_family", "at_start", "at_end").agg(F.count(F.lit(1)).alias("n"))


@query()
def ecdf_train_negatives(f: Frames) -> DataFrame:
    """Detector values against the negative episodes of the training runs; null where no such episode has a value of the detector."""
    return detectors.ecdf(f.dedup, f.negative_cohort, uncovered="null").select(*EPISODE, "detector_id", "dependency_group", r9("normalized").alias("normalized"))


@query()
def group_folds(f: Frames) -> DataFrame:
    rows = f.scored.select(F.lit("all").alias("group_key"), F.col("grp").alias("run_id"), "label")
    return stats.balanced_folds(rows)


@query()
def fit_scorer(f: Frames) -> DataFrame:
    """The models of episodes in bins, on eligible positive and negative ones of the training runs."""
    return rounded(artifacts(f, calibrate=False))


@query()
def fit_calibrator(f: Frames) -> DataFrame:
    """The calibrator of the same, on runs of its own."""
    return rounded(artifacts(f).filter("kind = 'global_calibrator'"))


@query()
def group_gate(f: Frames) -> DataFrame:
    """Is a calibrator of one's own worth it? Per source of documents, with each hundred of ids as a run. See stats.group_gate."""
    rows = f.scored.select(F.col("grp").alias("group_key"), F.floor(F.col("doc_id") / 100).cast("string").alias("run_id"), detectors.logit(F.col("score"), F.lit(0)).alias("z"), "label")
    out = stats.group_gate(rows).withColumnRenamed("group_key", "grp")
    return out.withColumns({c: r9(c) for c, kind in out.dtypes if kind == "double"})


@query()
def bundle_manifest(f: Frames) -> DataFrame:
    """Write a bundle of two frames, seal it with a manifest, and validate it."""
    path = f"{sinks.shared_dir(f.spark).rstrip('/')}/wakeline-bundle-{f.spark.sparkContext.applicationId}-{id(f)}"
    sinks.write_bundle({"features": f.features, "coverage": f.coverage}, path)
    stored = sinks.materialize(sinks.manifest(f.spark, path), "manifest")
    problems = sinks.compare_manifests(stored, sinks.manifest(f.spark, path))
    return stored.filter(F.col("file").endswith(".json")).groupBy(F.regexp_extract("file", "^([^/]+)/", 1).alias("frame")).agg((F.sum("bytes") > 0).alias("written")).join(F.broadcast(problems.agg(F.count(F.lit(1)).alias("problems"))))


@query()
def replay_outcomes(f: Frames) -> DataFrame:
    """Formation on all 41 children against the control: revisions and episodes gained or lost, and seconds more until episodes close.

    A child without events has no episodes; a burst that fits nowhere in a run leaves it as it is and is not valid.
    """
    counts = sinks.materialize(replay_runs.outcomes(formation.formation_input(f.norm, f.aliases), replay.cells()), "replay-counts")
    control = counts.filter(F.col("child") == replay.child_key("control", "none", "none")).select("run_id", *[F.col(c).alias(f"base_{c}") for c in ("revisions", "episodes", "stable_s")])
    rows = counts.join(control, "run_id", "left")
    delta = lambda c: F.coalesce(c, F.lit(0)) - F.coalesce(f"base_{c}", F.lit(0))
    return rows.select("run_id", "child", "intervention", "source_family", "level", "valid", delta("revisions").alias("revision_delta"), delta("episodes").alias("episode_delta"), r9(F.col("stable_s") - F.col("base_stable_s")).alias("stabilization_delta_s"))


@query()
def ingest_shift_outcomes(f: Frames) -> DataFrame:
    """Formation when a run's last event arrives later by each of seven delays, against no delay: digests, revisions, late records."""
    rows = sinks.materialize(formation.formation_input(replay.shifted(f.norm), f.aliases), "shifted")
    digest = lambda which, *c: hashing.sha256_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which.isNotNull(), F.struct("seq", *c)))), lambda x: F.concat_ws("\x1f", *[x[k] for k in c])), ","))
    revision, noted = F.col("revision"), F.col("noted_id")
    made = formation.form_rolls(rows, digests=True, notes=True).groupBy("run_id", "child").agg(
        digest(revision, "episode_id", "membership_digest").alias("members"), F.max("revision").alias("max_revision"), F.count("revision").alias("n_revisions"),
        digest(noted, "episode_id", "noted_id", "reason").alias("late"), F.count("noted_id").alias("n_late"),
    )
    out = sinks.materialize(made.filter("n_revisions > 0"), "shift-outcomes")
    base = out.filter("child = '0'").select("run_id", F.col("members").alias("base_members"), F.col("late").alias("base_late"))
    return out.join(base, "run_id").select("run_id", F.col("child").cast("int").alias("delay_s"), (F.col("members") == F.col("base_members")).alias("membership_equal"), (F.col("late") != F.col("base_late")).alias("late_changed"), "max_revision", "n_revisions", "n_late")


@query(formed_sql("""SELECT run_id, count(*)::INT AS n_revisions, sha256(string_agg(sha256('["' || array_to_string(ids, '","') || '"]'), ',' ORDER BY seq)) AS digest FROM formed GROUP BY run_id"""))
def formation_digests(f: Frames) -> DataFrame:
    """One digest of all revisions of a run, in order: equal for equal input, whatever the partitioning."""
    rolls = formation.form_rolls(formation.formation_input(f.norm, f.aliases), digests=True)
    rows = rolls.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "membership_digest"))).alias("r"))
    return rows.select("run_id", F.size("r").alias("n_revisions"), hashing.sha256_text(F.array_join(F.transform("r", lambda x: x["membership_digest"]), ",")).alias("digest"))


__all__ = ["QUERIES"]
