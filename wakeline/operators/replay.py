"""Seeded perturbations of a run's events, and design tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions.hashing import hmac_sha256, keyed_uniform, xor_pad
from wakeline.operators.numbering import numbered

SECOND = 1_000_000
SEED = "77616b656c696e652d7265706c61792d7631"
#: Levels of each intervention.
DESIGN = {"mask": ["all"], "drop": [0.05, 0.10, 0.25], "burst": [30, 120, 300], "delay": [30, 120, 600], "reorder": [30, 120, 600], "skew": [-120, -30, 30, 120], "duplicate": [0.05, 0.10, 0.25]}
CARDS = ["M1", "M3", "M4", "M7"]


def drawn(events: DataFrame, intervention: str, family: str, level, domain: str, key) -> DataFrame:
    """Adds u, a draw in [0, 1) for each row's key. Every child of a run has a seed of its own, from run, intervention, source and level."""
    message = F.concat("run_id", F.lit(f"\x1f{intervention}\x1f{family}\x1f{level}"))
    seed = hmac_sha256(bytes.fromhex(SEED), message)
    runs = events.select("run_id").distinct().withColumn("seed", seed).select("run_id", xor_pad(F.col("seed"), 0x36).alias("_inner"), xor_pad(F.col("seed"), 0x5C).alias("_outer"))
    return events.join(runs, "run_id").withColumn("u", keyed_uniform(F.col("_inner"), F.col("_outer"), domain, key)).drop("_inner", "_outer")


def mask(events: DataFrame, family: str) -> DataFrame:
    return events.filter(F.col("source_family") != family)


def drop(events: DataFrame, family: str, share: float) -> DataFrame:
    """Lose a share of one source's events, by a keyed draw per event."""
    return drawn(events, "drop", family, share, "drop", F.col("event_id")).filter((F.col("source_family") != family) | (F.col("u") >= share)).drop("u")


def burst(events: DataFrame, family: str, length_s: int) -> DataFrame:
    """Lose one stretch of a source per run; its start is drawn among the source's times that leave room before the run's end."""
    ends = events.groupBy("run_id").agg(F.max("event_us").alias("run_end"))
    times = events.filter(F.col("source_family") == family).select("run_id", "event_us").distinct().join(ends, "run_id").filter(F.col("event_us") + length_s * SECOND <= F.col("run_end"))
    w = Window.partitionBy("run_id")
    times = times.withColumn("at", F.row_number().over(w.orderBy("event_us")) - 1).join(times.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id")
    times = drawn(times, "burst", family, length_s, "burst", F.col("run_id"))
    starts = times.filter(F.col("at") == F.floor(F.col("u") * F.col("n"))).select("run_id", F.col("event_us").alias("start_us"))
    inside = (F.col("source_family") == family) & (F.col("event_us") >= F.col("start_us")) & (F.col("event_us") < F.col("start_us") + length_s * SECOND)
    return events.join(starts, "run_id", "left").filter(~F.coalesce(inside, F.lit(False))).drop("start_us")


def delay(events: DataFrame, family: str, seconds: int) -> DataFrame:
    return events.withColumn("ingest_us", F.when(F.col("source_family") == family, F.col("ingest_us") + seconds * SECOND).otherwise(F.col("ingest_us")))


def skew(events: DataFrame, family: str, seconds: int) -> DataFrame:
    return events.withColumn("event_us", F.when(F.col("source_family") == family, F.col("event_us") + seconds * SECOND).otherwise(F.col("event_us")))


def arrival(events: DataFrame) -> DataFrame:
    """Adds arrival_seq: the place of an event in the order of arrival of its run, or of its child of a run."""
    placed = numbered(events, [c for c in ("run_id", "child") if c in events.columns], F.floor(F.col("ingest_us") / (600 * SECOND)), ["ingest_us", "event_us", "source_instance", "event_id"], "arrival_seq")
    return placed.withColumn("arrival_seq", (F.col("arrival_seq") - 1).cast("long"))


def reorder(events: DataFrame, family: str, buffer_s: int) -> DataFrame:
    """Permute one source's events among their own places inside each buffer; times stay, arrival_seq changes."""
    placed = arrival(events)
    first = events.groupBy("run_id").agg(F.min("ingest_us").alias("i0"))
    moving = placed.filter(F.col("source_family") == family).join(first, "run_id").withColumn("buffer", F.floor((F.col("ingest_us") - F.col("i0")) / (buffer_s * SECOND))).drop("i0")
    w = Window.partitionBy("run_id", "buffer")
    slots = moving.select("run_id", "buffer", "arrival_seq", F.row_number().over(w.orderBy("arrival_seq")).alias("at"))
    dealt = drawn(moving.drop("arrival_seq"), "reorder", family, buffer_s, "reorder", F.col("event_id")).withColumn("at", F.row_number().over(w.orderBy("u", "event_id"))).drop("u")
    moved = dealt.join(slots, ["run_id", "buffer", "at"]).drop("buffer", "at")
    return placed.filter(F.col("source_family") != family).unionByName(moved)


def duplicate(events: DataFrame, family: str, share: float) -> DataFrame:
    """Whole dependency groups of a source arrive again a microsecond later under new ids."""
    chosen = drawn(events.filter(F.col("source_family") == family), "duplicate", family, share, "duplicate", F.col("dependency_group")).filter(F.col("u") < share).drop("u")
    copies = chosen.withColumn("event_id", F.concat(F.lit("dup:"), F.sha2(F.col("event_id").cast("binary"), 256))).withColumn("ingest_us", F.col("ingest_us") + 1)
    return events.unionByName(copies)


#: Seconds by which the last event of a run arrives later.
SHIFTS = [0, 60, 119, 120, 121, 901, 1020]


def cells() -> list[tuple[str, str, object]]:
    """The control and every intervention at every level on each source: 41."""
    return [("control", "none", "none")] + [(name, family, level) for name, levels in DESIGN.items() for family in ("EDR", "NDR") for level in levels]


def child_key(intervention: str, family: str, level) -> str:
    return f"{intervention}:{family}:{level}"


def children(events: DataFrame, some: list[tuple] | None = None) -> DataFrame:
    """Every run in every cell of the design: rows keyed by (run_id, child). events should be written, as each cell reads them.

    arrival_seq is null where a child's events arrive in the order of their times, which is formation's own. Children cross the network once, to be
    partitioned by run and child.
    """
    acts = {"control": lambda e, *_: e, "mask": lambda e, family, _: mask(e, family), "drop": drop, "burst": burst, "delay": delay, "skew": skew, "duplicate": duplicate, "reorder": reorder}
    parts, out = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), events.count() // 20_000), None
    for name, family, level in some or cells():
        rows = acts[name](events, family, level)
        place = F.col("arrival_seq") if name == "reorder" else F.lit(None).cast("long")
        rows = rows.select(*events.columns, F.lit(child_key(name, family, level)).alias("child"), place.alias("arrival_seq"))
        out = rows if out is None else out.unionByName(rows)
    return out.repartition(parts, "run_id", "child")


def shifted(events: DataFrame) -> DataFrame:
    """Every run with its last event arriving later by each of SHIFTS: rows keyed by (run_id, child), child the seconds."""
    last = events.groupBy("run_id").agg(F.max(F.struct("event_us", "event_id")).alias("m")).select("run_id", F.col("m.event_id").alias("last_id"))
    rows = events.join(last, "run_id").withColumn("delay_s", F.explode(F.array(*[F.lit(d) for d in SHIFTS])))
    late = F.when(F.col("event_id") == F.col("last_id"), F.col("ingest_us") + F.col("delay_s") * SECOND).otherwise(F.col("ingest_us"))
    return arrival(rows.withColumns({"ingest_us": late, "child": F.col("delay_s").cast("string")}).drop("last_id", "delay_s"))


def design(spark: SparkSession) -> DataFrame:
    """The control and every intervention at every level on each source."""
    rows = [(name, family, str(level)) for name, family, level in cells()]
    return spark.createDataFrame(rows, "intervention string, source_family string, level string")


def outage_cells(spark: SparkSession) -> DataFrame:
    """The 40 cells: two sources, two durations, ten repetitions, cards dealt in turn; the id is a digest of all parts."""
    cells = spark.range(40).select(F.floor(F.col("id") / 20).cast("int").alias("s"), (F.floor(F.col("id") / 10) % 2).cast("int").alias("d"), (F.col("id") % 10).cast("int").alias("repetition_index"))
    card = F.element_at(F.array(*[F.lit(c) for c in CARDS]), (F.col("repetition_index") + 2 * F.col("s") + F.col("d")) % 4 + 1)
    family, seconds = F.when(F.col("s") == 0, "EDR").otherwise("NDR"), F.when(F.col("d") == 0, 120).otherwise(600)
    big_endian = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    sep = F.lit(bytearray(b"\x1f"))
    image = F.concat(F.lit("PO1-v3").cast("binary"), sep, family.cast("binary"), sep, big_endian(seconds), sep, big_endian(F.col("repetition_index")), sep, card.cast("binary"))
    return cells.select(F.sha2(image, 256).alias("cell_id"), family.alias("source_family"), seconds.alias("duration_s"), "repetition_index", card.alias("card_id"))
