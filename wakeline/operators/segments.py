"""Formation of one very large run in many tasks.

A lineage's members lie no further apart than the link gap, so where a run's event times have a larger hole, no lineage reaches across it. The
stretches between such holes are formed apart, neighbouring small ones together as a chunk of about `chunk_events`. Three things cross the holes, and
come as columns:

* the run's clock. What finalizes or closes a lineage is the first event of the whole run at or after a certain ingest time: the event time plus
  the allowed lag, the finalization plus the horizon. For each event these successors are looked up before (`successors`), so that a chunk
  knows at which positions of the run's order something falls due, and under which clock;
* hub counts. They look back `hub_window_s`, which may reach over a hole: events of that stretch before a chunk come along as halo rows, which are
  counted and no more. Holes are wider than half the window, so an event is a halo row of two chunks at most;
* the order of output. Each revision carries the position of the event that caused it and its place there, from which a run's revisions are numbered
  over all chunks.

Results are those of form_episodes, to the row. Events must come in their own order (no arrival_seq). An event id that stands at different contents fails
the job, as it does there. A run without holes stays one task: its lineages may depend on each other from end to end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.formation import BUILDERS, EVENT_COLUMNS, FULL, LATE, REJECTED, REVISION, SECOND, Former, Lineage, Policy, arrow_rows, event_rows
from wakeline.operators.numbering import numbered
from wakeline.sources.sinks import materialize

ORDER = ["ingest_us", "event_us", "source_instance", "event_id"]
#: After every event of a run.
END = 1 << 60
#: Width of the slices of time by which a run is dealt out for numbering and look-ups.
SLICE_US = 600 * SECOND
_PLACE = ["at", "stage", "first", "second", "third"]


class ChunkFormer(Former):
    """One chunk of a run. ticks: what falls due at a time -> (position, ingest time) of the run's first event then or later."""

    def __init__(self, policy: Policy, ticks: dict[int, tuple[int, int]], last_us: int, lists: bool = True):
        super().__init__(policy)
        self.ticks, self.last_us, self.lists = ticks, last_us, lists
        self.at = self.stage = 0  # stages at a position: 0 finalize, 1 close, 2 the event itself, 3 finalize what it left behind the watermark
        self.turns: dict[str, tuple] = {}
        self.places: list[tuple] = []
        self.late_at: list[int] = []
        self.rejected_at: list[int] = []

    # ------------------------------------------------------------ places instead of counters
    def _new(self, key: str) -> Lineage:
        lineage = super()._new(key)
        lineage.number = self.at
        return lineage

    def _turn(self, lineage: Lineage) -> tuple:
        self.turns[lineage.id] = turn = (self.at, self.stage, lineage.number)
        return turn

    def _emit(self, lineage: Lineage, late: str | None = None) -> None:
        if not self.lists:  # only late or rejected events are asked for
            lineage.revision += 1
            return
        super()._emit(lineage, late)
        if self.stage == 2:
            self.places.append((self.at, 2, 0, 0, 0))
        elif lineage.state == "closed":
            self.places.append((self.at, 1, *self.turns[lineage.id]))
        else:
            self.places.append((self.at, self.stage, lineage.number, 0, 0))

    def _note(self, lineage: Lineage, event: dict, reason: str) -> None:
        super()._note(lineage, event, reason)
        self.late_at.append(self.at)

    # ------------------------------------------------------------ stages
    def advance(self, now: int) -> None:
        self.stage = 0
        super().advance(now)

    def _verdict(self, event: dict, bids: list) -> str:
        self.stage = 2
        return super()._verdict(event, bids)

    def _settle(self, now: int) -> None:
        self.stage = 3 if self.stage == 2 else self.stage
        super()._settle(now)

    # ------------------------------------------------------------ the run around the chunk
    def _next(self, heap: list[tuple], state: str, wait_us: int) -> tuple[int, int]:
        """Position and clock at which the first of a heap falls due; entries that newer ones have replaced are dropped."""
        from heapq import heappop

        while heap:
            time, _, key = heap[0]
            lineage = self.live.get(key)
            if lineage is not None and lineage.state == state and (state != "open" or lineage.line[-1][0] == time):
                return self.ticks.get(time + wait_us, (END, 0))
            heappop(heap)
        return END, 0

    def idle(self, until: int) -> None:
        """What other chunks' events before a position bring about here."""
        while True:
            at, now = min(self._next(self.ending, "open", self.p.lag_s * SECOND), self._next(self.closing, "finalized", 0))
            if at >= until:
                return
            self.at = at
            self.advance(now)

    def count(self, event: dict) -> None:
        """A halo row: hubs count it."""
        from bisect import insort

        if event["ingest_us"] - event["event_us"] <= self.p.retention_s * SECOND:
            for entity in {event["subject"], event["object"]}:
                insort(self.seen.setdefault(entity, []), (event["event_us"], event["dependency_group"]))

    def handle(self, event: dict, at: int) -> None:
        self.idle(at)
        self.at = at
        self.take(event)
        if len(self.rejected) > len(self.rejected_at):
            self.rejected_at.append(at)

    def flush(self) -> None:
        self.idle(END)
        self.clock = self.last_us
        for i, wait in enumerate((self.p.lag_s + 1, self.p.horizon_s + self.p.lag_s + 2)):
            self.at = END + i
            self.advance(self.clock + wait * SECOND)


# ---------------------------------------------------------------- chunks
def positions(events: DataFrame) -> DataFrame:
    """Adds pos: the place of an event in its run's order of arrival, from 1."""
    rows = events.select("run_id", *EVENT_COLUMNS)
    return materialize(numbered(rows, ["run_id"], F.floor(F.col("ingest_us") / SLICE_US), ORDER, "pos"), "segments-placed")


def chunks(placed: DataFrame, gap_us: int, chunk_events: int) -> tuple[DataFrame, DataFrame]:
    """Which chunk each slice (of the gap's width) of a run's event time belongs to, and where each chunk begins.

    Inside a slice events are nearer than the gap, so holes lie between slices: one row a slice is all that is sorted."""
    slices = placed.groupBy("run_id", _slice("event_us", gap_us).alias("slice")).agg(F.min("event_us").alias("low"), F.max("event_us").alias("high"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("run_id").orderBy("slice")
    hole = F.coalesce((F.col("low") - F.lag("high").over(order) > gap_us).cast("int"), F.lit(0))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("hole", hole).withColumn("segment", F.sum("hole").over(upto)).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    begin = Window.partitionBy("run_id", "segment")
    slices = slices.withColumn("chunk", F.floor(F.min("before").over(begin) / chunk_events))
    slices = materialize(slices.select("run_id", "slice", "chunk", "low"), "segments-slices")
    return slices.drop("low"), slices.groupBy("run_id", "chunk").agg(F.min("low").alias("start_us"))


def _slice(column: str, width_us: int) -> Column:
    return F.floor(F.col(column) / width_us)


def successors(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: run_id, t. Adds due_at and due_us: position and ingest time of the run's first event at or after t; without one, the row is left out.

    Time is cut into slices; what a slice can't answer, the first event of a later slice does."""
    tick = F.struct(F.col("ingest_us").alias("us"), F.col("pos").alias("at"))
    ticks = placed.select("run_id", F.col("ingest_us").alias("t"), tick.alias("tick"), F.lit(False).alias("ask"))
    rows = ticks.unionByName(asked.distinct().select("run_id", "t", F.lit(None).cast("struct<us:bigint,at:bigint>").alias("tick"), F.lit(True).alias("ask")))
    rows = rows.withColumn("slice", _slice("t", SLICE_US))
    firsts = rows.groupBy("run_id", "slice").agg(F.min("tick").alias("first"))
    later = Window.partitionBy("run_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("run_id", "slice", F.min("first").over(later).alias("later"))
    # Backwards in time, so that the frame grows row by row; rows of equal time belong to it.
    here = Window.partitionBy("run_id", "slice").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("here", F.min("tick").over(here)).filter("ask").join(firsts, ["run_id", "slice"])
    due = F.coalesce("here", "later")
    return found.select("run_id", "t", due["at"].alias("due_at"), due["us"].alias("due_us")).filter("due_at IS NOT NULL")


def _with_ticks(own: DataFrame, placed: DataFrame, policy: Policy) -> DataFrame:
    """Adds ticks: (time, position, ingest time) of all that an event can make fall due."""
    lag, horizon = policy.lag_s * SECOND, policy.horizon_s * SECOND
    ends, own_close = F.col("event_us") + lag, F.col("ingest_us") + horizon
    first = successors(placed, own.select("run_id", F.explode(F.array(ends, own_close)).alias("t")))
    first = materialize(first, "segments-first")
    second = successors(placed, first.select("run_id", (F.col("due_us") + horizon).alias("t")))
    due = materialize(first.union(second).distinct(), "segments-due")
    asks = own.select("run_id", "pos", F.explode(F.array(ends, own_close)).alias("t"))
    direct = asks.join(due, ["run_id", "t"]).select("run_id", "pos", "t", "due_at", "due_us")
    after = direct.select("run_id", "pos", (F.col("due_us") + horizon).alias("t")).join(due, ["run_id", "t"]).select("run_id", "pos", "t", "due_at", "due_us")
    of = direct.union(after).groupBy("run_id", "pos").agg(F.collect_set(F.struct("t", "due_at", "due_us")).alias("ticks"))  # at most four
    return own.join(of, ["run_id", "pos"], "left")


def _refuse_conflicts(placed: DataFrame, policy: Policy) -> None:
    content = F.xxhash64(*[c for c in EVENT_COLUMNS])
    taken = F.col("ingest_us") - F.col("event_us") <= policy.retention_s * SECOND
    first = F.min(F.when(taken, F.struct("pos", content.alias("content"))))
    twice = placed.groupBy("run_id", "event_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad = placed.join(twice, ["run_id", "event_id"]).filter((F.col("pos") > F.col("first.pos")) & (content != F.col("first.content"))).select("event_id").first()
    if bad is not None:
        raise ValueError(f"conflicting duplicate event {bad['event_id']}")


def _form_chunk(which: str):
    """The function of a chunk, and its columns. Chunks may be small and many, so they are exchanged as Arrow tables."""
    ddl = {"revisions": REVISION, "late": LATE, "rejected": REJECTED}[which].replace("seq int, ", "") + "".join(f", {c} long" for c in _PLACE)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        run_id, builder = (k.as_py() for k in key[:2])
        ticks = {t["t"]: (t["due_at"], t["due_us"]) for some in table["ticks"].to_pylist() if some is not None for t in some}
        former = ChunkFormer(BUILDERS[builder], ticks, table["last_us"][0].as_py(), which == "revisions")
        table = table.sort_by("pos")
        for event, at, halo in zip(event_rows(table), table["pos"].to_pylist(), table["halo"].to_pylist(), strict=True):
            if halo:
                former.count(event)
            else:
                former.handle(event, at)
        former.flush()
        flat = {"late": former.late_at, "rejected": former.rejected_at}
        places = former.places if which == "revisions" else [(at, 0, 0, 0, 0) for at in flat[which]]
        found = [{**r, **dict(zip(_PLACE, p, strict=True))} for r, p in zip(getattr(former, which), places, strict=True)]
        return arrow_rows(found, ddl, run_id=run_id, builder=builder)

    return run, ddl


def chunked(events: DataFrame, chunk_events: int = 50_000, policy: Policy = FULL) -> DataFrame:
    """Events and halo rows by run and chunk, with all that a chunk has to know of its run."""
    if "arrival_seq" in events.columns:
        raise ValueError("segments need events in their own order")
    placed = positions(events)
    _refuse_conflicts(placed, policy)
    gap, window = policy.gap_s * SECOND, policy.hub_window_s * SECOND
    slices, starts = chunks(placed, gap, chunk_events)
    runs = placed.groupBy("run_id").agg(F.max("ingest_us").alias("last_us"))
    own = placed.withColumn("slice", _slice("event_us", gap)).join(slices, ["run_id", "slice"]).drop("slice")
    # A run of one chunk has no events but its own, and so nothing to look up.
    many = starts.groupBy("run_id").count().filter("count > 1").select("run_id")
    cut = materialize(own.join(many, "run_id", "left_semi"), "segments-own")
    whole = own.join(many, "run_id", "left_anti").withColumn("ticks", F.lit(None).cast("array<struct<t:bigint,due_at:bigint,due_us:bigint>>"))
    ticked = whole.unionByName(_with_ticks(cut, placed, policy)).withColumn("halo", F.lit(False))
    begin = starts.join(many, "run_id", "left_semi").select("run_id", F.col("chunk").alias("later"), "start_us", _slice("start_us", window).alias("slice"))
    near = cut.withColumn("slice", F.explode(F.array(_slice("event_us", window), _slice("event_us", window) + 1)))
    before = (F.col("later") > F.col("chunk")) & (F.col("event_us") >= F.col("start_us") - window) & (F.col("event_us") < F.col("start_us"))
    halo = near.join(begin, ["run_id", "slice"]).filter(before).drop("slice", "start_us", "chunk").withColumnRenamed("later", "chunk")
    halo = halo.withColumn("ticks", F.lit(None).cast(ticked.schema["ticks"].dataType)).withColumn("halo", F.lit(True))
    return ticked.unionByName(halo).join(runs, "run_id")


def form_segments(events: DataFrame, builders: list[str] | None = None, which: str = "revisions", chunk_events: int = 50_000) -> DataFrame:
    """As form_episodes (which: "revisions"), late_records ("late") or rejected_events ("rejected"), a run's chunks in tasks of their own."""
    rows = chunked(events, chunk_events).withColumn("builder", F.explode(F.array(*[F.lit(n) for n in builders or ["full"]])))
    form, ddl = _form_chunk(which)
    out = rows.groupBy("run_id", "builder", "chunk").applyInArrow(form, ddl)
    out = numbered(materialize(out, f"segments-{which}"), ["run_id", "builder"], F.floor(F.col("at") / 65_536), _PLACE, "seq")
    return out.withColumn("seq", (F.col("seq") - 1).cast("int")).select(["run_id", "builder", "seq", *[c for c in out.columns if c not in ("run_id", "builder", "seq", *_PLACE)]])
