"""All children of a run in one task: what replay.children makes as rows, made of the run's coded events where they are formed.

As rows, 41 children are 41 times the events, which were computed, shuffled, sorted and decoded each time. Here a run's events cross the network once.
A run much larger than others is dealt to several tasks, each with its events and a part of the children.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import coded, replay
from wakeline.operators.formation import FULL, SOURCES
from wakeline.sources.adapters import COVERAGE_S
from wakeline.sources.sinks import sized

#: Events of a run above which its children are dealt to several tasks.
LARGE = 20_000
OUTCOME = "run_id string, child string, intervention string, source_family string, level string, valid boolean, revisions long, episodes long, stable_s double"


_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


def draws(run_id: str, intervention: str, family: str, level, domain: str) -> Callable[[str], float]:
    """A child's draws in [0, 1), by key: those of replay.drawn."""
    seed = hmac.digest(bytes.fromhex(replay.SEED), f"{run_id}\x1f{intervention}\x1f{family}\x1f{level}".encode(), "sha256").ljust(64, b"\0")
    inner, outer = (hashlib.sha256(bytes(b ^ pad for b in seed)) for pad in (0x36, 0x5C))
    inner.update(f"{domain}\x1f".encode())

    def draw(key: str) -> float:
        h, last = inner.copy(), outer.copy()
        h.update(key.encode())
        last.update(h.digest())
        n = last.digest()
        return int.from_bytes(n[:4]) / 2**32 + int.from_bytes(n[4:8]) / 2**64

    return draw


def burst_start(run_id: str, events: list[tuple], family: str, length_s: int) -> int | None:
    """Where the child's burst begins; None if none fits into the run."""
    end = max(e[1] for e in events) - length_s * replay.SECOND
    times = sorted({e[1] for e in events if e[4] == SOURCES[family] and e[1] <= end})
    at = int(draws(run_id, "burst", family, length_s, "burst")(run_id) * len(times))
    return times[at] if at < len(times) else None


def child(run_id: str, run: coded.Run, cell: tuple) -> list[tuple]:
    """The events of a run's child, in the order of their arrival."""
    events, (name, family, level) = run.events, cell
    own = SOURCES.get(family)
    if name == "control":
        return events
    if name == "mask":
        return [e for e in events if e[4] != own]
    if name == "burst":
        start = burst_start(run_id, events, family, level)
        return events if start is None else [e for e in events if e[4] != own or not start <= e[1] < start + level * replay.SECOND]
    if name == "delay":
        return sorted([(e[0] + level * replay.SECOND, *e[1:]) if e[4] == own else e for e in events])
    if name == "skew":
        return sorted([(e[0], e[1] + level * replay.SECOND, *e[2:]) if e[4] == own else e for e in events])
    draw = draws(run_id, name, family, level, name)
    if name == "drop":
        return [e for e in events if e[4] != own or draw(e[3]) >= level]
    if name == "duplicate":
        chosen = {g for g in {e[7] for e in events if e[4] == own} if draw(run.groups[g]) < level}
        return sorted(events + [(e[0] + 1, *e[1:3], "dup:" + hashlib.sha256(e[3].encode()).hexdigest(), *e[4:]) for e in events if e[4] == own and e[7] in chosen])
    # reorder: the source's events change places with each other inside each buffer
    out, width = list(events), level * replay.SECOND
    places: dict[int, list[int]] = {}
    for i, e in enumerate(events):
        if e[4] == own:
            places.setdefault((e[0] - events[0][0]) // width, []).append(i)
    for at in places.values():
        for i, (_, _, e) in zip(at, sorted((draw(events[i][3]), events[i][3], events[i]) for i in at), strict=True):
            out[i] = e
    return out


def large_runs(events: DataFrame, n_cells: int) -> DataFrame:
    """run_id, parts: runs above LARGE events, and to how many tasks their children are dealt."""
    large = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE)
    return sized(large.select("run_id", F.least(F.ceil(F.col("n") / LARGE), F.lit(n_cells)).cast("int").alias("parts")), "large-runs")


def dealt(rows: DataFrame, large: DataFrame, tasks: int) -> DataFrame:
    """rows by run, and part, parts: which part of the cells a row is for."""
    spread = rows.join(large, "run_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.repartition(tasks, "run_id", "part")


def outcomes(events: DataFrame, cells: list[tuple]) -> DataFrame:
    """A row for each run and cell: is the child valid (a burst may fit nowhere), its revisions and episodes, and the mean seconds until episodes close.
    events: see formation.formation_input."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        run_id, rows = key[0].as_py(), coded.Run(table)
        rest = cells[key[1].as_py() :: table["parts"][0].as_py()]
        found = []
        for cell in rest:
            out = coded.Tally()
            coded.form(child(run_id, rows, cell), len(rows.entities), len(rows.groups), out)
            valid = cell[0] != "burst" or burst_start(run_id, rows.events, *cell[1:]) is not None
            found.append((run_id, replay.child_key(*cell), *map(str, cell), valid, out.revisions, out.episodes, out.closed_us / out.closed / replay.SECOND if out.closed else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    schema = _arrow(OUTCOME)
    tasks = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), events.count() // LARGE)
    return dealt(events.select("run_id", *coded.ROW), large_runs(events, len(cells)), tasks).groupBy("run_id", "part").applyInArrow(run, OUTCOME)


# ---------------------------------------------------------------- what revisions say
CONTROL = ("control", "none", "none")
#: What of an event its episode is described by, beside what formation reads.
DESCRIBED = ["action", "command_family", "endpoint_key", "endpoint_host", "parent_pid"]
CONTRADICTION = [None, "none", "unevaluable", "present"]
AXES = ["coverage", "provenance", "lateness", "contradiction", "kappa"]
#: A row for each run and child: its revisions, mean seconds until episodes close, d and c over the audits among its revisions, and on how many revisions that
#: the control has too each axis differs. And, with episode_no, a row for each terminal revision; audit is null where there is no outcome.
PROFILE = (
    f"run_id string, child string, revision_count long, stabilization_s double, {', '.join(f'u_{a} long' for a in AXES)}, d double, c double, "
    "episode_no string, audit boolean, kappa string, start_us long, end_us long, entities array<string>, tokens array<string>, detectors array<string>, shares array<double>"
)
#: What is eligible and detected, in the bits of Own.says.
DETECTED = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]


class Own:
    """What the events of an episode say together: the largest share by detector and group, whether facts are missing or clash, tokens as bits."""

    __slots__ = ("best", "facts", "tokens", "gap", "clash", "seen", "d", "says", "base")

    def __init__(self, parents: list[Own], base: list[int] | None):
        self.best, self.facts, self.tokens, self.gap, self.clash, self.seen, self.d, self.says, self.base = {}, {}, 0, False, False, 0, 0.0, 0, base
        for other in parents:
            self.add(other.best.items(), other.facts.items(), other.tokens, other.seen)
            self.gap, self.clash = self.gap or other.gap, self.clash or other.clash

    def add(self, steps, facts, tokens: int, seen: int) -> None:
        if steps:
            best, more = self.best, False
            for key, share in steps:
                old = best.get(key)
                if old is None or share > old:
                    best[key], more = share, True
            self.seen |= seen
            if more:
                top, total = sorted(best.values(), reverse=True)[:3], 0.0
                for share in top:  # sum() would round otherwise than Spark
                    total += share
                self.d = total / len(top)
        known = self.facts
        for key, value in facts:
            if value is None:
                self.gap = True
                known.setdefault(key)
            elif (old := known.get(key)) is None:
                known[key] = value
            elif old != value:
                self.clash = True
        self.tokens |= tokens
        self.says = (3 if self.clash else 2 if self.gap else 1 if known else 0) << 3 | (4 if self.best else 0) | self.seen


class Profiles(coded.Tally):
    """Revisions counted by what they say: interval of the last event, state, lateness, contradiction, and which sources were detected, packed into a number."""

    def __init__(self, name: str, about: dict[str, tuple], control: dict[str, list[int]], first: bool, best: bool):
        super().__init__()
        self.name, self.about, self.control, self.first, self.best = name, about, control, first, best
        self.groups: dict[tuple, list] = {}
        self.ended: list[tuple] = []

    def start(self, line: coded.Line) -> None:
        name = line.id(FULL.version)
        if self.first:
            self.control[name] = []
        line.own = Own([x.own for x in line.parents], self.control.get(name))

    def join(self, line: coded.Line, event: tuple) -> None:
        steps, facts, tokens = self.about[event[3]]
        line.own.add(steps, facts, tokens, 2 if event[4] == SOURCES["EDR"] else 1 if event[4] == SOURCES["NDR"] else 0)

    def mark(self, line: coded.Line, watermark: int, late: bool) -> None:
        own, state = line.own, line.state
        says = line.last // (COVERAGE_S * replay.SECOND) << 8 | state << 6 | late << 5 | own.says
        base = own.base
        if self.first:
            base.append(says)
            key = (says, says)
        else:
            key = (says, base[line.revision] if base is not None and line.revision < len(base) else None)
        found = self.groups.get(key)
        if found is None:
            found = self.groups[key] = [0, 0.0, 0]
        found[0] += 1
        found[1] += own.d
        found[2] += own.says & 3 == 3
        if state == coded.CLOSED:
            self.closed += 1
            self.closed_us += watermark - line.last
        elif state == coded.FINALIZED and not late:
            self.ended.append((says, own.d, f"{self.name}#{line.number}", line.first, line.last, list(line.touched), own.tokens, dict(own.best) if self.best else None))


class Verdicts:
    """What is made of revisions, by what they say: is there an audit, and the five axes. None without contradiction's part."""

    def __init__(self, table: pa.Table):
        rows = zip(*[_list(table[c]) for c in ("slot", "detected", "audit", "coverage", "provenance", "kappa")], strict=True)
        self.by_slot = {(int(slot), int(detected)): (audit, coverage, provenance, kappa) for slot, detected, audit, coverage, provenance, kappa in rows if coverage is not None}
        self.known: dict[int, tuple | None] = {}

    def of(self, says: int) -> tuple | None:
        if says not in self.known:
            contradiction, made = CONTRADICTION[says >> 3 & 3], None
            if contradiction:
                audit, coverage, provenance, kappa = self.by_slot[says >> 8, says & 7]
                lateness = "late_accepted" if says >> 5 & 1 else "stable" if says >> 6 & 3 == coded.CLOSED else "revisable"
                made = audit, (coverage, provenance, lateness, contradiction, kappa)
            self.known[says] = made
        return self.known[says]

    def summary(self, out: Profiles) -> tuple:
        """A child's part of PROFILE up to c."""
        differ, audits, d_sum, c_sum = [0] * len(AXES), 0, 0.0, 0
        for (says, base), (n, d, c) in out.groups.items():
            own = self.of(says)
            if own is None or not own[0]:
                continue
            audits, d_sum, c_sum = audits + n, d_sum + d, c_sum + c
            if says != base and base is not None and (control := self.of(base)) is not None and control[0]:
                for i, (x, y) in enumerate(zip(own[1], control[1], strict=True)):
                    differ[i] += n * (x != y)
        stable = out.closed_us / out.closed / replay.SECOND if out.closed else None
        return sum(n for n, _, _ in out.groups.values()), stable, *differ, d_sum / audits if audits else None, c_sum / audits if audits else None


def _list(column: pa.ChunkedArray) -> list:
    """The values as Python's own; by way of numpy, which is much quicker. Numbers beside nulls become doubles."""
    return column.to_numpy().tolist()


def _about(table: pa.Table, shares: pa.Table, run: coded.Run) -> tuple[dict[str, tuple], list[str], list[str]]:
    """By event id: its shares by detector and group, its facts, and its tokens as bits; and the names of tokens and detectors."""
    number, tokens, detectors, about = {g: i for i, g in enumerate(run.groups)}, {}, {}, {}
    group_of = {}
    columns = [_list(table[c]) for c in ("event_id", "source_family", "dependency_group", *DESCRIBED)]
    for event_id, family, group, action, command, endpoint, host, parent in zip(*columns, strict=True):
        group_of[event_id] = g = number[group]
        steps, facts, bits = about.get(event_id, ([], [], 0))
        if endpoint is not None:
            facts.append((endpoint, host))
        if family == "EDR":
            facts.append((g, parent))
        for token in (action, None if command is None else f"command_family:{command}"):
            if token is not None:
                bits |= 1 << tokens.setdefault(token, len(tokens))
        about[event_id] = steps, facts, bits
    for event_id, detector, share in zip(*[_list(shares[c]) for c in ("event_id", "detector_id", "share")], strict=True):
        if event_id is not None:
            about[event_id][0].append((detectors.setdefault(detector, len(detectors)) * len(number) + group_of[event_id], share))
    return about, list(tokens), list(detectors)


def profiles(events: DataFrame, shares: DataFrame, verdicts: DataFrame, cells: list[tuple], tasks: int, best: bool = False) -> DataFrame:
    """PROFILE rows of every run and cell, in tasks by run. events: see formation.formation_input, and DESCRIBED. shares: run_id, event_id, detector_id and share.
    verdicts: run_id, slot, detected (as bits), audit, coverage, provenance and kappa, for each interval and each of DETECTED. All should lie by run.
    best: terminal revisions come with their largest share of each detector and group."""
    schema = _arrow(PROFILE)
    names = [f.name for f in schema]

    def run(key: tuple, table: pa.Table, steps: pa.Table) -> pa.Table:
        run_id, rows = key[0].as_py(), coded.Run(table)
        about, tokens, detectors = _about(table, steps, rows)
        mine = cells if len(key) == 1 else cells[key[1].as_py() :: table["parts"][0].as_py()]
        verdicts, control = Verdicts(steps), {}
        found: list[tuple] = []
        for cell in ([CONTROL] if CONTROL in cells else []) + [c for c in mine if c != CONTROL]:
            name, given = replay.child_key(*cell), child(run_id, rows, cell)
            out = Profiles(name, about, control, cell == CONTROL, best)
            if cell[0] == "duplicate":
                same = {hashlib.sha256(e.encode()).hexdigest(): said for e, said in about.items()}
                out.about = about | {e[3]: same[e[3][4:]] for e in given if e[3] not in about}
            coded.form(given, len(rows.entities), len(rows.groups), out)
            if cell not in mine:
                continue
            found.append((run_id, name, *verdicts.summary(out), *(None,) * 9))
            for says, d, episode_no, start_us, end_us, touched, bits, held in out.ended:
                made = verdicts.of(says)
                said = sorted(t for i, t in enumerate(tokens) if bits >> i & 1)
                largest = (None, None) if held is None else ([detectors[k // len(rows.groups)] for k in held], list(held.values()))
                found.append((run_id, name, *(None,) * 7, d, float(says & 3 == 3), episode_no, made and made[0], made and made[1][-1], start_us, end_us, sorted(rows.entities[x] for x in touched), said, *largest))
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    large = large_runs(events, len(cells))
    events = events.select("run_id", *coded.ROW, *DESCRIBED)
    # Columns of their own, as they may come from the same events; a group takes two tables, so both are one.
    shares = shares.select(*[F.col(c).alias(c) for c in shares.columns]).unionByName(verdicts, allowMissingColumns=True)
    if large.isEmpty():
        return events.groupBy("run_id").cogroup(shares.groupBy("run_id")).applyInArrow(run, PROFILE)
    pairs = dealt(events, large, tasks).groupBy("run_id", "part").cogroup(dealt(shares, large, tasks).groupBy("run_id", "part"))
    return pairs.applyInArrow(run, PROFILE).repartition(tasks, "run_id")
