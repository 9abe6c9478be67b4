"""Formation over a stream: the state of a run lives in Spark's state store between micro-batches, as typed maps.

A batch reads of a run what its events touch, and writes what has changed: lineages by id, events by id, entities and groups by name. Only the times at
which lineages fall due are read whole, one short row for each live lineage. What is past is found by the hour in which it came, so forgetting does not
look through the rest.

The clock is the run's own (largest ingest time seen), so Spark's watermark is not used and drops nothing. A batch hands a run its new events in order
of arrival; the result equals the batch form if batches arrive in that order. The state of a run holds no more than the retention time.

With idle_s, a run that has been silent for so many seconds of processing time is ended by a timer: its lineages are finalized and closed, as at the
end of a batch. Events that come afterwards are judged by the clock that this has set. A query with timers runs on under the trigger availableNow, so give
it one of processing time. Late records and rejected events come out beside the
revisions, told apart by `kind`.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from wakeline.operators.formation import BUILDERS, EVENT_COLUMNS, REVISION, SECOND, Former, Lineage, Policy

#: A row is a revision, a late record or a rejected event; the columns of the other kinds are null.
OUTPUT = REVISION + ", kind string, event_id string, latest_revision int, arrival_us long, reason string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
WHOLE = ["revision", "predecessor_revision", "latest_revision", "first_finalized_us", "revision_deadline_us", "event_us_start", "event_us_end", "watermark_us", "arrival_us"]

_MEMBER = "struct<event_us:bigint,ingest_us:bigint,instance:string,id:string>"
STATE = {
    "lineages": (
        "number int, state string, revision int, finalized_us bigint, deadline_us bigint, "
        f"line array<{_MEMBER}>, reasons map<string,string>, groups array<string>, touched map<string,int>, parents array<string>"
    ),
    "events": "dependency_group string, event_us bigint, ingest_us bigint, object string, session_like boolean, source_family string, source_instance string, subject string, lineage string",
    "places": "ids array<string>",
    "sightings": "seen array<struct<event_us:bigint,dependency_group:string>>",
    "due": "state string, at bigint, turn int",
    "hours": "events array<string>, entities array<string>",
}
RUN = "clock bigint, made int, finalized int, revisions int, late int, rejected int"
HOUR_US = 3600 * SECOND


class StateMap(MutableMapping):
    """A map of the state store as a dictionary: values are read when asked for, kept while the batch runs, and written by save() if they changed."""

    _GONE = object()

    def __init__(self, state: MapState, pack: Callable[[Any], tuple], unpack: Callable[[str, tuple], Any]):
        self.state, self.pack, self.unpack = state, pack, unpack
        self.held: dict[str, Any] = {}
        self.stored: dict[str, tuple | None] = {}

    def _load(self, key: str) -> Any:
        if key not in self.held:
            self.stored[key] = packed = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.held[key] = self._GONE if packed is None else self.unpack(key, packed)
            self.stored[key] = None if packed is None else self.pack(self.held[key])
        return self.held[key]

    def __getitem__(self, key: str) -> Any:
        value = self._load(key)
        if value is self._GONE:
            raise KeyError(key)
        return value

    def __setitem__(self, key: str, value: Any) -> None:
        self._load(key)
        self.held[key] = value

    def __delitem__(self, key: str) -> None:
        self[key]
        self.held[key] = self._GONE

    def __iter__(self) -> Iterator[str]:
        names = {k[0] for k in self.state.keys()} | self.held.keys()
        return iter(sorted(k for k in names if self.held.get(k) is not self._GONE))

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def changed(self) -> list[str]:
        return [k for k, v in self.held.items() if (None if v is self._GONE else self.pack(v)) != self.stored[k]]

    def save(self) -> int:
        changed = self.changed()
        for key in changed:
            if self.held[key] is self._GONE:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), self.pack(self.held[key]))
        return len(changed)


# ---------------------------------------------------------------- what the maps hold
def _pack_lineage(x: Lineage) -> tuple:
    return (x.number, x.state, x.revision, x.finalized_us, x.deadline_us, list(x.line), dict(x.reasons), sorted(x.groups), dict(x.touched), list(x.parents))


def _unpack_lineage(key: str, v: tuple) -> Lineage:
    number, state, revision, finalized, deadline, line, reasons, groups, touched, parents = v
    return Lineage(key, number, [tuple(m) for m in line], dict(reasons), set(groups), dict(touched), list(parents), state, revision, finalized, deadline)


class _Homes(MutableMapping):
    """event id -> its lineage, if that is live: a column of the map of events. The former asks for the lineage, the store keeps its id."""

    def __init__(self, events: StateMap, live: StateMap):
        self.events, self.live = events, live

    def __getitem__(self, key: str) -> Lineage:
        return self.live[self.events[key][-1] or ""]

    def __setitem__(self, key: str, lineage: Lineage) -> None:
        self.events[key] = [*self.events[key][:-1], lineage.id]

    def __delitem__(self, key: str) -> None:
        self.events[key] = [*self.events[key][:-1], None]

    def __iter__(self) -> Iterator[str]:
        return iter(self.events)

    def __len__(self) -> int:
        return len(self.events)


class _Known(MutableMapping):
    """event id -> its content."""

    def __init__(self, events: StateMap):
        self.events = events

    def __getitem__(self, key: str) -> tuple:
        return (*self.events[key][:1], key, *self.events[key][1:-1])

    def __setitem__(self, key: str, content: tuple) -> None:
        self.events[key] = [content[0], *content[2:], None]  # its values by name: the second is the id

    def __delitem__(self, key: str) -> None:
        del self.events[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self.events)

    def __len__(self) -> int:
        return len(self.events)


class StoredFormer(Former):
    """A former whose maps are the state store's."""

    def __init__(self, policy: Policy, maps: dict[str, MapState], run: tuple | None):
        super().__init__(policy)
        self.clock, self.made, self.finalized, *self.seqs = run or (None, 0, 0, 0, 0, 0)
        self.live = StateMap(maps["lineages"], _pack_lineage, _unpack_lineage)
        self.events = StateMap(maps["events"], tuple, lambda _, v: list(v))
        self.known, self.home = _Known(self.events), _Homes(self.events, self.live)
        self.where = StateMap(maps["places"], lambda ids: (sorted(ids),), lambda _, v: set(v[0]))
        self.seen = StateMap(maps["sightings"], lambda seen: ([tuple(s) for s in seen],), lambda _, v: [tuple(s) for s in v[0]])
        self.due = StateMap(maps["due"], tuple, lambda _, v: tuple(v))
        self.hours = StateMap(maps["hours"], lambda h: (sorted(h[0]), sorted(h[1])), lambda _, v: (set(v[0]), set(v[1])))
        self.turns: dict[str, int] = {}
        for (key,), (state, at, turn) in maps["due"].iterator():
            self.turns[key] = turn
            {"open": self.ending, "finalized": self.closing, "closed": self.expiring}[state].append((at, turn, key))
        for heap in (self.ending, self.closing, self.expiring):
            heapq.heapify(heap)

    def _turn(self, lineage: Lineage) -> int:
        self.turns[lineage.id] = turn = super()._turn(lineage)
        return turn

    def take(self, event: dict) -> None:
        super().take(event)
        if event["event_id"] in self.known:
            self._came(event["ingest_us"], {event["event_id"]}, {event["subject"], event["object"]})

    def _came(self, us: int, events: set[str], entities: set[str]) -> None:
        hour = self.hours.setdefault(f"{us // HOUR_US:012}", (set(), set()))
        hour[0].update(events)
        hour[1].update(entities)

    def forget(self) -> None:
        """As Former.forget, hour by hour. Events of lineages that are still live are filed under the present hour again."""
        if self.clock is None:
            return
        low = self.clock - (self.p.retention_s + self.p.horizon_s + self.p.lag_s + self.p.hub_window_s) * SECOND
        for name in [h for h in self.hours if (int(h) + 1) * HOUR_US <= low]:
            events, entities = self.hours.pop(name)
            kept = {k for k in events if k in self.home}
            for k in events - kept:
                self.events.pop(k, None)
            for entity in entities & self.seen.keys():
                times = [s for s in self.seen[entity] if s[0] >= low]
                if times:
                    self.seen[entity] = times
                else:
                    del self.seen[entity]
            still = {e for e in entities if e in self.seen}
            if kept or still:
                self._came(self.clock, kept, still)

    def save(self) -> int:
        """Writes what has changed; returns how many entries that were."""
        for key in self.live.changed():
            lineage = self.live.get(key)
            if lineage is None:
                self.due.pop(key, None)
            elif lineage.state == "open":
                self.due[key] = ("open", lineage.line[-1][0], lineage.number)
            elif lineage.state == "finalized":
                self.due[key] = ("finalized", lineage.deadline_us, self.turns[key])
            else:
                self.due[key] = ("closed", lineage.deadline_us + self.p.retention_s * SECOND + 1, lineage.number)
        return sum(m.save() for m in (self.live, self.events, self.where, self.seen, self.due, self.hours))

    @property
    def run(self) -> tuple:
        return (self.clock, self.made, self.finalized, *self.seqs)


# ---------------------------------------------------------------- the processor
class FormationProcessor(StatefulProcessor):
    def __init__(self, builder: str = "full", idle_s: int | None = None):
        self.builder, self.idle_s = builder, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.maps = {name: handle.getMapState(name, "key string", schema) for name, schema in STATE.items()}

    def _former(self) -> StoredFormer:
        return StoredFormer(BUILDERS[self.builder], self.maps, tuple(self.run.get()) if self.run.exists() else None)

    def _close(self, key, former: StoredFormer) -> pd.DataFrame:
        out = []
        for at, (kind, found) in enumerate((("revision", former.revisions), ("late", former.late), ("rejected", former.rejected))):
            out += [{**dict.fromkeys(COLUMNS), "run_id": key[0], "builder": self.builder, "seq": former.seqs[at] + i, "kind": kind, **r} for i, r in enumerate(found)]
            former.seqs[at] += len(found)
        former.forget()
        former.save()
        self.run.update(former.run)
        return pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in WHOLE})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        former = self._former()
        pdf = pd.concat(list(rows)).sort_values(["ingest_us", "event_us", "source_instance", "event_id"], kind="stable")
        for row in pdf[EVENT_COLUMNS].to_dict("records"):
            former.take(row)
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_s)
        yield self._close(key, former)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        former = self._former()
        former.flush()
        yield self._close(key, former)

    def close(self) -> None:
        pass


def form_stream_all(events: DataFrame, builder: str = "full", idle_s: int | None = None) -> DataFrame:
    """Streaming revisions, late records and rejected events (append), by kind. events: a stream with the columns of formation_input. Needs the
    RocksDB state store."""
    mode = "none" if idle_s is None else "processingTime"
    return events.groupBy("run_id").transformWithStateInPandas(FormationProcessor(builder, idle_s), OUTPUT, "append", mode)


def form_stream(events: DataFrame, builder: str = "full", idle_s: int | None = None) -> DataFrame:
    """The revisions alone."""
    return form_stream_all(events, builder, idle_s).filter(F.col("kind") == "revision").select([c.split()[0] for c in REVISION.split(", ")])
