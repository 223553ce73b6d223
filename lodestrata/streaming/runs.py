"""Runs as state machines: leases with heartbeats and takeover, budgets with one warning a counter, replay then follow.

Each machine is a pure step from state and event to state and outcome. Structured Streaming holds the state a run in
value and map state with event-time timers (`transformWithStateInPandas`, which needs the RocksDB state store); the batch
forms walk a sorted table with the same step, one event in memory at a time, so a run with very many events is no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocks(df: DataFrame) -> None:
    if not (df.sparkSession.conf.get(STORE, "") or "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE} to {ROCKS}: timers and map state need it")


# Leases. Events: run, id, at (timestamp), owner, kind (claim, heartbeat, finish).


class Lease(NamedTuple):
    """Who holds a run (empty: nobody yet), the last sign of life and last event in microseconds, and whether it is over."""

    owner: str = ""
    beat: int = 0
    last: int = 0
    over: bool = False


def lease_step(lease: Lease, owner: str, kind: str, at: int, stale: int) -> tuple[Lease, str]:
    """The lease after an event, and its outcome.

    A run without owner is granted to whoever claims it; its owner's claims and heartbeats renew it; another's claim takes
    it over if the last sign of life is more than `stale` microseconds old, and is refused otherwise. Its owner alone can
    finish it, after which all is refused. An event older than the run's last one changes nothing: late.
    """
    if at < lease.last:
        return lease, "late"
    seen = lease._replace(last=at)
    if lease.over:
        return seen, "over"
    if owner == lease.owner and lease.owner:
        return seen._replace(beat=at, over=kind == "finish"), "finished" if kind == "finish" else "renewed"
    if kind != "claim":
        return seen, "refused"
    if not lease.owner:
        return seen._replace(owner=owner, beat=at), "granted"
    if at - lease.beat > stale:
        return seen._replace(owner=owner, beat=at), "taken over"
    return seen, "refused"


_EVENT = "run {}, id {}, at timestamp, owner string, outcome string"


def _micros(at: Any) -> int:
    return pd.Timestamp(at).value // 1000


class _Leases(StatefulProcessor):
    def __init__(self, stale_s: int):
        self.stale = stale_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, beat long, last long, over boolean")
        self.seen = handle.getMapState("seen", "id long", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease = Lease(*(self.lease.get() or ()))
        out = []
        for e in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            at = _micros(e.at)
            if self.seen.containsKey((int(e.id),)):
                continue
            self.seen.updateValue((int(e.id),), (at,))
            lease, outcome = lease_step(lease, e.owner, e.kind, at, self.stale)
            out.append((key[0], e.id, e.at, e.owner, outcome))
        self.lease.update(tuple(lease))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if lease.owner and not lease.over:
            self.handle.registerTimer((lease.beat + self.stale) // 1000 + 1)
        self._forget(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["run", "id", "at", "owner", "outcome"]).astype({"id": "int64"})

    def _forget(self, watermark_ms: int) -> None:
        """Ids below the watermark can't come again: Spark drops their events."""
        for (id_,), (at,) in list(self.seen.iterator()):
            if at // 1000 < watermark_ms:
                self.seen.removeKey((id_,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease = Lease(*self.lease.get())
        at = pd.Timestamp(lease.beat + self.stale, unit="us")
        yield pd.DataFrame({"run": [key[0]], "id": [-1], "at": [at], "owner": [lease.owner], "outcome": ["stranded"]})

    def close(self) -> None:
        pass


def streamed_leases(events: DataFrame, stale_s: int, late: str = "10 minutes") -> DataFrame:
    """run, id, at, owner, outcome of each event once; and, with id -1, `stranded` when a lease's time has passed unrenewed."""
    _needs_rocks(events)
    kinds = dict(events.dtypes)
    marked = events.withWatermark("at", late)
    return marked.groupBy("run").transformWithStateInPandas(_Leases(stale_s), _EVENT.format(kinds["run"], "long"), "Append", "EventTime")


def leases(events: DataFrame, stale_s: int) -> DataFrame:
    """The batch form: every event of every run in order of time and id, each id once."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, lease, last = None, Lease(), None
        for rows in batches:
            out = []
            for e in rows.itertuples():
                if run is None or e.run != run:
                    run, lease, last = e.run, Lease(), None
                if e.id == last:
                    continue
                last = e.id
                lease, outcome = lease_step(lease, e.owner, e.kind, _micros(e.at), stale_s * 1_000_000)
                out.append((e.run, e.id, e.at, e.owner, outcome))
            yield pd.DataFrame(out, columns=["run", "id", "at", "owner", "outcome"])

    kinds = dict(events.dtypes)
    dealt = events.select("run", "id", "at", "owner", "kind").repartition("run").sortWithinPartitions("run", "at", "id")
    return dealt.mapInPandas(walk, _EVENT.format(kinds["run"], kinds["id"]))


# Budgets. Events: run, id, at, and a number for each counter.


class _Budgets(StatefulProcessor):
    def __init__(self, limits: dict[str, int], warn: float):
        self.limits, self.warn = limits, warn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "counter string", "used long, warned boolean, refused boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        state = {c: list(self.used.getValue((c,)) or (0, False, False)) for c in self.limits}
        for batch in rows:
            for e in batch.sort_values(["at", "id"]).to_dict("records"):
                for counter, limit in self.limits.items():
                    s = state[counter]
                    s[0] += int(e[counter])
                    for place, bound, what in ((1, self.warn * limit, "warning"), (2, limit, "refused")):
                        if s[0] >= bound and not s[place]:
                            s[place] = True
                            out.append((key[0], counter, what, e["id"], s[0]))
        for counter, s in state.items():
            self.used.updateValue((counter,), tuple(s))
        yield pd.DataFrame(out, columns=["run", "counter", "what", "id", "used"]).astype({"id": "int64", "used": "int64"})

    def close(self) -> None:
        pass


def streamed_budgets(events: DataFrame, limits: dict[str, int], warn: float = 0.85, late: str = "10 minutes") -> DataFrame:
    """run, counter, what, id, used: the event with which a counter first reaches its warning share, and its limit.

    Each event id counts once within the watermark; each crossing is told once, whatever comes after.
    """
    _needs_rocks(events)
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run", "id"])
    out = f"run {dict(events.dtypes)['run']}, counter string, what string, id long, used long"
    return once.groupBy("run").transformWithStateInPandas(_Budgets(limits, warn), out, "Append", "EventTime")


# Replay, then follow. Frames: run, seq (from 1, without gaps once all are in), at, kind.


class _Follow(StatefulProcessor):
    def __init__(self, after: int, terminal: list[str], idle_ms: int):
        self.after, self.terminal, self.idle = after, terminal, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "seq long, over boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sent, over = self.sent.get() or (self.after, False)
        newest = 0
        for batch in rows:
            for f in batch.itertuples():
                newest = max(newest, _micros(f.at))
                if not over and f.seq > sent:
                    self.waiting.updateValue((int(f.seq),), (_micros(f.at), f.kind))
        out = []
        while not over and self.waiting.containsKey((sent + 1,)):
            sent += 1
            at, kind = self.waiting.getValue((sent,))
            self.waiting.removeKey((sent,))
            out.append((key[0], sent, pd.Timestamp(at, unit="us"), kind))
            over = kind in self.terminal
        if over:
            self.waiting.clear()
        self.sent.update((sent, over))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not over:
            self.handle.registerTimer(newest // 1000 + self.idle)
        yield pd.DataFrame(out, columns=["run", "seq", "at", "kind"]).astype({"seq": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sent, over = self.sent.get()
        if not over:
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.handle.registerTimer(at + self.idle)
            yield pd.DataFrame({"run": [key[0]], "seq": [sent], "at": [pd.Timestamp(at, unit="ms")], "kind": ["heartbeat"]})

    def close(self) -> None:
        pass


def followed(frames: DataFrame, after: int, terminal: list[str], idle_s: int, late: str = "10 minutes") -> DataFrame:
    """run, seq, at, kind: frames after `after` in order of seq, each once, up to the first terminal one, then none.

    A frame that comes before its turn waits in map state. While a run is open and silent for `idle_s` of event time, a
    heartbeat with the last seq comes in between, again and again.
    """
    _needs_rocks(frames)
    out = f"run {dict(frames.dtypes)['run']}, seq long, at timestamp, kind string"
    return frames.withWatermark("at", late).groupBy("run").transformWithStateInPandas(_Follow(after, terminal, idle_s * 1000), out, "Append", "EventTime")
