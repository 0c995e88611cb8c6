"""Keyed state with timers: locks, job states and a snapshot followed by live events, as streams.

The event-time forms hold what arrives until the watermark has passed it and then take it in order of (ts, id), so
that messages out of order give the rows that ``aerolith.operators.jobs`` gives over the whole history. They need
the RocksDB state store (``STORE``) in the session. What comes later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerolith.operators.jobs import LOCK_SECONDS
from aerolith.streaming.progress import STATES, TERMINAL

#: Session settings that these operators need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_RANK = {s: i for i, s in enumerate(STATES)}


class InOrder(StatefulProcessor):
    """Holds (at, id, stage) of each key until the watermark passes, with one timer for the first that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, stage string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, at: int, ident: int, stage: str | None) -> dict[str, Any] | None:
        """The row for what is next in order."""
        raise NotImplementedError

    def settle(self, passed: int) -> list[dict[str, Any]]:
        """Rows for what is due although nothing came."""
        return []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            stages = part["stage"] if "stage" in part else [None] * len(part)
            at = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(a), int(i), s if isinstance(s, str) else None) for a, i, s in zip(at, part["id"] if "id" in part else [0] * len(part), stages, strict=True)])
        yield from self._due(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._due(key, timerValues)

    def _due(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        held = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[2] or ""))
        rest = [r for r in held if r[0] > passed]
        out = [row for row in (self.take(*r) for r in held if r[0] <= passed) if row] + self.settle(passed)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        if out:
            rows = pd.DataFrame(out)
            rows.insert(0, "key", key[0])
            rows["ts"] = pd.to_datetime(rows["ts"], unit="us")
            yield rows

    def close(self) -> None:
        pass


class Grants(InOrder):
    """Exclusive locks: the state is who holds the lock and since when."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.lock = handle.getValueState("lock", "at long, id long")
        self.last = handle.getValueState("last", "at long, id long")

    def take(self, at: int, ident: int, stage: str | None) -> dict[str, Any] | None:
        if self.last.exists() and tuple(self.last.get()) == (at, ident):
            return None  # delivered again
        self.last.update((at, ident))
        lock = tuple(self.lock.get()) if self.lock.exists() else None
        granted = lock is None or at >= lock[0] + self.micros
        if granted:
            lock = (at, ident)
            self.lock.update(lock)
        return {"id": ident, "ts": at, "granted": granted, "holder": lock[1]}


class Transitions(InOrder):
    """States of jobs: the state is the furthest stage, the stage that ended the job, and the ids seen."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "furthest int, ended string")
        self.seen = handle.getMapState("seen", "id long", "at long")

    def take(self, at: int, ident: int, stage: str | None) -> dict[str, Any] | None:
        furthest, ended = tuple(self.now.get()) if self.now.exists() else (0, None)
        before = ended or STATES[furthest]
        reason = None
        if self.seen.containsKey((ident,)):
            reason = "duplicate"
        elif stage not in _RANK:
            reason = "unknown"
        elif ended:
            reason = "ended"
        elif stage not in TERMINAL and _RANK[stage] < furthest:
            reason = "backward"
        if reason != "duplicate":
            self.seen.updateValue((ident,), (at,))
        if reason is None:
            furthest, ended = (furthest, stage) if stage in TERMINAL else (_RANK[stage], None)
            self.now.update((furthest, ended))
        return {"id": ident, "ts": at, "stage": stage, "before": before, "after": stage if reason is None else before, "accepted": reason is None, "reason": reason}


def lock_grants(requests: DataFrame, seconds: int = LOCK_SECONDS, late: str = "1 hour") -> DataFrame:
    """The rows of ``jobs.lock_grants`` for a stream of (key, id, ts), each when the watermark has passed its request."""
    rows = requests.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(Grants(seconds), "key long, id long, ts timestamp, granted boolean, holder long", "Append", "EventTime")


def transitions(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """The rows of ``jobs.transitions`` for a stream of (key, id, ts, stage); refused messages are rows of their own."""
    rows = messages.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(Transitions(), "key long, id long, ts timestamp, stage string, before string, after string, accepted boolean, reason string", "Append", "EventTime")


class Live(StatefulProcessor):
    """A lock as a service sees it: its state expires by itself, seconds after it was given, by the clock."""

    def __init__(self, seconds: float):
        self.millis = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lock = handle.getValueState("lock", "id long", ttlDurationMs=self.millis)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for part in rows:
            for ident in part.sort_values(["ts", "id"])["id"]:
                granted = not self.lock.exists()
                if granted:
                    self.lock.update((int(ident),))
                out.append((key[0], int(ident), granted, self.lock.get()[0]))
        yield pd.DataFrame(out, columns=["key", "id", "granted", "holder"])

    def close(self) -> None:
        pass


def live_locks(requests: DataFrame, seconds: float = LOCK_SECONDS) -> DataFrame:
    """key, id, granted, holder for a stream of (key, id, ts) as it arrives: locks expire by the clock."""
    return requests.groupBy("key").transformWithStateInPandas(Live(seconds), "key long, id long, granted boolean, holder long", "Append", "ProcessingTime")


class Heartbeats(InOrder):
    """Workers that fall silent: the state is the last beat, with a timer for its end."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def take(self, at: int, ident: int, stage: str | None) -> dict[str, Any] | None:
        last = self.last.get()[0] if self.last.exists() else None
        self.last.update((at,))
        return {"ts": last} if last is not None and at - last > self.micros else None

    def settle(self, passed: int) -> list[dict[str, Any]]:
        if not self.last.exists():
            return []
        (last,) = self.last.get()
        if passed > last + self.micros:
            self.last.clear()
            return [{"ts": last}]
        self.handle.registerTimer((last + self.micros) // 1000 + 1)
        return []


def silent(beats: DataFrame, seconds: int = 15, late: str = "10 seconds") -> DataFrame:
    """key and ts of the last beat of each spell (key, ts) that ended: none came for ``seconds`` after it."""
    return beats.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Heartbeats(seconds), "key long, ts timestamp", "Append", "EventTime")


class Replay(StatefulProcessor):
    """The snapshot of a key first, then its live events; what the snapshot already holds isn't repeated."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, id long, stage string, told boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        at = initialState["ts"].astype("datetime64[us]").astype("int64")
        newest = max(zip(at, initialState["id"], initialState["stage"], strict=True))
        self.state.update((int(newest[0]), int(newest[1]), newest[2], False))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs())

    def _snapshot(self, key: tuple) -> list[tuple]:
        if not self.state.exists() or self.state.get()[3]:
            return []
        at, ident, stage, _ = self.state.get()
        self.state.update((at, ident, stage, True))
        return [(key[0], ident, pd.Timestamp(at, unit="us"), stage, "snapshot")]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._snapshot(key)
        events = sorted((int(a), int(i), s) for part in rows for a, i, s in zip(part["ts"].astype("datetime64[us]").astype("int64"), part["id"], part["stage"], strict=True))
        last = tuple(self.state.get()[:2]) if self.state.exists() else (-(1 << 62), 0)
        for at, ident, stage in events:
            if (at, ident) > last:
                last = (at, ident)
                self.state.update((at, ident, stage, True))
                out.append((key[0], ident, pd.Timestamp(at, unit="us"), stage, "live"))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "ts", "stage", "source"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if out := self._snapshot(key):
            yield pd.DataFrame(out, columns=["key", "id", "ts", "stage", "source"])

    def close(self) -> None:
        pass


def snapshot_then_live(events: DataFrame, latest: DataFrame) -> DataFrame:
    """key, id, ts, stage, source: for each key the row of ``latest`` (key, id, ts, stage), then what the stream brings after it.

    The table is the initial state of the stream, read once when a query first starts; a restart goes on from the state.
    The events of a key are ordered within a micro-batch; one that isn't after the last told is taken for one delivered again.
    """
    first = latest.groupBy("key").agg(F.max(F.struct("ts", "id", "stage")).alias("m")).select("key", "m.ts", "m.id", "m.stage").groupBy("key")
    return events.groupBy("key").transformWithStateInPandas(Replay(), "key long, id long, ts timestamp, stage string, source string", "Append", "ProcessingTime", initialState=first)
