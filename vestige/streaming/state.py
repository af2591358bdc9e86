"""Detections that need a session's past, on a stream: sequences, first sightings and counts, with state that is bounded and ends."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.rules import Chain, follow

OUTPUT = "key string, rule string, event_id long, last_event long, at long"


class Row(NamedTuple):
    at: int
    e: int
    bits: int


class _Session(StatefulProcessor):
    """One key's state.

    Rows wait in ``waiting`` until the watermark has passed them, and are then taken in order of (time, id), so that what order and how often
    they came in does not matter: a copy of a row that waits replaces it, and one of a row that was taken is late.  ``held`` are taken rows
    that may still be part of a match: none older than the window.  Everything goes once nothing has come for the idle time.
    """

    def __init__(self, name: str, steps: int, window: int, limit: int, idle: int):
        self.name, self.steps, self.window, self.limit, self.idle = name, steps, window, limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "e long", "at long, bits int, seen string, counted boolean")
        self.held = handle.getListState("held", "at long, e long, bits int")
        self.seen = handle.getMapState("seen", "value string", "at long")
        self.count = handle.getValueState("count", "n long, last long")

    def close(self) -> None:
        pass

    def _wake(self, at_us: int, mark: int) -> None:
        """A timer no later than that, at a whole millisecond; those that the watermark has passed are spent."""
        at = -(-at_us // 1000)
        if not any(mark < 1000 * t and t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.waiting.updateValue((r.event_id,), (r.at, r.bits, r.seen, r.counted))
                first = r.at if first is None else min(first, r.at)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], None
        for (e,), (at, bits, seen, counted) in list(self.waiting.iterator()):
            if at <= mark:
                ready.append((at, e, bits, seen, counted))
            else:
                later = at if later is None else min(later, at)
        out = []
        n, last = self.count.get() if self.count.exists() else (0, 0)
        for at, e, _, seen, counted in sorted(ready, key=lambda r: r[:2]):
            self.waiting.removeKey((e,))
            if last and at - last > self.idle:  # by the rows' own times, so that it does not hang on when the state was cleared
                self.seen.clear()
                n = 0
            if seen is not None and not self.seen.containsKey((seen,)):
                self.seen.updateValue((seen,), (at,))
                out.append(("FIRST_SEEN", e, e, at))
            if counted:
                n += 1
                if n == self.limit + 1:
                    out.append(("ABOVE_LIMIT", e, e, at))
            last = max(last, at)
        if ready:
            self.count.update((n, last))
        out += self._sequences([Row(at, e, bits) for at, e, bits, *_ in sorted(ready, key=lambda r: r[:2]) if bits], mark)
        if later is not None:
            self._wake(later, mark)
        elif last and last + self.idle <= mark:
            for state in (self.waiting, self.held, self.seen, self.count):
                state.clear()
        elif last:
            self._wake(last + self.idle, mark)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "rule", "event_id", "last_event", "at"])

    def _sequences(self, new: list[Row], mark: int) -> list[tuple[str, int, int, int]]:
        rows = [Row(*r) for r in self.held.get()] if self.held.exists() else []
        if not rows and not new:
            return []
        rows, out, i = rows + new, [], 0
        while i < len(rows):
            found = follow(rows, i, [None] * self.steps, False, self.window) if rows[i].bits & 1 else None
            if found:
                out.append((self.name, rows[i].e, rows[found[0]].e, rows[i].at))
                i = found[1]
            elif rows[i].bits & 1 and mark - rows[i].at <= self.window:
                self._wake(rows[i].at + self.window + 1000, mark)  # what completes it may still come; if nothing does, a later start counts
                break
            else:
                i += 1
        if i < len(rows):
            self.held.put([tuple(r) for r in rows[i:]])
        elif self.held.exists():
            self.held.clear()
        return out


def live_detections(stream: DataFrame, key: str, chain: Chain, seen: Column, counted: Column, limit: int, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """Findings of each key's rows (ts, event_id), as a batch would find them: key, rule, event_id, last_event, at (microseconds).

    The chain's greedy matches that don't overlap (its steps' conditions and window; no link), FIRST_SEEN for the first row of each value of
    ``seen``, and ABOVE_LIMIT for the row that makes more than limit rows for which ``counted`` holds.  Rows may come in any order and more than
    once within ``late``; later ones are left out.  A key's state ends when nothing has come for the time ``idle`` behind its last row; the same value
    is then first seen again.  Rows without key, id or time are left out.  Needs the RocksDB state store, set in the session.
    """
    if not chain.window_us or chain.link or any(s.differs for s in chain.steps):
        raise ValueError("a live chain needs a window, and has no link")
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(s.when, F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(chain.steps)))
    rows = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col(key).cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"), bits.alias("bits"), seen.cast("string").alias("seen"), F.coalesce(counted, F.lit(False)).alias("counted"))
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Session(chain.chain_id, len(chain.steps), chain.window_us, limit, idle_us), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
