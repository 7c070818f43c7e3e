"""The rolling emission cap as a stream: hours of each source in keyed state, expired by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3600
CAP_OUT = "source string, hour_s long, was string, cap_state string, rolling long"
_COLUMNS = [c.split()[0] for c in CAP_OUT.split(", ")]


class RollingCap(StatefulProcessor):
    """Changes of a source's cap state (ok, warn, hard) by its emissions of the last hours.

    State: one count for each of at most ``hours + 1`` hour buckets (the one that is exactly
    ``hours`` old counts too), the newest hour and the state that it ended in.  When a row of a later hour
    comes, the hours between are gone through, so a decay is told with the hour at which it
    happened, however rows are dealt to batches.  Rows that are late but inside the window count in
    their bucket; older ones are ignored.  A source that falls silent is gone through by a timer and then forgotten.
    """

    def __init__(self, warn: int, hard: int, hours: int = 24) -> None:
        self.warn, self.hard, self.hours = warn, hard, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "hour_s long", "n long")
        self.last = handle.getValueState("last", "hour_s long, cap_state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[int, int] = {}
        for frame in rows:
            for hour, n in frame.groupby("hour_s")["emitted"].sum().items():
                came[int(hour)] = came.get(int(hour), 0) + int(n)
        if not came:
            return
        ring = {k[0]: v[0] for k, v in self.buckets.iterator()} if self.buckets.exists() else {}
        stands = self.last.get() if self.last.exists() else None
        now, state = (int(stands[0]), stands[1]) if stands else (min(came), "ok")
        out: list[tuple] = []
        for hour in sorted(came):
            if hour < now - self.hours * HOUR:
                continue
            if hour > now:
                state = self._pass(key[0], ring, now + HOUR, hour - HOUR, state, out)
                now = hour
            ring[hour] = ring.get(hour, 0) + came[hour]
            if hour == now:
                state = self._pass(key[0], ring, now, now, state, out)
        self._keep(ring, now, state)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ring, out = {k[0]: v[0] for k, v in self.buckets.iterator()}, []
        now, state = int(self.last.get()[0]), self.last.get()[1]
        self._pass(key[0], ring, now + HOUR, now + (self.hours + 1) * HOUR, state, out)
        self.buckets.clear()
        self.last.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _pass(self, source: str, ring: dict[int, int], first: int, last: int, state: str, out: list[tuple]) -> str:
        """Goes from hour to hour and notes changes; beyond the window all hours are alike."""
        for hour in range(first, min(last, first + (self.hours + 1) * HOUR) + 1, HOUR):
            rolling = sum(n for h, n in ring.items() if hour - self.hours * HOUR <= h <= hour)
            new = "hard" if rolling >= self.hard else "warn" if rolling >= self.warn else "ok"
            if new != state:
                out.append((source, hour, state, new, rolling))
                state = new
        return state

    def _keep(self, ring: dict[int, int], now: int, state: str) -> None:
        for hour in [h for h in ring if h < now - self.hours * HOUR]:
            del ring[hour]
            if self.buckets.containsKey((hour,)):
                self.buckets.removeKey((hour,))
        for hour, n in ring.items():
            self.buckets.updateValue((hour,), (n,))
        self.last.update((now, state))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((now + (self.hours + 2) * HOUR) * 1000)


def cap_stream(emissions: DataFrame, warn: int = 4000, hard: int = 5000, hours: int = 24, delay: str = "24 hours") -> DataFrame:
    """Changes of the cap state of each source.  emissions: source, hour_s, emitted.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = emissions.select("source", "hour_s", "emitted", F.timestamp_seconds("hour_s").alias("at")).withWatermark("at", delay)
    return rows.groupBy("source").transformWithStateInPandas(RollingCap(warn, hard, hours), CAP_OUT, "append", "eventTime")
