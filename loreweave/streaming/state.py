"""Per-key state for the gates: cool-down of sessions, debounce of fact reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICRO = 1_000_000


def _micros(values: pd.Series) -> pd.Series:
    return pd.to_datetime(values).astype("datetime64[us]").astype("int64")


class Cooldown(StatefulProcessor):
    """Pass an event when the wait has gone by since the last one passed."""

    def __init__(self, key: str, seconds: float, columns: list[str], at: str):
        self.key, self.wait, self.columns, self.at = key, int(seconds * MICRO), columns, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.at, *[c for c in self.columns if c not in (self.key, self.at)]], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in _micros(frame[self.at]):
            ok = last is None or t - last >= self.wait
            keep.append(ok)
            if ok:
                last = t
        if last is not None:
            self.last.update((int(last),))
            # The entry is of no use once the wait is over twice.
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + 2 * self.wait) // 1000)
        passed = frame[pd.Series(keep, index=frame.index).to_numpy()]
        yield passed[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class AccessDebounce(StatefulProcessor):
    """Count a read when the wait has gone by or the new count is a multiple."""

    def __init__(self, key: str, at: str, seconds: int, every: int):
        self.key, self.at, self.wait, self.every = key, at, seconds * MICRO, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("access", "n bigint, t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(_micros(pd.concat(list(rows))[self.at]))
        n, last = self.state.get() if self.state.exists() else (0, None)
        changed = False
        for t in times:
            if last is None or t - last >= self.wait or (n + 1) % self.every == 0:
                n, last, changed = n + 1, t, True
        if changed:
            self.state.update((int(n), int(last)))
            yield pd.DataFrame({self.key: [key[0]], "access_count": [n], "last_accessed_at": [pd.Timestamp(last, unit="us")]})

    def close(self) -> None:
        pass


def cooldown_gate(stream: DataFrame, seconds: float, key: str = "session_id", at: str = "created_at", delay: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``gates.cooldown_gate``; events later than ``delay`` are dropped
    and idle keys are forgotten after twice the wait."""
    schema = stream.schema
    processor = Cooldown(key, seconds, stream.columns, at)
    return stream.withWatermark(at, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def access_debounce(stream: DataFrame, key: str = "fact_key", at: str = "read_at", seconds: int = 60, every: int = 5) -> DataFrame:
    """Streaming twin of ``gates.apply_access``: the new count and time of each fact a
    batch touched, to be merged into the fact table."""
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=AccessDebounce(key, at, seconds, every),
        outputStructType=f"{key} {kind}, access_count bigint, last_accessed_at timestamp",
        outputMode="Update",
        timeMode="None",
    )
