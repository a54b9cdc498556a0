"""Voice activity: levels over time, cut into recordings, by one state machine for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Limits:
    """In ms of the rows' time. A level is voiced above the threshold."""

    silence_ms: int = 1200
    least_speech_ms: int = 350
    debounce_ms: int = 130
    most_ms: int = 15_000
    threshold: float = 0.0192


def threshold_over(noise: float) -> float:
    """The level that voice has over a measured noise."""
    return max(0.018, noise * 2.4)


@dataclass
class Recording:
    """An open one: when it began, since when it is voiced without a break, when speech was heard, when voice was last."""

    started: int
    above: int | None = None
    heard: int | None = None
    last: int | None = None

    def ends(self, limits: Limits) -> int:
        """When it ends unless something voiced comes before: after enough speech and silence, or at the longest."""
        most = self.started + limits.most_ms
        return most if self.heard is None else min(most, max(self.last + limits.silence_ms, self.heard + limits.least_speech_ms))

    def closed(self, limits: Limits) -> tuple:
        end = self.ends(limits)
        return self.started, self.heard, end, "limit" if end == self.started + limits.most_ms else "silence"

    def hear(self, t: int, level: float | None, limits: Limits) -> None:
        voiced = level is not None and level > limits.threshold
        if self.heard is None:
            self.above = (t if self.above is None else self.above) if voiced else None
            if voiced and t - self.above >= limits.debounce_ms:
                self.heard = self.last = t
        elif voiced:
            self.last = t


def step(open_: Recording | None, t: int, level: float | None, limits: Limits) -> tuple[Recording, tuple | None]:
    """One row: the open recording after it, and the one that ended before it."""
    closed = None
    if open_ and t >= open_.ends(limits):
        open_, closed = None, open_.closed(limits)
    open_ = open_ or Recording(t)
    open_.hear(t, level, limits)
    return open_, closed


FIELDS = "started_ms long, heard_ms long, ended_ms long, reason string"


def _frame(by: str, keys: list, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["started_ms", "heard_ms", "ended_ms", "reason"]).astype({c: "Int64" for c in ("started_ms", "heard_ms", "ended_ms")})
    out.insert(0, by, keys)
    return out


def recordings(df: DataFrame, by: str, time_ms: str, level: str, limits: Limits) -> DataFrame:
    """by, started_ms, heard_ms (null: no speech), ended_ms, reason of every recording in a table.

    Rows are dealt by key and walked in order of time (equal times: louder last), one open recording and one batch held
    at a time. Rows without a time are left out; null keys are a key.
    """
    ordered = df.select(by, F.col(time_ms).cast("long").alias("_t"), F.col(level).cast("double").alias("_v")).where("_t IS NOT NULL").repartition(by).sortWithinPartitions(by, "_t", "_v")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_, started = None, None, False
        for pdf in batches:
            keys, rows = [], []
            for k, t, v in zip(pdf[by].astype(object).where(pdf[by].notna(), None), pdf["_t"].tolist(), pdf["_v"].tolist(), strict=True):
                if started and k != key:
                    keys.append(key)
                    rows.append(open_.closed(limits))
                    open_ = None
                key, started = k, True
                open_, closed = step(open_, t, None if v != v else v, limits)
                if closed:
                    keys.append(k)
                    rows.append(closed)
            yield _frame(by, keys, rows)
        if started:
            yield _frame(by, [key], [open_.closed(limits)])

    return ordered.mapInPandas(walk, f"{by} {dict(df.dtypes)[by]}, {FIELDS}")


class _Machine(StatefulProcessor):
    """Rows wait until the watermark has passed them, so that they are taken in order of time however they come; a timer stands
    at the next row that waits, and at the open recording's end."""

    def __init__(self, by: str, limits: Limits):
        self.by, self.limits = by, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, v double")
        self.open = handle.getValueState("open", "started long, above long, heard long, last long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            if not len(pdf):
                continue
            times, values = pdf.iloc[:, 2], pdf.iloc[:, 3]  # by place: names may be changed on the way
            new = [(int(t), None if v is None or v != v else float(v)) for t, v in zip(times, values, strict=True)]
            if new:
                self.waiting.appendList(new)
                self._wake(min(t for t, _ in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], -1e300 if r[1] is None else r[1]))
        left = [r for r in rows if r[0] >= now]
        state = self.open.get() if self.open.exists() else None
        open_, out = Recording(*state) if state else None, []
        for t, v in due:
            open_, closed = step(open_, t, v, self.limits)
            out += [closed] if closed else []
        if open_ and open_.ends(self.limits) <= now:
            out.append(open_.closed(self.limits))
            open_ = None
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self._wake(min(t for t, _ in left) + 1)
        if open_:
            self.open.update((open_.started, open_.above, open_.heard, open_.last))
            self._wake(open_.ends(self.limits))
        else:
            self.open.clear()
        return iter([_frame(self.by, [key[0]] * len(out), out)] if out else [])

    def close(self) -> None:
        pass


def stream_recordings(df: DataFrame, by: str, time: str, level: str, limits: Limits, lateness: str) -> DataFrame:
    """The same of a stream: a recording comes out once the watermark has passed its end. Rows later than the watermark are left out.

    The state of a key is one open recording and the rows that the watermark hasn't passed yet. Needs the RocksDB state store.
    """
    ms = F.floor(F.unix_micros(time) / 1000)
    rows = df.withWatermark(time, lateness).select(by, time, ms.alias("_t"), F.col(level).cast("double").alias("_v"))
    schema = f"{by} {dict(df.dtypes)[by]}, {FIELDS}"
    return rows.where(F.col(time).isNotNull()).groupBy(by).transformWithStateInPandas(_Machine(by, limits), schema, "Append", "EventTime")
