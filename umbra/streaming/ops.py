"""Stateful operators on event streams. Event times must be `timestamp`, not `timestamp_ntz`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(df: DataFrame, event_time: str, size: str, slide: str | None = None, gap: str | None = None, watermark: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by tumbling, sliding or session windows: (window_start, window_end, by, n)."""
    w = F.session_window(event_time, gap) if gap else F.window(event_time, size, slide)
    name = "session_window" if gap else "window"
    out = df.withWatermark(event_time, watermark).groupBy(w, *by).agg(F.count("*").alias("n"))
    return out.select(F.col(f"{name}.start").alias("window_start"), F.col(f"{name}.end").alias("window_end"), *by, "n")


def dedup(df: DataFrame, key: str, event_time: str, watermark: str = "1 hour") -> DataFrame:
    return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])


def bound_contributions(df: DataFrame, unit: str, m: int, order: list[str]) -> DataFrame:
    """The first m rows of each unit over the life of the stream; a unit's state is one counter."""

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        seen = state.get[0] if state.exists else 0
        for pdf in sorted_chunks(chunks, order):
            take = pdf.iloc[: max(0, m - seen)]
            seen += len(take)
            if len(take):
                yield take
        state.update((seen,))

    return df.groupBy(unit).applyInPandasWithState(run, df.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def sorted_chunks(chunks: Iterator[pd.DataFrame], order: list[str]) -> list[pd.DataFrame]:
    parts = list(chunks)  # one key's rows of one micro-batch
    return [pd.concat(parts).sort_values(order)] if parts else []


def _blob(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(blob: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(blob) as r:
        return r.read_pandas()


def _ms(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000) + 1


class _Hold(StatefulProcessor):
    """State of a class: a flag once it is open, else a list with an entry for each batch that brought rows: (the last time in it, its rows)."""

    def __init__(self, columns: list[str], unit: str, k: int, event_time: str, delay: pd.Timedelta):
        self.columns, self.unit, self.k, self.event_time, self.delay = columns, unit, k, event_time, delay

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "open boolean")
        self.held = handle.getListState("held", "last long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [c[self.columns] for c in rows]
        if self.open.exists():
            yield from parts
            return
        new = pd.concat(parts).dropna(subset=[self.event_time])
        if not len(new):
            return
        old = list(self.held.get()) if self.held.exists() else []
        all_ = pd.concat([*[_rows(bytes(r[1]))[self.columns] for r in old], new]).sort_values(self.event_time, kind="stable")
        first = self._opens(all_[self.event_time].tolist(), all_[self.unit].tolist())
        self._cancel()
        if first is not None:
            self.open.update((True,))
            if old:
                self.held.clear()
            yield all_.iloc[first:]
            return
        self.held.appendValue((_ms(new[self.event_time].max()), _blob(new)))  # what is held already stays as it is
        end = _ms(all_[self.event_time].max() + self.delay)
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))

    def _opens(self, times: list, units: list) -> int | None:
        """Where the first window of max_delay that holds k units begins."""
        first, seen = 0, {}
        for t, u in zip(times, units, strict=True):
            seen[u] = seen.get(u, 0) + 1
            while times[first] < t - self.delay:
                seen[units[first]] -= 1
                if not seen[units[first]]:
                    del seen[units[first]]
                first += 1
            if len(seen) >= self.k:
                return first
        return None

    def _cancel(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All rows held are too old."""
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_k_anonymize(df: DataFrame, qi: list[str], unit: str, k: int, event_time: str, max_delay: str, watermark: str = "1 hour") -> DataFrame:
    """A class's rows are held until k different units came within max_delay, then released; later rows pass at once.

    Rows held longer than max_delay of event time are suppressed: when the class opens, or by a timer max_delay after its
    last row. Rows come out in the order of event time; null times are suppressed. Held rows are list state, to which a batch adds
    its own; nothing is rewritten. Needs RocksDB state: run it by `io.release_stream(..., rocksdb=True)`.
    """
    hold = _Hold(df.columns, unit, k, event_time, pd.Timedelta(max_delay))
    return df.withWatermark(event_time, watermark).groupBy(*qi).transformWithStateInPandas(hold, df.schema, "append", "eventTime")


def derived_noise(salt: str):
    """Hash-derived draws in (0, 1) by (key, level, index): for tests."""
    import hashlib

    return lambda key, level, index: (int(hashlib.md5(f"{salt}{key}|{level}|{index}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def fresh_noise(key: str, level: int, index: int) -> float:
    import os

    return (int.from_bytes(os.urandom(7), "little") >> 3) / 2.0**53 + 2.0**-54


def step_of(event_time: str, start: str, interval: str) -> Column:
    """The number of the interval since start (UTC) that a time lies in; null for a null time."""
    ms = F.unix_millis(F.col(event_time)) - F.lit(pd.Timestamp(start).value // 10**6)
    return F.floor(ms / F.lit(pd.Timedelta(interval).value // 10**6)).cast("long")


def outside(df: DataFrame, event_time: str, start: str, interval: str, horizon: int) -> DataFrame:
    """The rows that continual_count leaves out: null times and times outside the horizon, with a column `reason`. A stream of their own, to be counted or kept."""
    step = step_of(event_time, start, interval)
    reason = F.when(step.isNull(), "null").when(step < 0, "early").when(step >= horizon, "late")
    return df.withColumn("reason", reason).where("reason is not null")


class _Tree(StatefulProcessor):
    """State of a key: the next step, the count so far, and the draws of the tree nodes in use, log(horizon) of them."""

    def __init__(self, by: str, origin: int, width: int, horizon: int, epsilon: float, noise):
        self.by, self.origin, self.width, self.horizon, self.noise = by, origin, width, horizon, noise
        self.scale = (math.ceil(math.log2(max(horizon, 2))) + 1) / epsilon

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next int, total long, nodes array<int>, draws array<double>")
        self.waiting = handle.getMapState("waiting", "step long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for s, n in zip(pdf["step"].tolist(), pdf["n"].tolist(), strict=True):  # a row for each step
                self.waiting.updateValue((s,), (n,))
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _laplace(self, u: float) -> float:
        return -self.scale * math.copysign(1, u - 0.5) * math.log(1 - 2 * abs(u - 0.5))

    def _release(self, key, mark: int) -> Iterator[pd.DataFrame]:
        next_, total, nodes, draws_ = self.at.get() if self.at.exists() else (0, 0, [], [])
        active, rows = dict(zip(nodes, draws_, strict=True)), []
        while next_ < self.horizon and self.origin + (next_ + 1) * self.width <= mark:
            if self.waiting.containsKey((next_,)):
                total += self.waiting.getValue((next_,))[0]
                self.waiting.removeKey((next_,))
            end = next_ + 1
            level = (end & -end).bit_length() - 1
            active = {n: d for n, d in active.items() if n > level} | {level: self._laplace(self.noise(str(key[0]), level, (end >> level) - 1))}
            rows.append((key[0], next_, total + sum(active[n] for n in sorted(active))))
            next_ += 1
        self.at.update((next_, total, list(active), list(active.values())))
        if next_ < self.horizon:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(self.origin + (next_ + 1) * self.width, mark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[self.by, "step", "noisy_count"])

    def close(self) -> None:
        pass


def continual_count(df: DataFrame, by: str, event_time: str, start: str, interval: str, horizon: int, epsilon: float, watermark: str = "1 hour", noise=fresh_noise, ledger=None, name: str = "continual") -> DataFrame:
    """Running count after each step 0..horizon-1 by the binary tree mechanism: (by, step, noisy_count).

    Step t is the t-th interval from start (UTC). A step is released once, when the watermark has passed its end: its
    count is the sum of the tree nodes that cover [0, t], each with Laplace noise of scale levels/epsilon
    that is drawn once and kept while the node is in use. Two stateful operators: events are counted by key and
    step, partly before the shuffle, and the Python state gets a row for each of these counts, not for each event. Rows of steps already
    released are too late and not counted; null times and times outside the horizon are left out: see `outside`. Values of `by`
    must be public. Charges epsilon to the ledger for the whole stream. Needs RocksDB state: `io.release_stream(..., rocksdb=True)`.
    """
    if ledger:
        ledger.spend(name, epsilon)
    origin, width = pd.Timestamp(start).value // 10**6, pd.Timedelta(interval).value // 10**6
    inside = df.withWatermark(event_time, watermark).where(step_of(event_time, start, interval).between(0, horizon - 1))
    window = F.window(event_time, f"{width} milliseconds", startTime=f"{origin % width} milliseconds")
    counts = inside.groupBy(window, F.col(by)).agg(F.count("*").alias("n"))
    steps = counts.select(by, F.window_time("window").alias("__at"), "n").withColumn("step", step_of("__at", start, interval))
    tree = _Tree(by, origin, width, horizon, epsilon, noise)
    return steps.groupBy(by).transformWithStateInPandas(tree, f"`{by}` {dict(df.dtypes)[by]}, step int, noisy_count double", "append", "eventTime")
