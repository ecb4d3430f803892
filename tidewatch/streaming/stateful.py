"""Keyed state for streams: rate limit, cooldown, count windows and the adaptive detector."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidewatch.functions.payload import parse_payload
from tidewatch.operators import adaptive as AD
from tidewatch.operators.baseline import PowerMoments
from tidewatch.operators.features import feature_fields
from tidewatch.settings import COOLDOWN_SECONDS, RATE_LIMIT_PER_SECOND, WINDOW_SIZE


#: How long a silent device is remembered, and how far the watermark stays behind the newest event.
STATE_LIFE_MS, STATE_DELAY = 90 * 86_400_000, "30 days"


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def rate_limited(messages: DataFrame, limit: int = RATE_LIMIT_PER_SECOND, period_ms: int = 1000) -> DataFrame:
    """Batch form: at most ``limit`` messages per device and period, the first ones."""
    period = F.floor(F.col("ts_ms") / period_ms)
    first = Window.partitionBy("device_id", period).orderBy("ts_ms", "event_id")
    return messages.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= limit).drop("_rn")


def rate_limited_stream(messages: DataFrame, limit: int = RATE_LIMIT_PER_SECOND, period_ms: int = 1000, delay: str = "1 hour") -> DataFrame:
    """Stream form: a counter per device and period, forgotten once the watermark has passed it.

    Of a period's rows in a micro-batch only the first ``limit`` are held while the others stream past.
    """
    columns = [c for c in messages.columns if c != "event_time"]
    df = messages.withWatermark("event_time", delay).withColumn("_period", F.floor(F.col("ts_ms") / period_ms))

    def admit(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, seen, taken = state.get[0] if state.exists else 0, 0, None
        for batch in batches:
            seen += len(batch)
            both = batch if taken is None else pd.concat([taken, batch])
            taken = both.sort_values(["ts_ms", "event_id"]).head(max(0, limit - used))
        state.update((used + seen,))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * period_ms, state.getCurrentWatermarkMs() + 1))
        yield taken[columns]

    return df.groupBy("device_id", "_period").applyInPandasWithState(
        admit, _ddl(messages, columns), "used long", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(alerts: DataFrame, keys: Sequence[str], gap_ms: int = COOLDOWN_SECONDS * 1000, delay: str = "1 hour") -> DataFrame:
    """Greedy cooldown per key; the state is one time and expires after three gaps."""
    columns = [c for c in alerts.columns if c != "event_time"]

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, *more = batches
        rows = pd.concat([rows, *more]) if more else rows
        if len(rows) > 1:  # most keys have one row in a batch, which needs none of this
            rows = rows.sort_values(["ts_ms", "event_id"])
        ms = rows["ts_ms"].to_numpy()
        ready = state.get[0] + gap_ms if state.exists else -(1 << 60)
        kept, i = [], int(np.searchsorted(ms, ready, side="left"))
        while i < len(ms):
            kept.append(i)
            ready = int(ms[i]) + gap_ms
            i = max(i + 1, int(np.searchsorted(ms, ready, side="left")))
        last = int(ms[kept[-1]]) if kept else int(state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 3 * gap_ms, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield (rows if len(kept) == len(rows) else rows.iloc[kept])[columns]

    return alerts.withWatermark("event_time", delay).groupBy(*keys).applyInPandasWithState(
        keep, _ddl(alerts, columns), "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


class Remembered(StatefulProcessor):
    """A keyed state that is forgotten ``life_ms`` of event time after the last row of its key.

    Every call to the store is a message to the JVM and back, so the time of forgetting is kept in the state itself.
    """

    life_ms = 0

    def remember(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def keep_until(self, before: int | None, last_ms: int) -> int:
        """Moves the timer of the current key and returns it; earlier rows that come late do not shorten its life."""
        at = last_ms + self.life_ms
        if before is not None and at <= before:
            return before
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        return at

    def states(self) -> list:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        for state in self.states():
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class CountWindows(Remembered):
    """The events of a device that wait for their window to fill up, and how many windows it has had."""

    def __init__(self, shape: StructType, size: int, life_ms: int):
        self.kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
        self.names, self.size, self.life_ms = shape.names, size, life_ms
        self.whole = {f.name for f in shape.fields if f.dataType.simpleString() in ("bigint", "int")}

    def plain(self, value, name: str):
        """A value as it was: numbers that may be absent arrive as floating point numbers."""
        if value is None or value != value:
            return None
        return int(value) if name in self.whole else value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.remember(handle)
        self.done = handle.getValueState("done", "n long, until long")
        self.waiting = handle.getListState("waiting", self.kind)

    def states(self) -> list:
        return [self.done, self.waiting]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        done, until = self.done.get() or (0, None)
        waiting = [tuple(e) for e in self.waiting.get()] if until is not None and self.waiting.exists() else []
        # An event begins with its time and id, so tuples sort in order of arrival.
        arrived = sorted((tuple(self.plain(r[n], n) for n in self.names) for r in rows), key=lambda t: t[:2])
        if not arrived:
            return
        latest = max(t[0] for t in arrived)
        waiting += arrived
        made = Row(*self.names)
        for at in range(0, len(waiting) - self.size + 1, self.size):
            chosen = sorted(waiting[at : at + self.size], key=lambda t: t[:2])
            yield Row(device_id=key[0], window_id=done, ev=[made(*t) for t in chosen])
            done += 1
        rest = waiting[len(waiting) // self.size * self.size :]
        if rest:
            self.waiting.put(rest)
        elif until is not None:
            self.waiting.clear()
        self.done.update((done, self.keep_until(until, latest)))


def window_stream(
    tel: DataFrame, fields: dict[str, Column] | None = None, size: int = WINDOW_SIZE, life_ms: int = STATE_LIFE_MS, delay: str = STATE_DELAY
) -> DataFrame:
    """Count windows in arrival order: (device_id, window_id, ev), with ``fields`` of each event (by default those of the features).

    The state of a device is fewer than ``size`` events and a count. A device that is silent for ``life_ms`` of event time, by the
    watermark, is forgotten; when it returns, its windows are counted from 0 again. Events older than the watermark (``delay`` behind
    the newest) are left out. Run it within ``runner.keyed_state``.
    """
    fields = fields or feature_fields()
    parsed = parse_payload(tel).withWatermark("event_time", delay)
    slim = parsed.select("device_id", "ts_ms", "event_id", *[c.alias(n) for n, c in fields.items()], "event_time")
    shape = slim.drop("device_id", "event_time").schema
    return slim.groupBy("device_id").transformWithState(
        CountWindows(shape, size, life_ms), f"device_id string, window_id bigint, ev array<{shape.simpleString()}>", "Append", "EventTime")


def raw_fields() -> dict[str, Column]:
    """The columns of an event that rules, features and context are made of."""
    return {n: F.col(n) for n in ("event_type", "package_name", "data")}


def window_rows(windows: DataFrame) -> DataFrame:
    """Windows with ``raw_fields`` as event rows, like those of ``count_windows``."""
    return windows.select("device_id", "window_id", F.posexplode("ev").alias("pos", "e")).select("device_id", "window_id", "pos", "e.*")


#: Numbers are kept as bytes: as arrays, every one would be an object on its way to the store and back.
_STATE = (
    "mean binary, cov binary, n bigint, distance_mean double, distance_std double, cusum_pos double, cusum_neg double, "
    "cusum_h double, first_ms bigint, last_ms bigint, tz bigint, tz_until bigint, probabilities binary, distances binary, "
    "awake binary, alerted array<string>, alerted_ms array<bigint>, lambdas binary, power_centre binary, power_scale binary, "
    "power_n bigint, power_mean binary, power_m2 binary, power_jac binary"
)


def _packed(values) -> bytes | None:
    return None if values is None else np.asarray(values, float).tobytes()


def _unpacked(kept) -> np.ndarray | None:
    return None if kept is None else np.frombuffer(bytes(kept)).copy()


def _packed_square(m: np.ndarray | None) -> bytes | None:
    """A symmetric matrix is its upper half."""
    return None if m is None else _packed(m[np.triu_indices(len(m))] if np.array_equal(m, m.T) else m)


def _unpacked_square(kept, size: int) -> np.ndarray | None:
    values = _unpacked(kept)
    if values is None or len(values) == size * size:
        return None if values is None else values.reshape(size, size)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = values
    return np.where(np.tri(size, k=-1, dtype=bool), m.T, m)


def _load(values: tuple) -> AD.DetectorState:
    *plain, names, times, lambdas, centre, scale, n, mean, m2, jac = values
    s = AD.DetectorState(*plain, dict(zip(names, times)))
    s.mean = _unpacked(s.mean)
    s.cov = None if s.mean is None else _unpacked_square(s.cov, len(s.mean))
    s.probabilities, s.distances, s.awake = _unpacked(s.probabilities).tolist(), _unpacked(s.distances), _unpacked(s.awake)
    s.lambdas = _unpacked(lambdas)
    if centre is not None:
        centre = _unpacked(centre)
        s.power = PowerMoments(centre, _unpacked(scale), int(n), *(_unpacked(v).reshape(len(centre), -1) for v in (mean, m2)), _unpacked(jac))
    return s


def _save(s: AD.DetectorState) -> tuple:
    p = s.power
    grids = (None,) * 6 if p is None else (_packed(p.centre), _packed(p.scale), int(p.n), _packed(p.mean), _packed(p.m2), _packed(p.jac))
    return (
        _packed(s.mean), _packed_square(s.cov), int(s.n), float(s.distance_mean), float(s.distance_std), float(s.cusum_pos),
        float(s.cusum_neg), float(s.cusum_h), int(s.first_ms), int(s.last_ms), None if s.tz is None else int(s.tz), int(s.tz_until),
        _packed(s.probabilities), _packed(s.distances), _packed(s.awake), list(s.alerted), [int(t) for t in s.alerted.values()],
        _packed(s.lambdas), *grids,
    )


class Detector(Remembered):
    """The detector state of a device."""

    def __init__(self, cfg: AD.DetectorConfig, names: list[str], life_ms: int):
        self.cfg, self.names, self.life_ms = cfg, names, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.remember(handle)
        self.detector = handle.getValueState("detector", f"{_STATE}, until bigint")

    def states(self) -> list:
        return [self.detector]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = self.detector.get()
        state, until = (_load(tuple(kept)[:-1]), kept[-1]) if kept else (AD.DetectorState(), None)
        for window in sorted((r.asDict() for r in rows), key=lambda w: w["window_id"]):
            result = AD.step(state, window, self.cfg)
            told = {"device_id": key[0], "window_id": window["window_id"], "end_ms": window["end_ms"], **result}
            yield Row(**{n: told[n] for n in self.names})
        if state.mean is not None:
            self.detector.update((*_save(state), self.keep_until(until, state.last_ms)))


def detector_stream(windows: DataFrame, cfg: AD.DetectorConfig | None = None, life_ms: int = STATE_LIFE_MS, delay: str = STATE_DELAY) -> DataFrame:
    """The adaptive detector over a stream of detector inputs (see ``inputs.detector_inputs``), same step as the batch form.

    A device is forgotten ``life_ms`` of event time after its last window and starts anew if it returns. Run it within
    ``runner.keyed_state``.
    """
    cfg = cfg or AD.DetectorConfig()
    timed = AD.with_optional(windows).withColumn("event_time", F.timestamp_millis("end_ms")).withWatermark("event_time", delay)
    names = [part.strip().split()[0] for part in re.split(r",(?![^<]*>)", AD.RESULT_DDL)]
    return timed.groupBy("device_id").transformWithState(Detector(cfg, names, life_ms), AD.RESULT_DDL, "Append", "EventTime")
