"""Event windows per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import carry_forward, number_rows, with_previous
from tidewatch.functions.times import DAY_MS, HOUR_MS
from tidewatch.settings import IDLE_SECONDS, WINDOW_SIZE


def count_windows(tel: DataFrame, size: int = WINDOW_SIZE, idle_ms: int | None = None) -> DataFrame:
    """Cuts each device's events into groups of ``size``; an incomplete tail is left out.

    With ``idle_ms`` a half-filled group is dropped when nothing follows within that time,
    and counting starts afresh with the next event.
    """
    numbered = number_rows(tel, ["device_id"], target="_seq", total="_total")
    if idle_ms is None:
        group = F.floor(F.col("_seq") / size)
        complete = group < F.floor(F.col("_total") / size)
        placed = numbered.withColumn("window_id", group).withColumn("pos", (F.col("_seq") % size).cast("int"))
        return placed.filter(complete).drop("_seq", "_total")
    gaps = with_previous(numbered, ["device_id"], ["ts_ms"], target="_prev")
    opens = F.col("_prev").isNull() | (F.col("ts_ms") - F.col("_prev.ts_ms") > idle_ms)
    gaps = gaps.withColumn("_open", F.when(opens, F.col("_seq"))).drop("_prev")
    runs = carry_forward(gaps, ["device_id"], "_open", "_start")
    lengths = runs.groupBy("device_id", "_start").agg(F.count(F.lit(1)).alias("_len"))
    placed = runs.join(lengths, ["device_id", "_start"])
    inside = F.col("_seq") - F.col("_start")
    return (
        placed.filter(F.floor(inside / size) < F.floor(F.col("_len") / size))
        .withColumn("window_id", F.col("_start") + F.floor(inside / size))
        .withColumn("pos", (inside % size).cast("int"))
        .drop("_seq", "_total", "_open", "_start", "_len")
    )


def time_windows(tel: DataFrame, width_ms: int) -> DataFrame:
    """Tumbling windows as the alternative to counting; ``window_id`` is the start in millis."""
    return tel.withColumn("window_id", F.floor(F.col("ts_ms") / width_ms) * width_ms)


def window_events(windows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One row per count window with its events as a sorted array.

    A count window has at most ``size`` events, so the array is small by construction. Only
    the given fields are shuffled. Not for time windows, which have no such limit.
    """
    event = F.struct("ts_ms", "event_id", *[c.alias(n) for n, c in fields.items()])
    return windows.groupBy("device_id", "window_id").agg(F.array_sort(F.collect_list(event)).alias("ev"))


def window_span(windows: DataFrame) -> DataFrame:
    """Seconds between first and last timestamp of a window; null with fewer than two."""
    seconds = F.when(F.col("ts_ms") > 1e10, F.col("ts_ms") / 1000.0).when(F.col("ts_ms") > 0, F.col("ts_ms") * 1.0)
    return windows.groupBy("device_id", "window_id").agg(
        F.when(F.count(seconds) >= 2, F.bround(F.max(seconds) - F.min(seconds), 3)).alias("span_seconds")
    )


def timezone_shifts(tel: DataFrame, offset: str = "tz_offset", active_ms: int = DAY_MS) -> DataFrame:
    """Per event with a known offset: did it change, and until when the shift stays active."""
    known = tel.filter(F.col(offset).isNotNull())
    seen = with_previous(known, ["device_id"], [offset], target="_prev")
    shifted = F.col("_prev").isNotNull() & (F.col(f"_prev.{offset}") != F.col(offset))
    marked = seen.withColumn("shifted", shifted).withColumn(
        "_until", F.when(shifted, F.col("ts_ms") + F.lit(active_ms))
    ).drop("_prev")
    return carry_forward(marked, ["device_id"], "_until", "shift_until_ms").drop("_until")


def idle_gaps(tel: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Gap to the device's previous activity; long gaps suspend learning."""
    seen = with_previous(tel, ["device_id"], ["ts_ms"], target="_prev")
    gap = F.col("ts_ms") - F.col("_prev.ts_ms")
    return (
        seen.withColumn("gap_ms", gap)
        .withColumn("learning_suspended", F.coalesce(gap > idle_seconds * 1000, F.lit(False)))
        .drop("_prev")
    )


def counter_deltas(samples: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Growth of running counters since the previous sample of the key, never negative.

    The first sample of a key and samples without any growth are left out.
    """
    seen = with_previous(samples, keys, counters, target="_prev").filter(F.col("_prev").isNotNull())
    out = seen
    for name in counters:
        out = out.withColumn(f"{name}_delta", F.greatest(F.lit(0), F.col(name) - F.col(f"_prev.{name}")))
    grew = F.lit(False)
    for name in counters:
        grew = grew | (F.col(f"{name}_delta") > 0)
    return out.filter(grew).drop("_prev")


def keystroke_batches(keys_pressed: DataFrame, batch: int = 20, low_ms: int = 10, high_ms: int = 5000) -> DataFrame:
    """Mean, deviation and count over every ``batch`` plausible intervals between key presses."""
    gaps = with_previous(keys_pressed, ["device_id"], ["ts_ms"], target="_prev")
    gaps = gaps.withColumn("interval_ms", F.col("ts_ms") - F.col("_prev.ts_ms")).drop("_prev")
    valid = gaps.filter(F.col("interval_ms").between(low_ms, high_ms))
    numbered = number_rows(valid, ["device_id"], target="_seq", total="_total")
    group = F.floor(F.col("_seq") / batch)
    return (
        numbered.withColumn("batch_id", group).filter(group < F.floor(F.col("_total") / batch))
        .groupBy("device_id", "batch_id")
        .agg(
            F.avg("interval_ms").alias("latency"),
            F.stddev_pop("interval_ms").alias("std"),
            F.count(F.lit(1)).alias("n"),
            F.max("ts_ms").alias("ts_ms"),
        )
    )


def touch_gaps(touches: DataFrame, low_ms: int = 10, high_ms: int = 10_000) -> DataFrame:
    gaps = with_previous(touches, ["device_id"], ["ts_ms"], target="_prev")
    gaps = gaps.withColumn("duration_ms", F.col("ts_ms") - F.col("_prev.ts_ms")).drop("_prev")
    return gaps.filter(F.col("duration_ms").between(low_ms, high_ms))


def flow_totals(packets: DataFrame, flush_ms: int = 10_000) -> DataFrame:
    """Packets and bytes per flush interval and (protocol, destination, port)."""
    return (
        packets.withColumn("flush_ms", F.floor(F.col("ts_ms") / flush_ms) * flush_ms)
        .groupBy("device_id", "flush_ms", "protocol", "dst_ip", "dst_port")
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("bytes").alias("bytes"),
            F.min_by("src_ip", F.struct("ts_ms", "event_id")).alias("src_ip"),
        )
    )

