"""The 72-dimension behaviour vector of a window and its mask.

A count window holds a handful of events, so they travel as one small sorted array per
window (a single shuffle) and every feature is an array expression over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.payload import num, parse_payload, truthy
from tidewatch.operators.windows import window_events
from tidewatch.settings import TOP_APPS


def feature_fields() -> dict[str, Column]:
    """What the features need of each event; ``p`` is the parsed payload."""
    kind = F.upper("event_type")
    battery = num(F.col("p.batteryPct"), -1.0)
    traffic = F.greatest(F.lit(0.0), num(F.col("p.rxBytesDelta"), 0.0)) + F.greatest(
        F.lit(0.0), num(F.col("p.txBytesDelta"), 0.0)
    )
    measure = (
        F.when(kind == "KEYSTROKE", num(F.coalesce("p.latency", "p.interval")))
        .when(kind == "TOUCH", num(F.col("p.duration")))
        .when(kind == "SWIPE", num(F.coalesce("p.velocity", "p.speed")))
        .when(kind.isin("NETWORK_TRAFFIC", "NETWORK_APP"), traffic)
    )
    state = kind == "SYSTEM_STATE"
    return {
        "kind": kind,
        "pkg": F.when(kind == "APP_USAGE", F.col("package_name")),
        "v": measure,
        "tz": F.when(state, F.col("p.tz_offset").try_cast("long")),
        "low": F.coalesce(state & truthy(F.col("p.lowMemory")), F.lit(False)),
        "weak": state & (battery >= 0) & (battery <= 15),
        "restricted": F.coalesce(
            (kind == "SYSTEM_LOGCAT_ACCESS") & F.lower("p.status").isin("restricted", "error"), F.lit(False)
        ),
    }


def feature_windows(windows: DataFrame) -> DataFrame:
    return window_events(parse_payload(windows), feature_fields())


def _add(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns in one projection; each may use the ones named before it."""
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in columns.items()])


def temporal(df: DataFrame) -> DataFrame:
    """Adds ``f_hours``: share of events per local hour (24 values)."""
    return _add(
        df,
        _tz="coalesce(get(filter(transform(ev, e -> e.tz), t -> t IS NOT NULL), 0), 0L)",
        _hours="transform(filter(ev, e -> e.ts_ms > 0), e -> pmod(floor((e.ts_ms + _tz) / 3600000), 24L))",
        f_hours="transform(sequence(0, 23), h -> IF(size(_hours) = 0, 0D, size(filter(_hours, x -> x = h)) / size(_hours)))",
    )


def transitions(df: DataFrame) -> DataFrame:
    """Adds ``_apps`` (in order), ``_top`` (most used first) and ``_pairs`` of consecutive top apps."""
    return _add(
        df,
        _apps="transform(filter(ev, e -> e.pkg IS NOT NULL AND e.pkg <> ''), e -> e.pkg)",
        _ranked=(
            "slice(array_sort(transform(array_distinct(_apps), (a, i) -> "
            f"struct(-size(filter(_apps, x -> x = a)) AS minus_n, i AS first_seen, a AS app))), 1, {TOP_APPS})"
        ),
        _top="transform(_ranked, r -> r.app)",
        _pairs=(
            "filter(zip_with(slice(_apps, 1, greatest(size(_apps) - 1, 0)), slice(_apps, 2, greatest(size(_apps) - 1, 0)), "
            "(s, d) -> struct(s AS src, d AS dst)), t -> array_contains(_top, t.src) AND array_contains(_top, t.dst))"
        ),
    )


def sequential(df: DataFrame) -> DataFrame:
    """Adds ``f_freq`` (10), ``f_entropy`` (10) and ``f_transitions`` (8)."""
    last = TOP_APPS - 1
    return _add(
        transitions(df),
        f_freq=f"transform(sequence(0, {last}), i -> coalesce(-get(_ranked, i).minus_n / size(_apps), 0D))",
        _outs="transform(_top, a -> transform(filter(_pairs, t -> t.src = a), t -> t.dst))",
        f_entropy=(
            f"transform(sequence(0, {last}), i -> coalesce(aggregate(array_distinct(get(_outs, i)), 0D, (acc, d) -> "
            "acc - size(filter(get(_outs, i), x -> x = d)) / size(get(_outs, i)) * "
            "log2(size(filter(get(_outs, i), x -> x = d)) / size(get(_outs, i)))), 0D))"
        ),
        _srcs="array_distinct(transform(_pairs, t -> t.src))",
        _best=(
            "slice(array_sort(transform(array_distinct(_pairs), (t, i) -> struct(-size(filter(_pairs, x -> x = t)) AS minus_n, "
            "array_position(_srcs, t.src) AS src_seen, i AS seen, t.src AS src))), 1, 4)"
        ),
        f_transitions=(
            "flatten(transform(sequence(0, 3), i -> array("
            f"coalesce((array_position(_top, get(_best, i).src) - 1) / {TOP_APPS}D, 0D), "
            "coalesce(-get(_best, i).minus_n / size(_pairs), 0D))))"
        ),
    )


def _stats(values: str, mean: str) -> str:
    return (
        f"IF(size({values}) = 0, array_repeat(0D, 5), array({mean}, "
        f"sqrt(aggregate({values}, 0D, (a, x) -> a + (x - {mean}) * (x - {mean})) / size({values})), "
        f"array_min({values}), array_max({values}), least(size({values}) / 100D, 1D)))"
    )


def burstiness(df: DataFrame) -> DataFrame:
    """Adds ``f_burst``: deviation over mean of the gaps between events."""
    return _add(
        df,
        _ts="transform(filter(ev, e -> e.ts_ms <> 0), e -> e.ts_ms)",
        _gaps="zip_with(slice(_ts, 2, greatest(size(_ts) - 1, 0)), slice(_ts, 1, greatest(size(_ts) - 1, 0)), (b, a) -> CAST(b - a AS DOUBLE))",
        _gap_mean="IF(size(_gaps) = 0, 0D, aggregate(_gaps, 0D, (a, x) -> a + x) / size(_gaps))",
        f_burst=(
            "IF(_gap_mean = 0, 0D, sqrt(aggregate(_gaps, 0D, (a, x) -> a + (x - _gap_mean) * (x - _gap_mean)) "
            "/ size(_gaps)) / _gap_mean)"
        ),
    )


def interaction(df: DataFrame) -> DataFrame:
    """Adds ``f_keys``, ``f_touch``, ``f_swipe`` (5 each) and ``f_combined`` (5)."""
    df = burstiness(df)
    timed: dict[str, str] = {}
    for name, kind in (("keys", "KEYSTROKE"), ("touch", "TOUCH"), ("swipe", "SWIPE")):
        timed[f"_v_{name}"] = f"transform(filter(ev, e -> e.kind = '{kind}' AND e.v IS NOT NULL), e -> e.v)"
        timed[f"_m_{name}"] = f"IF(size(_v_{name}) = 0, 0D, aggregate(_v_{name}, 0D, (a, x) -> a + x) / size(_v_{name}))"
        timed[f"f_{name}"] = _stats(f"_v_{name}", f"_m_{name}")
    return _add(
        df,
        **timed,
        _n="greatest(size(ev), 1)",
        _net="transform(filter(ev, e -> e.kind IN ('NETWORK_TRAFFIC', 'NETWORK_APP')), e -> e.v)",
        _net_signal="least(1D, size(_net) / _n + least(aggregate(_net, 0D, (a, x) -> a + x) / 1048576D / 10D, 1D) * 0.5D)",
        _states="size(filter(ev, e -> e.kind = 'SYSTEM_STATE'))",
        _logcat="size(filter(ev, e -> e.kind = 'SYSTEM_LOGCAT_ACCESS'))",
        _sys_signal=(
            "greatest(size(filter(ev, e -> startswith(e.kind, 'SYSTEM_'))) / _n, "
            "(size(filter(ev, e -> e.low)) + size(filter(ev, e -> e.weak))) / greatest(_states * 2, 1), "
            "size(filter(ev, e -> e.restricted)) / greatest(_states + _logcat, 1))"
        ),
        f_combined=(
            "array(least(_n / 500D, 1D), (size(_v_keys) + size(_v_touch) + size(_v_swipe)) / _n, _net_signal, "
            "size(filter(ev, e -> startswith(e.kind, 'SECURITY_'))) / _n, greatest(f_burst, _sys_signal))"
        ),
    )


def mask(df: DataFrame) -> DataFrame:
    """Adds ``mask``: 1 where the group of a dimension had data (after the feature functions)."""
    return _add(
        df,
        mask=(
            "concat(array_repeat(IF(size(_hours) > 0, 1D, 0D), 24), array_repeat(IF(size(_apps) > 0, 1D, 0D), 28), "
            "array_repeat(IF(size(_v_keys) > 0, 1D, 0D), 5), array_repeat(IF(size(_v_touch) > 0, 1D, 0D), 5), "
            "array_repeat(IF(size(_v_swipe) > 0, 1D, 0D), 5), array_repeat(IF(size(ev) > 0, 1D, 0D), 5))"
        ),
    )


def feature_groups(windows: DataFrame) -> DataFrame:
    return mask(interaction(sequential(temporal(feature_windows(windows)))))


def feature_vectors(windows: DataFrame) -> DataFrame:
    """device_id, window_id, start_ms, end_ms, n, vector (72), mask (72)."""
    return feature_groups(windows).select(
        "device_id",
        "window_id",
        F.expr("ev[0].ts_ms").alias("start_ms"),
        F.expr("element_at(ev, -1).ts_ms").alias("end_ms"),
        F.size("ev").alias("n"),
        F.concat(
            "f_hours", "f_freq", "f_entropy", "f_transitions", "f_keys", "f_touch", "f_swipe", "f_combined"
        ).alias("vector"),
        "mask",
    )
