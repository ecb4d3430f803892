"""Security rules over windows and single events, and the indicator cooldown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.functions.domains import normalise_domain, suffixes
from tidewatch.functions.ordered import ordered_scan
from tidewatch.functions.payload import num, parse_payload, text_list, truthy
from tidewatch.functions.text import fixed
from tidewatch.settings import COOLDOWN_SECONDS

MB = 1024.0 * 1024.0
_STEPS = T.StructType([T.StructField("upto", T.ArrayType(T.LongType())), T.StructField("out", T.ArrayType(T.LongType()))])


def package_candidates(fields: Sequence[str] = ("package", "packageName", "targetPackage")) -> Column:
    """Trimmed lower-case package names found in an event (needs the parsed payload ``p``)."""
    named = F.array(F.col("package_name"), *[F.col(f"p.{f}") for f in fields])
    return F.filter(F.transform(named, lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))


def domain_candidates() -> Column:
    named = F.array(*[normalise_domain(F.col(f"p.{f}")) for f in ("domain", "host", "url", "dstHost")])
    return F.filter(named, lambda v: v.isNotNull())


def rule_events(tel: DataFrame, ignored_packages: Sequence[str] = ()) -> DataFrame:
    """Event-level inputs of the rules. Events of ignored packages only are set to skip."""
    df = parse_payload(tel)
    ignored = text_list(p.lower() for p in ignored_packages)
    pkgs = package_candidates()
    kind = F.upper("event_type")
    battery = num(F.col("p.batteryPct"), -1.0)
    positive = lambda key: F.greatest(F.lit(0.0), num(F.col(f"p.{key}"), 0.0))
    delta = kind.isin("NETWORK_TRAFFIC", "NETWORK_APP")
    df = (
        df.withColumn("kind", kind)
        .withColumn("_all_pkgs", pkgs)
        .withColumn("pkgs", F.array_except("_all_pkgs", ignored))
        .withColumn("skip", (F.size("_all_pkgs") > 0) & (F.size("pkgs") == 0))
        .withColumn("doms", domain_candidates())
        .withColumn("low_memory", (kind == "SYSTEM_STATE") & truthy(F.col("p.lowMemory")))
        .withColumn("battery_critical", (kind == "SYSTEM_STATE") & (battery >= 0) & (battery <= 10))
        .withColumn(
            "net_bytes",
            F.when(delta, positive("rxBytesDelta") + positive("txBytesDelta"))
            .when(kind == "NETWORK_FLOW", positive("bytes")).otherwise(0.0),
        )
        .withColumn("is_flow", delta | (kind == "NETWORK_FLOW"))
        .withColumn("permission", F.upper(F.coalesce("p.permission", F.lit(""))))
        .withColumn("side_loaded", truthy(F.col("p.isSideLoaded")))
        .withColumn("actor", F.coalesce("p.packageName", "package_name", F.lit("unknown")))
    )
    return df.drop("_all_pkgs")


def _counters() -> list[Column]:
    counted = ~F.col("skip")
    hit = lambda c: F.count_if(counted & c)
    return [
        hit(F.col("kind") == "SECURITY_PACKAGE_EVENT").alias("package_events"),
        hit(F.col("kind") == "SECURITY_AUTH_EVENT").alias("auth_events"),
        hit(F.col("low_memory")).alias("low_memory_events"),
        hit(F.col("battery_critical")).alias("battery_critical_events"),
        hit(F.col("is_flow")).alias("flow_events"),
        (F.sum(F.when(counted, F.col("net_bytes")).otherwise(0.0)) / MB).alias("network_mb"),
    ]


def rule_counters(windows: DataFrame, ignored_packages: Sequence[str] = ()) -> DataFrame:
    """Counters per window in one partially aggregated pass; any kind of window will do."""
    return rule_events(windows, ignored_packages).groupBy("device_id", "window_id").agg(*_counters())


_CANDIDATE = (
    "struct<severity:int,rank:int,threat_type:string,message:string,confidence:double,"
    "indicator:string,target_package:string>"
)


def _candidate(when: Column, severity, rank: int, threat: str | Column, message: Column, confidence,
               indicator: Column | None = None, target: Column | None = None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None).cast("string")
    made = F.struct(
        as_col(severity).cast("int").alias("severity"), F.lit(rank).alias("rank"),
        as_col(threat).alias("threat_type"), message.alias("message"),
        as_col(confidence).cast("double").alias("confidence"),
        (none if indicator is None else indicator).alias("indicator"),
        (none if target is None else target).alias("target_package"),
    )
    return F.when(when, made).cast(_CANDIDATE)


def permission_candidate(location_confidence: float = 0.85) -> Column:
    """Rule outcome of one permission event; null when it is harmless."""
    asked, side, actor = F.col("permission"), F.col("side_loaded"), F.col("actor")
    is_perm = F.col("kind") == "PERMISSION_ACCESS"
    camera_mic = asked.isin("CAMERA", "RECORD_AUDIO")
    located = asked.isin("FINE_LOCATION", "COARSE_LOCATION")
    label = F.replace(F.lower(asked), F.lit("_"), F.lit(" "))
    indicator = F.concat_ws(":", F.lit("perm"), actor, asked)
    return F.coalesce(
        _candidate(
            is_perm & side & camera_mic, 8, 70, "INSIDER_THREAT",
            F.concat(F.lit("Side-loaded app '"), actor, F.lit("' accessed "), label, F.lit(" — potential surveillance risk")),
            0.90, indicator, actor,
        ),
        _candidate(
            is_perm & side & located, 7, 70, "DEVICE_MISUSE",
            F.concat(F.lit("Side-loaded app '"), actor, F.lit("' accessed location data")),
            location_confidence, indicator, actor,
        ),
        _candidate(
            is_perm & ~side & camera_mic, 5, 70, "DEVICE_MISUSE",
            F.concat(F.lit("Third-party app '"), actor, F.lit("' accessed "), label), 0.65,
        ),
    )


def rule_alerts(
    windows: DataFrame, bad_apps: Sequence[str] = (), bad_domains: Sequence[str] = (),
    ignored_packages: Sequence[str] = (), keys: Sequence[str] = ("device_id", "window_id"),
) -> DataFrame:
    """The winning rule per window: highest severity, the later rule on ties.

    The indicator lists are configuration and travel as literals; large feeds go through
    ``match_apps`` and ``match_domains`` instead.
    """
    apps = text_list(a.strip().lower() for a in bad_apps)
    blocked = text_list(d.strip().lower() for d in bad_domains)
    events = rule_events(windows, ignored_packages).withColumn("_candidate", permission_candidate())
    hit_app = F.array_max(F.array_intersect("pkgs", apps))
    hit_domain = F.array_max(F.filter("doms", lambda d: F.arrays_overlap(suffixes(d), blocked)))
    grouped = events.groupBy(*keys).agg(
        *_counters(),
        F.count(F.lit(1)).alias("n"),
        F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"),
        F.max(F.when(~F.col("skip"), hit_app)).alias("_app"),
        F.max(F.when(~F.col("skip"), hit_domain)).alias("_domain"),
        F.max_by("_candidate", F.when(
            F.col("_candidate").isNotNull(), F.struct("_candidate.severity", "ts_ms", "event_id")
        )).alias("_perm"),
    )
    mb, packages, auth = F.col("network_mb"), F.col("package_events"), F.col("auth_events")
    low, weak, flows = F.col("low_memory_events"), F.col("battery_critical_events"), F.col("flow_events")
    candidates = [
        _candidate(F.col("_app").isNotNull(), 9, 10, "MALWARE_MIMICRY",
                   F.concat(F.lit("Known malicious app activity detected: "), "_app"), 0.97,
                   F.concat(F.lit("app:"), "_app"), F.col("_app")),
        _candidate(F.col("_domain").isNotNull(), 8, 20, "MALWARE_MIMICRY",
                   F.concat(F.lit("Known malicious website detected: "), "_domain"), 0.94,
                   F.concat(F.lit("domain:"), "_domain")),
        _candidate(packages >= 2, F.least(F.lit(9), packages + 6), 30, "INSIDER_THREAT",
                   F.concat(packages.cast("string"), F.lit(" app package modifications detected in one analysis window")),
                   F.least(F.lit(0.95), packages * 0.05 + 0.7)),
        _candidate(auth >= 15, 7, 40, "INSIDER_THREAT",
                   F.concat(F.lit("Unusual authentication/screen churn detected ("), auth.cast("string"), F.lit(" events)")),
                   0.8),
        _candidate((mb >= 25.0) & ((low > 0) | (weak > 0)), 8, 50, "DEVICE_MISUSE",
                   F.concat(F.lit("High network burst ("), fixed(mb, 1), F.lit(" MB) during system stress (low_memory="),
                            low.cast("string"), F.lit(", battery_critical="), weak.cast("string"), F.lit(")")), 0.85),
        _candidate((flows >= 30) & (mb >= 10.0), 7, 60, "DEVICE_MISUSE",
                   F.concat(F.lit("Dense network flow burst detected ("), flows.cast("string"), F.lit(" flow events)")), 0.8),
        F.col("_perm"),
    ]
    # A generator yields the best candidate or no row; a filter would be pushed down as a copy
    # of every candidate expression.
    best = F.slice(F.sort_array(F.array_compact(F.array(*candidates)), asc=False), 1, 1)
    return grouped.select(*keys, "n", "start_ms", "end_ms", F.inline(best)).drop("rank")


def match_apps(windows: DataFrame, bad_apps: DataFrame) -> DataFrame:
    """Windows and packages found in a table of bad apps (column ``package_name``)."""
    seen = (
        parse_payload(windows).select("device_id", "window_id", F.explode(package_candidates()).alias("package_name"))
        .distinct()
    )
    bad = bad_apps.select(F.lower(F.trim("package_name")).alias("package_name")).distinct()
    return seen.join(bad, "package_name", "left_semi")


def match_domains(events: DataFrame, blocked: DataFrame) -> DataFrame:
    """Events whose domain equals a blocked one or lies below it (column ``domain``).

    Every dot suffix is compared for equality, so this is a hash join and no nested loop.
    """
    found = parse_payload(events).withColumn("domain", F.explode(F.array_distinct(domain_candidates())))
    wide = found.select(*[c for c in events.columns], "domain", F.explode(suffixes(F.col("domain"))).alias("_suffix"))
    bad = blocked.select(F.lower(F.trim("domain")).alias("blocked")).distinct()
    hits = wide.join(bad, wide["_suffix"] == bad["blocked"])
    return hits.groupBy(*events.columns, "domain").agg(F.min("blocked").alias("blocked"))


def match_dns(queries: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Queries containing any blocked token; the token list is configuration."""
    low = F.lower("domain")
    hits = F.filter(text_list(tokens), lambda t: low.contains(t))
    return queries.withColumn("blocked_by", F.array_min(hits)).filter(F.col("blocked_by").isNotNull())


def canary_alerts(tel: DataFrame) -> DataFrame:
    """Every touch of a decoy file is critical."""
    df = parse_payload(tel.filter(F.upper("event_type") == "CANARY_FILE_ACCESS"))
    name = F.coalesce("p.fileName", F.lit("unknown"))
    action = F.coalesce("p.action", F.lit("ACCESS"))
    return df.select(
        "device_id", "event_id", "ts_ms", F.lit(10).alias("severity"), F.lit("MALWARE_MIMICRY").alias("threat_type"),
        F.concat(F.lit("CRITICAL: Unauthorized "), action, F.lit(" of decoy document '"), name,
                 F.lit("' detected. Possible Ransomware/Spyware.")).alias("message"),
        F.lit(0.99).alias("confidence"), F.concat(F.lit("canary:"), name).alias("indicator"),
        F.lit(None).cast("string").alias("target_package"), F.lit("canary-manager").alias("source"),
    )


def permission_alerts(tel: DataFrame) -> DataFrame:
    """Side-loaded apps using camera, microphone or location."""
    df = rule_events(tel.filter(F.upper("event_type") == "PERMISSION_ACCESS")).filter("side_loaded")
    rule = permission_candidate(location_confidence=0.90)
    found = df.select("device_id", "event_id", "ts_ms", F.inline(F.array_compact(F.array(rule))))
    return found.select(
        "device_id", "event_id", "ts_ms", "severity", "threat_type",
        F.when(F.col("severity") == 8, F.concat(F.lit("⚠ "), "message")).otherwise(F.col("message")).alias("message"),
        "confidence", "indicator", "target_package", F.lit("permission-monitor").alias("source"),
    )


def _arrivals_to_exits(ms: np.ndarray, gap: int) -> np.ndarray:
    """Last emission of the greedy chain that starts at each event of one slab."""
    following = np.searchsorted(ms, ms + gap, side="left")
    exits = np.empty(len(ms), dtype=np.int64)
    for i in range(len(ms) - 1, -1, -1):
        exits[i] = ms[i] if following[i] >= len(ms) else exits[following[i]]
    return exits


@F.pandas_udf(_STEPS)
def slab_steps(times: pd.Series, gap: pd.Series) -> pd.DataFrame:
    """Step function of a slab: entering ready at or before ``upto`` leaves with ``out`` kept last."""
    result = []
    for ms, g in zip(times, gap):
        exits = _arrivals_to_exits(ms, int(g))
        last = np.append(exits[1:] != exits[:-1], True)
        result.append((ms[last], exits[last]))
    return pd.DataFrame(result, columns=["upto", "out"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def slab_kept(times: pd.Series, entry: pd.Series, gap: pd.Series) -> pd.Series:
    """Times kept in a slab that is entered with the given ready time."""
    result = []
    for ms, ready, g in zip(times, entry, gap):
        kept, ready = [], int(ready)
        i = int(np.searchsorted(ms, ready, side="left"))
        while i < len(ms):
            kept.append(int(ms[i]))
            i = int(np.searchsorted(ms, ms[i] + int(g), side="left"))
        result.append(kept)
    return pd.Series(result)


def greedy_cooldown(
    alerts: DataFrame, keys: Sequence[str], gap_ms: int = COOLDOWN_SECONDS * 1000,
    ts_ms: str = "ts_ms", tie: str = "event_id", slab_ms: int | None = None,
) -> DataFrame:
    """Keeps the first row of a key, then the next one at least ``gap_ms`` after the last kept.

    The chain of kept rows depends on the row before, so a busy key cannot simply be split.
    Each key is cut into slabs of time. A slab is first reduced to "entering ready at t, the
    last kept time is e", a step function with few steps; these are chained over the slabs of
    a key (bounded by the time span), which gives every slab its true entry; then all slabs
    are filtered independently. Exact. Times are distinct milliseconds, so the array of a slab has no more than ``slab_ms``
    entries (ten minutes: 600,000) however busy the key; a slab may be shorter than the gap, then it keeps one row or none.
    """
    if gap_ms <= 0:
        return alerts
    slab_ms = slab_ms or 600_000
    keys = list(keys)
    times = (
        alerts.groupBy(*keys, F.floor(F.col(ts_ms) / slab_ms).alias("_slab"))
        .agg(F.array_sort(F.collect_set(ts_ms)).alias("_times"))
    )
    steps = times.withColumn("_s", slab_steps(F.col("_times"), F.lit(gap_ms))).select(
        *keys, "_slab", F.col("_s.upto").alias("_upto"), F.col("_s.out").alias("_out"))

    def chain(state: list[int], piece: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        entry = []
        for upto, out in zip(piece["_upto"], piece["_out"]):
            entry.append(state[0])
            i = int(np.searchsorted(upto, state[0], side="left"))
            if i < len(out):
                state[0] = int(out[i]) + gap_ms
        return {"_entry": np.asarray(entry, dtype=np.int64)}

    entries = ordered_scan(
        steps, keys, ["_slab"], ["_upto", "_out"], lambda piece: [-(1 << 60)], chain, {"_entry": T.LongType()}, drop=["_upto", "_out"])
    kept = times.join(entries, [*keys, "_slab"]).select(
        *keys, F.explode(slab_kept(F.col("_times"), F.col("_entry"), F.lit(gap_ms))).alias(ts_ms)
    )
    first = Window.partitionBy(*keys, ts_ms).orderBy(tie)
    return (
        alerts.join(kept, [*keys, ts_ms], "left_semi")
        .withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select(*alerts.columns)
    )
