"""Reads the star-schema tables as device telemetry (the mapping is in FIXTURES.md)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = [
    "google.com", "paypal-secure-login-update.tk", "faceb00k.com", "example.com", "login.phishing.test",
    "amazon-account.xyz", "a.b.c.d.e.example.org", "secure123-login.com", "mail.google.com",
    "free-prize-winner.buzz",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz_to_millis(ts: Column) -> Column:
    """Epoch millis of a wall-clock timestamp, independent of the session time zone."""
    # The cast reads the wall clock in the session zone; the shift back by the same zone undoes it.
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _json(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def to_telemetry(events: DataFrame) -> DataFrame:
    """Raw events -> device telemetry. Projection only, so it works on a stream as well."""
    events = events.select(
        "event_id", "user_id", "event_type", "ts",
        F.get_json_object("props", "$.k").cast("long").alias("_k"), F.floor("value").cast("long").alias("_v"),
    )
    k, v, e = F.col("_k"), F.col("_v"), F.col("event_type")
    app = F.concat(F.lit("com.app"), (k % 12).cast("string"))

    kinds = [
        # (condition, event type, package, payload)
        (e == "view", "APP_USAGE", app, _json('{"totalTime":', v, ',"count":1}')),
        ((e == "click") & (k < 34), "KEYSTROKE", app, _json('{"latency":', v, "}")),
        ((e == "click") & (k < 67), "TOUCH", app, _json('{"duration":', v, "}")),
        (e == "click", "SWIPE", app, _json('{"velocity":', v, "}")),
        ((e == "purchase") & (k < 60), "NETWORK_APP", app,
         _json('{"uid":', 10000 + k % 12, ',"rxBytesDelta":', v * 65536, ',"txBytesDelta":', k * 16384, "}")),
        ((e == "purchase") & (k < 80), "NETWORK_TRAFFIC", None,
         _json('{"rxBytesDelta":', v * 65536, ',"txBytesDelta":', k * 16384, "}")),
        (e == "purchase", "NETWORK_FLOW", None,
         _json('{"protocol":"', _pick(k % 2, ["TCP", "UDP"]), '","dstIp":"10.0.0.', k % 8,
               '","dstPort":', _pick(k % 4, ["53", "80", "443", "8080"]), ',"bytes":', v * 131072, "}")),
        ((e == "error") & (k < 50), "SECURITY_AUTH_EVENT", None,
         _json('{"event":"', _pick(k % 4, ["USER_PRESENT", "SCREEN_ON", "SCREEN_OFF", "AUTH_FAIL"]), '"}')),
        ((e == "error") & (k < 80), "SECURITY_PACKAGE_EVENT", app,
         _json('{"action":"', _pick(k % 3, ["PACKAGE_ADDED", "PACKAGE_REMOVED", "PACKAGE_REPLACED"]), '"}')),
        (e == "error", "CANARY_FILE_ACCESS", F.lit("system_level"),
         _json('{"fileName":"f', k, '.pdf","action":"', _pick(k % 3, ["MODIFY", "DELETE", "OPEN"]), '"}')),
        ((e == "signup") & (k < 40), "SYSTEM_STATE", None,
         _json('{"lowMemory":', (k < 5), ',"batteryPct":', k, ',"tz_offset":', (k % 3) * 3600000, "}")),
        ((e == "signup") & (k < 60), "PERMISSION_ACCESS", app,
         _json('{"permission":"', _pick(k % 4, ["CAMERA", "RECORD_AUDIO", "FINE_LOCATION", "COARSE_LOCATION"]),
               '","isSideLoaded":', (k < 50), ',"packageName":"', app, '"}')),
        ((e == "signup") & (k < 90), "WEB_DOMAIN", F.lit("com.android.chrome"),
         _json('{"domain":"', _pick(k % 10, DOMAINS), '"}')),
        (e == "signup", "SYSTEM_LOGCAT_ACCESS", None,
         _json('{"status":"', _pick(k % 2, ["restricted", "available"]), '"}')),
    ]

    def case(position: int) -> Column:
        out = None
        for row in kinds:
            value = row[position]
            if value is None or isinstance(value, str):
                value = F.lit(value)
            out = F.when(row[0], value) if out is None else out.when(row[0], value)
        return out

    return events.select(
        F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_id"),
        "event_id",
        case(1).cast("string").alias("event_type"),
        case(2).cast("string").alias("package_name"),
        ntz_to_millis(F.col("ts")).alias("ts_ms"),
        case(3).cast("string").alias("data"),
    )


def telemetry(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """All events, or those from ``since_ms`` on; the bound is on the stored column, so it reaches the scan."""
    events = table(spark, sf_dir, "events")
    if since_ms is not None:
        since = datetime.fromtimestamp(since_ms / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        events = events.filter(F.col("ts") >= F.lit(since).cast(events.schema["ts"].dataType))
    return to_telemetry(events)


def alert_view(tel: DataFrame) -> DataFrame:
    """Security-relevant telemetry read as a stored alert table, one alert per event."""
    kind, row_id = F.col("event_type"), F.col("event_id")
    domain = F.get_json_object("data", "$.domain")
    side = F.get_json_object("data", "$.isSideLoaded") == "true"
    bad = domain.isin("login.phishing.test", "free-prize-winner.buzz")
    picked = tel.filter(kind.isin(
        "CANARY_FILE_ACCESS", "PERMISSION_ACCESS", "SECURITY_PACKAGE_EVENT", "SECURITY_AUTH_EVENT", "WEB_DOMAIN",
        "NETWORK_FLOW",
    ))
    return picked.select(
        F.concat(F.lit("alt_"), row_id.cast("string")).alias("anomaly_id"),
        "device_id",
        row_id.alias("alert_seq"),
        F.when(kind == "CANARY_FILE_ACCESS", 10).when(kind == "PERMISSION_ACCESS", F.when(side, 8).otherwise(5))
        .when(kind == "SECURITY_PACKAGE_EVENT", 7).when(kind == "SECURITY_AUTH_EVENT", 4)
        .when(kind == "WEB_DOMAIN", F.when(bad, 9).otherwise(6)).otherwise(3).alias("severity"),
        F.when(kind == "CANARY_FILE_ACCESS", "MALWARE_MIMICRY")
        .when(kind.isin("PERMISSION_ACCESS", "SECURITY_PACKAGE_EVENT"), "INSIDER_THREAT")
        .when(kind == "SECURITY_AUTH_EVENT", "DEVICE_MISUSE")
        .when(kind == "WEB_DOMAIN", F.when(row_id % 2 == 0, "PHISHING").otherwise("MALWARE_MIMICRY"))
        .otherwise("USER_DRIFT").alias("threat_type"),
        F.when(kind == "PERMISSION_ACCESS", F.when(row_id % 2 == 0, F.concat(F.lit("perm:"), "package_name")))
        .when(kind == "SECURITY_PACKAGE_EVENT", F.when(row_id % 2 == 0, F.concat(F.lit("app:"), "package_name")))
        .when(kind == "WEB_DOMAIN", F.when(row_id % 3 == 0, F.concat(F.lit("domain:"), domain))
              .when(row_id % 3 == 1, F.concat(F.lit("phishing:"), domain))).alias("indicator"),
        F.when(kind == "WEB_DOMAIN", F.concat(F.lit("Known malicious website detected: "), domain))
        .when(kind == "SECURITY_PACKAGE_EVENT", F.concat(F.lit("Known malicious app activity detected: "), "package_name"))
        .when(kind == "PERMISSION_ACCESS", F.lower(F.concat(F.lit("Permission use: "), F.get_json_object("data", "$.permission"))))
        .otherwise(kind).alias("message"),
        ((row_id % 50 + 50) / 100.0).alias("confidence"),
        _pick(row_id % 4, ["pending", "approved", "denied", "normal"]).alias("status"),
        F.col("ts_ms").alias("created_ms"),
    )


def alerts(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    return alert_view(telemetry(spark, sf_dir, since_ms))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as log lines of one text each; every 50th names the next log buffer."""
    d, row_id = table(spark, sf_dir, "documents"), F.col("doc_id")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    line = F.concat(
        pad(row_id % 12 + 1, 2), F.lit("-"), pad(row_id % 28 + 1, 2), F.lit(" "),
        pad(row_id % 24, 2), F.lit(":"), pad(row_id % 60, 2), F.lit(":"), pad(F.floor(row_id / 60) % 60, 2), F.lit("."),
        pad(row_id % 1000, 3), F.lit(" "), (row_id % 5000 + 1).cast("string"), F.lit(" "),
        (row_id % 300 + 1).cast("string"), F.lit(" "), _pick(row_id % 7, list("VDIWEFA")), F.lit(" "),
        F.when(row_id % 11 == 0, "auditd").when(row_id % 13 == 0, "thermal").otherwise(F.col("source")),
        F.lit(": "), flat,
    )
    marker = F.concat(F.lit("--------- beginning of "), _pick(F.floor(row_id / 50) % 3, ["main", "system", "crash"]))
    odd = F.concat(F.lit("raw "), flat)
    return d.select(
        F.lit("device.log").alias("file"), row_id.alias("line_no"),
        F.when(row_id % 50 == 25, marker).when(row_id % 17 == 5, odd).otherwise(line).alias("line"),
    )
