"""Table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewatch.settings import CONNECTION_CATEGORICAL, CONNECTION_COLUMNS

# Every payload key any operator reads. All are parsed as text in one pass over the
# JSON and cast per use; the optimizer prunes this list to the keys a query touches.
PAYLOAD_KEYS = [
    "totalTime", "count", "latency", "interval", "duration", "velocity", "speed",
    "uid", "rxBytesDelta", "txBytesDelta", "rxBytes", "txBytes", "bytes",
    "protocol", "proto", "transport", "networkType", "dstIp", "dstPort", "port", "remotePort", "dstHost",
    "event", "status", "success", "action", "fileName", "directory",
    "lowMemory", "batteryPct", "tz_offset",
    "permission", "isSideLoaded", "packageName", "package", "targetPackage", "processName", "installerPackage",
    "domain", "host", "url", "tfliteScore", "riskScore", "category",
]
PAYLOAD_DDL = ", ".join(f"`{k}` STRING" for k in PAYLOAD_KEYS)

WIRE_EVENT_DDL = (
    "type STRING, event_type STRING, packageName STRING, package_name STRING, timestamp STRING, data STRING"
)

TELEMETRY = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("package_name", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("data", T.StringType()),
    ]
)

# Raw events of the input star schema, needed by streams (no inference on a stream).
RAW_EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

CONNECTION_DDL = ", ".join(
    f"`{c}` {'STRING' if c in CONNECTION_CATEGORICAL else 'DOUBLE'}" for c in CONNECTION_COLUMNS
) + ", label STRING, difficulty INT"
