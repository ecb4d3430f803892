"""Windows, features and window-level aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.payload import num, parse_payload
from tidewatch.operators import aggregates as A
from tidewatch.operators import features as X
from tidewatch.operators import windows as W
from tidewatch.plans.common import FEAT, TEL, WIN, feature_slice, millionths, with_ctes
from tidewatch.plans.registry import query
from tidewatch.sources.telemetry import telemetry


def windows(spark, sf_dir):
    return W.count_windows(telemetry(spark, sf_dir))


@query("w1_count_windows", with_ctes(WIN, "SELECT device_id, window_id, pos::INTEGER AS pos, event_id FROM win"))
def w1(spark, sf_dir):
    return windows(spark, sf_dir).select("device_id", "window_id", "pos", "event_id")


@query("w1_idle_windows", with_ctes(TEL, """,
o AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w <= 36000000 THEN 0 ELSE 1 END AS opens FROM tel WINDOW w AS (PARTITION BY device_id ORDER BY ts_ms, event_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS run FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id, run ORDER BY ts_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY device_id, run) AS len FROM r)
SELECT device_id, event_id, (i % 3)::INTEGER AS pos FROM n WHERE i // 3 < len // 3"""))
def w1_idle(spark, sf_dir):
    out = W.count_windows(telemetry(spark, sf_dir), size=3, idle_ms=36_000_000)
    return out.select("device_id", "event_id", "pos")


def _vec(spark, sf_dir, step, *columns):
    df = step(X.feature_windows(windows(spark, sf_dir)))
    return df.select("device_id", "window_id", millionths(f"concat({', '.join(columns)})").alias("vec"))


@query("a1_hour_histogram", with_ctes(FEAT, feature_slice(0, 24)))
def a1(spark, sf_dir):
    return _vec(spark, sf_dir, X.temporal, "f_hours")


@query("a2_app_frequency", with_ctes(FEAT, feature_slice(24, 34)))
def a2(spark, sf_dir):
    return _vec(spark, sf_dir, X.sequential, "f_freq")


@query("w2_app_transitions", with_ctes(FEAT, "SELECT device_id, window_id, s AS src, d AS dst, c::BIGINT AS n FROM pc"))
def w2(spark, sf_dir):
    return A.app_transitions(windows(spark, sf_dir))


@query("w3_transition_entropy", with_ctes(FEAT, feature_slice(34, 44)))
def w3(spark, sf_dir):
    return _vec(spark, sf_dir, X.sequential, "f_entropy")


@query("w4_top_transitions", with_ctes(FEAT, feature_slice(44, 52)))
def w4(spark, sf_dir):
    return _vec(spark, sf_dir, X.sequential, "f_transitions")


@query("a3_timing_stats", with_ctes(FEAT, feature_slice(52, 67)))
def a3(spark, sf_dir):
    return _vec(spark, sf_dir, X.interaction, "f_keys", "f_touch", "f_swipe")


@query("a4_combined_signals", with_ctes(FEAT, feature_slice(67, 72)))
def a4(spark, sf_dir):
    return _vec(spark, sf_dir, X.interaction, "f_combined")


@query("w5_burstiness", with_ctes(FEAT, "SELECT device_id, window_id, round(burst, 6) AS burst FROM comb5"))
def w5(spark, sf_dir):
    df = X.burstiness(X.feature_windows(windows(spark, sf_dir)))
    return df.select("device_id", "window_id", F.round("f_burst", 6).alias("burst"))


@query("a5_group_mask", with_ctes(FEAT, "SELECT device_id, window_id, string_agg(m::VARCHAR, '' ORDER BY dim) AS mask FROM msk GROUP BY ALL"))
def a5(spark, sf_dir):
    df = X.feature_groups(windows(spark, sf_dir))
    return df.select("device_id", "window_id", F.array_join(F.expr("transform(mask, m -> CAST(m AS INT))"), "").alias("mask"))


@query("d0_feature_vector", with_ctes(FEAT, f"""
SELECT v.device_id, v.window_id, vec, mask, start_ms, end_ms, n FROM ({feature_slice(0, 72)}) v
JOIN (SELECT device_id, window_id, string_agg(m::VARCHAR, '' ORDER BY dim) AS mask FROM msk GROUP BY ALL) m USING (device_id, window_id)
JOIN (SELECT device_id, window_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*)::INTEGER AS n FROM win GROUP BY ALL) w USING (device_id, window_id)"""))
def d0(spark, sf_dir):
    return X.feature_vectors(windows(spark, sf_dir)).select(
        "device_id", "window_id", "start_ms", "end_ms", "n", millionths("vector").alias("vec"),
        F.array_join(F.expr("transform(mask, m -> CAST(m AS INT))"), "").alias("mask"),
    )


@query("a7_top_event_types", with_ctes(WIN, """,
c AS (SELECT device_id, window_id, event_type, count(*) AS n, min(pos) AS seen FROM win GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY device_id, window_id ORDER BY n DESC, seen) AS rk FROM c)
SELECT device_id, window_id, string_agg(event_type || ' x' || n, ', ' ORDER BY rk) AS top FROM r WHERE rk <= 3 GROUP BY ALL"""))
def a7(spark, sf_dir):
    return A.top_event_types(windows(spark, sf_dir), 3).select(
        "device_id", "window_id",
        F.array_join(F.expr("transform(top_event_types, t -> concat(t.event_type, ' x', t.n))"), ", ").alias("top"),
    )


_PKG = """,
c AS (SELECT device_id, window_id, event_id, pos, unnest([(0, package_name), (1, data->>'$.package'), (2, data->>'$.packageName'),
        (3, data->>'$.targetPackage'), (4, data->>'$.processName')]) AS t FROM win),
p AS (SELECT device_id, window_id, lower(trim(t[2])) AS pkg, pos * 10 + t[1] AS seen FROM c WHERE trim(t[2]) <> '' AND lower(trim(t[2])) <> 'com.app7'),
g AS (SELECT device_id, window_id, pkg, count(*) AS n, min(seen) AS seen FROM p GROUP BY ALL),
dom AS (SELECT device_id, window_id, pkg, row_number() OVER (PARTITION BY device_id, window_id ORDER BY n DESC, seen) AS rk FROM g)"""


@query("a8_dominant_package", with_ctes(WIN + _PKG, "SELECT device_id, window_id, pkg AS dominant_package FROM dom WHERE rk = 1"))
def a8(spark, sf_dir):
    return A.action_targets(windows(spark, sf_dir), ["com.app7"]).filter("target_package IS NOT NULL").select(
        "device_id", "window_id", F.col("target_package").alias("dominant_package")
    )


@query("a9_action_targets", with_ctes(WIN + _PKG, """,
u AS (SELECT device_id, window_id, CAST(data->>'$.uid' AS BIGINT) AS uid, pos,
        greatest(0, CAST(data->>'$.rxBytesDelta' AS DOUBLE)) + greatest(0, CAST(data->>'$.txBytesDelta' AS DOUBLE)) AS b
      FROM win WHERE event_type = 'NETWORK_APP'),
us AS (SELECT device_id, window_id, uid, sum(CASE WHEN b > 0 THEN b ELSE 1 END) AS score, min(pos) AS seen FROM u GROUP BY ALL),
ur AS (SELECT device_id, window_id, uid, row_number() OVER (PARTITION BY device_id, window_id ORDER BY score DESC, seen) AS rk FROM us)
SELECT w.device_id, w.window_id, dom.pkg AS target_package, ur.uid AS target_uid
FROM (SELECT DISTINCT device_id, window_id FROM win) w
LEFT JOIN dom ON dom.device_id = w.device_id AND dom.window_id = w.window_id AND dom.rk = 1
LEFT JOIN ur ON ur.device_id = w.device_id AND ur.window_id = w.window_id AND ur.rk = 1"""))
def a9(spark, sf_dir):
    return A.action_targets(windows(spark, sf_dir), ["com.app7"])


@query("a10_window_span", with_ctes(WIN, """
SELECT device_id, window_id, round((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE, 3) AS span_seconds FROM win GROUP BY ALL"""))
def a10(spark, sf_dir):
    return W.window_span(windows(spark, sf_dir))


_CONN = """,
e AS (SELECT *, event_type AS kind, coalesce(try_cast(data->>'$.rxBytesDelta' AS DOUBLE), 0) AS rx,
        coalesce(try_cast(data->>'$.txBytesDelta' AS DOUBLE), 0) AS tx, coalesce(try_cast(data->>'$.bytes' AS DOUBLE), 0) AS fb,
        event_type IN ('NETWORK_TRAFFIC','NETWORK_APP','NETWORK_FLOW') AS net FROM win),
g AS (SELECT device_id, window_id, count(*)::DOUBLE AS n, count(*) FILTER (net)::DOUBLE AS net,
  sum(CASE WHEN net THEN tx + fb / 2 ELSE 0 END) AS src_bytes, sum(CASE WHEN net THEN rx + fb / 2 ELSE 0 END) AS dst_bytes,
  count(*) FILTER (kind IN ('SECURITY_PACKAGE_EVENT','SECURITY_AUTH_EVENT','PERMISSION_ACCESS','CANARY_FILE_ACCESS','WEB_DOMAIN'))::DOUBLE AS sec,
  count(*) FILTER (kind = 'SECURITY_AUTH_EVENT')::DOUBLE AS fails,
  count(*) FILTER (kind = 'CANARY_FILE_ACCESS')::DOUBLE AS files,
  count(DISTINCT package_name)::DOUBLE AS pkgs,
  lower(coalesce(arg_min(data->>'$.protocol', pos) FILTER (data->>'$.protocol' IS NOT NULL), 'tcp')) AS protocol_type,
  CASE WHEN bool_or(kind = 'WEB_DOMAIN' OR coalesce(data->>'$.dstPort' IN ('80','443','8080'), false)) THEN 'http'
       WHEN bool_or(coalesce(data->>'$.dstPort' = '53', false)) THEN 'domain_u'
       WHEN bool_or(kind IN ('PERMISSION_ACCESS','SECURITY_PACKAGE_EVENT','CANARY_FILE_ACCESS')) THEN 'private' ELSE 'other' END AS service,
  (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS duration FROM e GROUP BY ALL)"""


@query("a11_connection_row", with_ctes(WIN + _CONN, """
SELECT device_id, window_id, round(duration, 4) AS duration, protocol_type, service, CASE WHEN fails > 0 THEN 'REJ' ELSE 'SF' END AS flag,
  round(src_bytes, 4) AS src_bytes, round(dst_bytes, 4) AS dst_bytes, sec AS hot, fails AS num_failed_logins, 0::DOUBLE AS logged_in,
  files AS num_access_files, 0::DOUBLE AS num_file_creations, n AS "count", net AS srv_count, round(sec / n, 6) AS serror_rate,
  round(least(sec / greatest(net, 1), 1), 6) AS srv_serror_rate, round(fails / n, 6) AS rerror_rate,
  round(least(fails / greatest(net, 1), 1), 6) AS srv_rerror_rate, round(net / n, 6) AS same_srv_rate, round(1 - net / n, 6) AS diff_srv_rate,
  round(least(pkgs / greatest(net, 1), 1), 6) AS srv_diff_host_rate, pkgs AS dst_host_count,
  round(CASE WHEN net + sec > 0 THEN net / (net + sec) ELSE 0 END, 6) AS dst_host_same_src_port_rate,
  round(pkgs / n, 6) AS dst_host_srv_diff_host_rate, 41 AS columns FROM g"""))
def a11(spark, sf_dir):
    rows = A.connection_rows(windows(spark, sf_dir))
    rates = [c for c in rows.columns if c.endswith("_rate")]
    shown = ["duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "hot", "num_failed_logins", "logged_in",
             "num_access_files", "num_file_creations", "count", "srv_count", "dst_host_count"]
    keep = ["serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
            "srv_diff_host_rate", "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate"]
    return rows.select("device_id", "window_id", *shown, *[F.round(c, 6).alias(c) for c in rates if c in keep],
                       F.lit(len(rows.columns) - 2).alias("columns"))


@query("a12_text_samples", with_ctes(WIN, """
SELECT device_id, window_id, event_id, concat_ws(' ', event_type, 'pkg=' || package_name,
  'permission=' || (data->>'$.permission'), 'domain=' || (data->>'$.domain'), 'action=' || (data->>'$.action'), 'uid=' || (data->>'$.uid'),
  'rxBytesDelta=' || (data->>'$.rxBytesDelta'), 'txBytesDelta=' || (data->>'$.txBytesDelta'), 'dstPort=' || (data->>'$.dstPort'),
  'isSideLoaded=' || CASE data->>'$.isSideLoaded' WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END) AS sample FROM win"""))
def a12(spark, sf_dir):
    return A.text_samples(windows(spark, sf_dir)).select("device_id", "window_id", "event_id", "sample")


@query("w11_counter_deltas", with_ctes(TEL, """,
s AS (SELECT device_id, event_id, ts_ms, CAST(data->>'$.uid' AS BIGINT) AS uid, CAST(data->>'$.rxBytesDelta' AS BIGINT) AS rx,
        CAST(data->>'$.txBytesDelta' AS BIGINT) AS tx FROM tel WHERE event_type = 'NETWORK_APP'),
d AS (SELECT *, rx - lag(rx) OVER w AS drx, tx - lag(tx) OVER w AS dtx FROM s WINDOW w AS (PARTITION BY device_id, uid ORDER BY ts_ms, event_id))
SELECT device_id, uid, event_id, greatest(0, drx) AS rx_delta, greatest(0, dtx) AS tx_delta FROM d WHERE drx > 0 OR dtx > 0"""))
def w11(spark, sf_dir):
    p = parse_payload(telemetry(spark, sf_dir).filter("event_type = 'NETWORK_APP'"))
    samples = p.select("device_id", "event_id", "ts_ms", *[
        F.col(f"p.{k}").try_cast("long").alias(n) for k, n in (("uid", "uid"), ("rxBytesDelta", "rx"), ("txBytesDelta", "tx"))
    ])
    return W.counter_deltas(samples, ["device_id", "uid"], ["rx", "tx"]).select("device_id", "uid", "event_id", "rx_delta", "tx_delta")


# Keystrokes are days apart here, so the plausible range of an interval is in those units, and a batch holds five.
@query("w12_keystroke_batches", with_ctes(TEL, """,
g AS (SELECT device_id, event_id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS gap FROM tel WHERE event_type = 'KEYSTROKE'),
v AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n
      FROM g WHERE gap BETWEEN 60000 AND 900000000)
SELECT device_id, i // 5 AS batch_id, round(avg(gap), 3) AS latency, round(stddev_pop(gap), 3) AS std, count(*) AS n, max(ts_ms) AS ts_ms
FROM v WHERE i // 5 < n // 5 GROUP BY ALL"""))
def w12(spark, sf_dir):
    keys = telemetry(spark, sf_dir).filter("event_type = 'KEYSTROKE'")
    out = W.keystroke_batches(keys, 5, 60_000, 900_000_000)
    return out.select("device_id", "batch_id", F.round("latency", 3).alias("latency"), F.round("std", 3).alias("std"), "n", "ts_ms")


@query("p16_touch_gaps", with_ctes(TEL, """,
g AS (SELECT device_id, event_id, ts_ms - lag(ts_ms) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS gap FROM tel WHERE event_type = 'TOUCH')
SELECT device_id, event_id, gap AS duration_ms FROM g WHERE gap BETWEEN 10 AND 86400000"""))
def p16(spark, sf_dir):
    touches = telemetry(spark, sf_dir).filter("event_type = 'TOUCH'")
    return W.touch_gaps(touches, 10, 86_400_000).select("device_id", "event_id", "duration_ms")


def packets(spark, sf_dir):
    p = parse_payload(telemetry(spark, sf_dir).filter("event_type = 'NETWORK_FLOW'"))
    return p.select("device_id", "event_id", "ts_ms", F.col("p.protocol").alias("protocol"), F.col("p.dstIp").alias("dst_ip"),
                    F.col("p.dstPort").try_cast("long").alias("dst_port"), num(F.col("p.bytes"), 0.0).cast("long").alias("bytes"),
                    F.concat(F.lit("10.1.0."), (F.col("event_id") % 9).cast("string")).alias("src_ip"))


_FLOW = """,
f AS (SELECT 'fleet' AS device_id, ts_ms // 86400000 * 86400000 AS flush_ms, data->>'$.protocol' AS protocol, data->>'$.dstIp' AS dst_ip,
  CAST(data->>'$.dstPort' AS BIGINT) AS dst_port, count(*) AS packet_count, sum(CAST(data->>'$.bytes' AS BIGINT))::BIGINT AS bytes,
  arg_min('10.1.0.' || (event_id % 9), (ts_ms, event_id)) AS src_ip FROM tel WHERE event_type = 'NETWORK_FLOW' GROUP BY ALL)"""


@query("a19_flow_totals", with_ctes(TEL + _FLOW, "SELECT * FROM f"))
def a19(spark, sf_dir):
    return W.flow_totals(packets(spark, sf_dir).withColumn("device_id", F.lit("fleet")), 86_400_000)


@query("w13_top_flows", with_ctes(TEL + _FLOW, """
SELECT device_id, flush_ms, protocol, dst_ip, dst_port, bytes FROM f
QUALIFY row_number() OVER (PARTITION BY device_id, flush_ms ORDER BY bytes DESC, protocol, dst_ip, dst_port) <= 3"""))
def w13(spark, sf_dir):
    flows = W.flow_totals(packets(spark, sf_dir).withColumn("device_id", F.lit("fleet")), 86_400_000)
    return A.top_flows(flows, 3).select("device_id", "flush_ms", "protocol", "dst_ip", "dst_port", "bytes")


@query("w16_timezone_shift", with_ctes(TEL, """,
s AS (SELECT device_id, event_id, ts_ms, CAST(data->>'$.tz_offset' AS BIGINT) AS tz FROM tel WHERE event_type = 'SYSTEM_STATE'),
l AS (SELECT *, coalesce(tz <> lag(tz) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id), false) AS shifted FROM s)
SELECT device_id, event_id, tz AS tz_offset, shifted, last_value(CASE WHEN shifted THEN ts_ms + 86400000 END IGNORE NULLS)
  OVER (PARTITION BY device_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS shift_until_ms FROM l"""))
def w16(spark, sf_dir):
    p = parse_payload(telemetry(spark, sf_dir).filter("event_type = 'SYSTEM_STATE'"))
    p = p.select("device_id", "event_id", "ts_ms", F.col("p.tz_offset").try_cast("long").alias("tz_offset"))
    return W.timezone_shifts(p).select("device_id", "event_id", "tz_offset", "shifted", "shift_until_ms")


@query("w17_idle_gap", with_ctes(TEL, """,
g AS (SELECT device_id, event_id, ts_ms - lag(ts_ms) OVER (PARTITION BY device_id ORDER BY ts_ms, event_id) AS gap_ms FROM tel)
SELECT device_id, event_id, gap_ms, coalesce(gap_ms > 600000, false) AS learning_suspended FROM g"""))
def w17(spark, sf_dir):
    return W.idle_gaps(telemetry(spark, sf_dir)).select("device_id", "event_id", "gap_ms", "learning_suspended")
