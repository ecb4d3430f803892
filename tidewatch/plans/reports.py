"""Reports, feeds, log viewer (A13-A18, J1, J7, J9, T*, U*, W14, W15, L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import logs as L
from tidewatch.operators import report as R
from tidewatch.plans.common import ALR, LOG, TEL, with_ctes
from tidewatch.plans.ingest import _IOC_SQL, classed_alerts
from tidewatch.plans.registry import query
from tidewatch.session import scratch_dir
from tidewatch.sources.managed import DayTable
from tidewatch.sources.telemetry import alerts, log_lines, table, telemetry

AS_OF = 1706659200000  # 2024-01-31T00:00Z, the day after the last event
LAST_DAY = AS_OF - 86_400_000

_CLASSED = ALR + f""",
c AS (SELECT *, {_IOC_SQL} AS ioc_type FROM alr)"""
_AUTH = "event_type = 'SECURITY_AUTH_EVENT' AND data->>'$.event' = 'AUTH_FAIL'"


@query("a14_dashboard_totals", with_ctes(_CLASSED, f"""
SELECT a.*, e.* FROM (SELECT count(*) AS anomalies, count(*) FILTER (severity >= 9) AS critical, count(*) FILTER (ioc_type IN ('app','domain','phishing')) AS ioc,
  count(*) FILTER (ioc_type = 'app') AS ioc_app, count(*) FILTER (ioc_type = 'domain') AS ioc_domain, count(*) FILTER (ioc_type = 'phishing') AS phishing,
  count(*) FILTER (ioc_type = 'permission') AS permission FROM c) a,
 (SELECT count(*) FILTER (event_type LIKE 'NETWORK%') AS network, count(*) FILTER ({_AUTH}) AS auth_failures FROM tel) e"""))
def a14(spark, sf_dir):
    return R.dashboard_totals(classed_alerts(spark, sf_dir), telemetry(spark, sf_dir))


@query("a15_weekly_trend", with_ctes(_CLASSED, f"""
SELECT strftime(epoch_ms(d * 86400000), '%Y-%m-%d') AS day, (SELECT count(*) FROM c WHERE created_ms // 86400000 = d) AS anomalies,
  (SELECT count(*) FROM c WHERE created_ms // 86400000 = d AND severity >= 9) AS critical,
  (SELECT count(*) FROM tel WHERE ts_ms // 86400000 = d AND event_type LIKE 'NETWORK%') AS network,
  (SELECT count(*) FROM tel WHERE ts_ms // 86400000 = d AND {_AUTH}) AS auth_failures
FROM (SELECT unnest(range({AS_OF // 86400000 - 6}, {AS_OF // 86400000 + 1})) AS d)"""))
def a15(spark, sf_dir):
    since = R.first_day(AS_OF, 7)
    return R.weekly_trend(classed_alerts(spark, sf_dir, since), telemetry(spark, sf_dir, since), AS_OF)


@query("a16_day_distribution", with_ctes(_CLASSED, f"""
SELECT (SELECT count(*) FROM c WHERE created_ms // 86400000 = {LAST_DAY // 86400000}) AS anomalies,
  (SELECT count(*) FROM c WHERE created_ms // 86400000 = {LAST_DAY // 86400000} AND severity >= 9) AS critical,
  (SELECT count(*) FROM tel WHERE ts_ms // 86400000 = {LAST_DAY // 86400000} AND event_type LIKE 'NETWORK%') AS network,
  (SELECT count(*) FROM tel WHERE ts_ms // 86400000 = {LAST_DAY // 86400000} AND {_AUTH}) AS auth_failures"""))
def a16(spark, sf_dir):
    since = R.first_day(LAST_DAY, 1)
    return R.day_distribution(classed_alerts(spark, sf_dir, since), telemetry(spark, sf_dir, since), LAST_DAY)


@query("a17_severity_bands", with_ctes(ALR, """
SELECT count(*) AS total, count(*) FILTER (severity >= 9) AS critical, count(*) FILTER (severity IN (7, 8)) AS high, count(*) FILTER (severity <= 6) AS medium,
  count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved FROM alr"""))
def a17(spark, sf_dir):
    return R.severity_bands(alerts(spark, sf_dir))


@query("a18_weekly_insight", with_ctes(ALR, f""",
w AS (SELECT count(*) FILTER (created_ms // 86400000 >= {AS_OF // 86400000 - 6}) AS this_week, count(*) FILTER (created_ms // 86400000 < {AS_OF // 86400000 - 6}) AS previous_week
  FROM alr WHERE created_ms // 86400000 BETWEEN {AS_OF // 86400000 - 13} AND {AS_OF // 86400000})
SELECT *, (CASE WHEN this_week >= previous_week THEN '↑ ' ELSE '↓ ' END) || ((200 * abs(this_week - previous_week) + previous_week) // (2 * previous_week))
  || (CASE WHEN this_week >= previous_week THEN '% increase' ELSE '% decrease' END) || ' in anomalies this week' AS insight FROM w"""))
def a18(spark, sf_dir):
    return R.weekly_insight(alerts(spark, sf_dir, R.first_day(AS_OF, 14)), AS_OF)


@query("j9_calendar_fill", with_ctes(TEL, f"""
SELECT strftime(epoch_ms(d * 86400000), '%Y-%m-%d') AS day, (SELECT count(*) FROM tel WHERE ts_ms // 86400000 = d AND event_type = 'CANARY_FILE_ACCESS') AS n
FROM (SELECT unnest(range({AS_OF // 86400000 - 34}, {AS_OF // 86400000 + 1})) AS d)"""))
def j9(spark, sf_dir):
    daily = telemetry(spark, sf_dir, R.first_day(AS_OF, 35)).filter("event_type = 'CANARY_FILE_ACCESS'").groupBy(F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return R.fill_days(daily, AS_OF, 35, ["n"])


@query("j7_device_alert_counts", with_ctes(ALR, """
SELECT 'dev_' || c_custkey AS device_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'denied') AS denied, count(*) FILTER (status = 'normal') AS normal
FROM customer LEFT JOIN alr ON alr.device_id = 'dev_' || c_custkey GROUP BY ALL"""))
def j7(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(F.concat(F.lit("dev_"), F.col("c_custkey").cast("string")).alias("device_id"))
    return R.alert_status_counts(devices, alerts(spark, sf_dir))


@query("t1_latest_alerts", with_ctes(ALR, "SELECT anomaly_id, created_ms, severity FROM alr WHERE device_id = 'dev_41' ORDER BY created_ms DESC, anomaly_id DESC LIMIT 20"))
def t1(spark, sf_dir):
    return R.latest_alerts(alerts(spark, sf_dir), "dev_41", 20).select("anomaly_id", "created_ms", "severity")


@query("t2_pending_alerts", with_ctes(ALR, "SELECT anomaly_id, severity FROM alr WHERE status = 'pending'"))
def t2(spark, sf_dir):
    return R.pending_alerts(alerts(spark, sf_dir)).select("anomaly_id", "severity")


def _unsynced(spark, sf_dir):
    synced = table(spark, sf_dir, "events").filter("event_id % 3 <> 1").select("event_id")
    return R.unsynced_events(telemetry(spark, sf_dir), synced)


@query("t3_oldest_unsynced", with_ctes(TEL, "SELECT event_id, ts_ms FROM tel WHERE event_id % 3 = 1 ORDER BY ts_ms, event_id LIMIT 50"))
def t3(spark, sf_dir):
    return R.oldest(_unsynced(spark, sf_dir), 50).select("event_id", "ts_ms")


@query("t3_unsynced_count", "SELECT count(*) AS n FROM events WHERE event_id % 3 = 1")
def t3_count(spark, sf_dir):
    return _unsynced(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("t4_newest_events", with_ctes(TEL, "SELECT event_id, event_type FROM tel ORDER BY ts_ms DESC, event_id DESC LIMIT 1000"))
def t4(spark, sf_dir):
    return R.newest(telemetry(spark, sf_dir), 1000, "ts_ms", "event_id").select("event_id", "event_type")


@query("t4_newest_alerts", with_ctes(ALR, "SELECT anomaly_id, severity FROM alr ORDER BY created_ms DESC, alert_seq DESC LIMIT 250"))
def t4_alerts(spark, sf_dir):
    return R.newest(alerts(spark, sf_dir), 250, "created_ms", "alert_seq").select("anomaly_id", "severity")


@query("t5_score_previews", """
SELECT * FROM (SELECT 'lowest' AS kind, doc_id, n_chars AS score FROM documents ORDER BY n_chars, doc_id DESC LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'highest', doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 300)""")
def t5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    low = docs.orderBy("score", F.desc("doc_id")).limit(200).select(F.lit("lowest").alias("kind"), "doc_id", "score")
    high = R.newest(docs, 300, "score", "doc_id").select(F.lit("highest").alias("kind"), "doc_id", "score")
    return low.unionByName(high)


@query("u1_unified_feed", with_ctes(_CLASSED, """
SELECT * FROM (SELECT created_ms AS time_ms, 'ALERT' AS source, device_id, threat_type AS event_type, message, severity::INTEGER AS severity_score,
    CASE WHEN severity >= 9 THEN 'critical' WHEN severity >= 7 THEN 'high' WHEN severity >= 4 THEN 'medium' ELSE 'low' END AS severity,
    coalesce(ioc_type, 'none') AS ioc_type FROM c ORDER BY created_ms DESC, alert_seq DESC LIMIT 10)
UNION ALL SELECT time_ms, source, device_id, event_type, message, score::INTEGER, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END, 'none' FROM (
  SELECT ts_ms AS time_ms, 'EVENT' AS source, device_id, event_type, substr(data, 1, 180) AS message, CASE WHEN event_type LIKE 'SECURITY%' THEN 7
    WHEN event_type LIKE 'NETWORK_FLOW%' THEN 6 WHEN event_type LIKE 'NETWORK%' THEN 5 WHEN event_type LIKE 'SYSTEM%' THEN 4 ELSE 2 END AS score
  FROM tel ORDER BY ts_ms DESC, event_id DESC LIMIT 20)"""))
def u1(spark, sf_dir):
    return R.unified_feed(classed_alerts(spark, sf_dir), telemetry(spark, sf_dir))


@query("u2_retention", with_ctes(ALR, f"""
SELECT 'events' AS tab, count(*) FILTER (ts_ms >= {AS_OF} - 20 * 86400000::BIGINT) AS kept, count(*) FILTER (ts_ms < {AS_OF} - 20 * 86400000::BIGINT) AS removed FROM tel
UNION ALL SELECT 'alerts', count(*) FILTER (created_ms >= {AS_OF} - 20 * 86400000::BIGINT), count(*) FILTER (created_ms < {AS_OF} - 20 * 86400000::BIGINT) FROM alr"""))
def u2(spark, sf_dir):
    """Stored by day, then rows older than the limit are removed; what is left is what the tables hold afterwards."""
    out = []
    for name, df, time in (("events", telemetry(spark, sf_dir), "ts_ms"), ("alerts", alerts(spark, sf_dir), "created_ms")):
        stored = DayTable(spark, scratch_dir(spark, f"retention-{name}"), df.schema, time)
        stored.append(df)
        gone = stored.retain(AS_OF - 20 * 86_400_000)["removed"]
        left = stored.read().agg(F.count(F.lit(1)).alias("kept"))
        out.append(left.select(F.lit(name).alias("tab"), "kept", F.lit(gone).cast("long").alias("removed")))
    return out[0].unionByName(out[1])


@query("u3_delete_device_alerts", with_ctes(ALR, "SELECT anomaly_id, device_id FROM alr WHERE device_id NOT IN ('dev_41', 'dev_17')"))
def u3(spark, sf_dir):
    gone = spark.createDataFrame([("dev_41",), ("dev_17",)], "device_id string")
    return R.delete_device_alerts(alerts(spark, sf_dir), gone).select("anomaly_id", "device_id")


def alert_versions(spark, sf_dir):
    """Alerts followed by partial updates: a status for every third, a severity for every fifth."""
    first = alerts(spark, sf_dir).select("anomaly_id", "alert_seq", "severity", "status", "message", F.lit(1).alias("version"))
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    second = first.filter("alert_seq % 3 = 0").select("anomaly_id", "alert_seq", none_int.alias("severity"), F.lit("denied").alias("status"), none_text.alias("message"), F.lit(2).alias("version"))
    third = first.filter("alert_seq % 5 = 0").select("anomaly_id", "alert_seq", F.lit(10).alias("severity"), none_text.alias("status"), none_text.alias("message"), F.lit(3).alias("version"))
    return first.unionByName(second).unionByName(third)


UPSERT_SQL = with_ctes(ALR, """
SELECT anomaly_id, CASE WHEN alert_seq % 5 = 0 THEN 10 ELSE severity END::INTEGER AS severity, CASE WHEN alert_seq % 3 = 0 THEN 'denied' ELSE status END AS status,
  message, CASE WHEN alert_seq % 5 = 0 THEN 3 WHEN alert_seq % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS version FROM alr""")


@query("w15_alert_upsert", UPSERT_SQL)
def w15(spark, sf_dir):
    return R.upsert(alert_versions(spark, sf_dir), "anomaly_id", "version", ["severity", "status", "message"])


_PARSED = LOG + """,
v AS (SELECT line_no, line, regexp_extract(line, '(?s)^(\\d{2}-\\d{2})\\s+(\\d{2}:\\d{2}:\\d{2}\\.\\d+)\\s+(\\d+)\\s+(\\d+)\\s+([VDIWEAF])\\s+([^:]+):\\s?(.*)$',
  ['date', 'time', 'pid', 'tid', 'level', 'tag', 'message']) AS m FROM log)"""


@query("l1_log_parse", with_ctes(_PARSED, """
SELECT line_no, CASE WHEN m.level <> '' THEN m.level ELSE 'I' END AS level, try_cast(m.pid AS BIGINT) AS pid,
  CASE WHEN m.level <> '' THEN trim(m.tag) ELSE '(raw)' END AS tag, CASE WHEN m.level <> '' THEN m.message ELSE line END AS message FROM v"""))
def l1(spark, sf_dir):
    return L.parse_viewer_lines(log_lines(spark, sf_dir)).select("line_no", "level", "pid", "tag", "message")


@query("l2_level_badge", with_ctes(_PARSED, """
SELECT line_no, CASE m.level WHEN 'V' THEN 'Verbose' WHEN 'D' THEN 'Debug' WHEN 'W' THEN 'Warn' WHEN 'E' THEN 'Error' WHEN 'F' THEN 'Fatal' WHEN 'A' THEN 'Assert' ELSE 'Info' END AS label,
  CASE WHEN m.level IN ('V','D') THEN 'low' WHEN m.level = 'E' THEN 'high' WHEN m.level IN ('F','A') THEN 'critical' ELSE 'medium' END AS badge FROM v"""))
def l2(spark, sf_dir):
    label, badge = L.level_badge(F.col("level"))
    return L.parse_viewer_lines(log_lines(spark, sf_dir)).select("line_no", label.alias("label"), badge.alias("badge"))


@query("w14_log_buffers", with_ctes(LOG, """,
m AS (SELECT line_no, line, CASE WHEN line LIKE '--------- beginning of %' THEN split_part(line, ' ', 4) END AS mark FROM log),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS buffer FROM m)
SELECT line_no, coalesce(buffer, 'main') AS buffer FROM b WHERE mark IS NULL"""))
def w14(spark, sf_dir):
    return L.name_buffers(log_lines(spark, sf_dir), span=64).select("line_no", "buffer")
