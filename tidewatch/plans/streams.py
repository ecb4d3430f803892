"""Streaming queries (R1-R8, S9): each runs over the event files until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import inputs as IN
from tidewatch.operators import phishing as H
from tidewatch.operators import predicates as P
from tidewatch.operators import report as R
from tidewatch.operators import rules as RU
from tidewatch.operators.windows import time_windows
from tidewatch.plans.common import ALR, TEL, WIN, with_ctes, with_recursive
from tidewatch.plans.detection import DETECTOR
from tidewatch.plans.ingest import wire_messages
from tidewatch.plans.registry import SQL, query
from tidewatch.plans.reports import _AUTH, _CLASSED, AS_OF, UPSERT_SQL
from tidewatch.plans.rules import _ALL, _CAND, _RULES, BAD_APPS, BAD_DOMAINS, IGNORED, _greedy
from tidewatch.session import scratch_dir
from tidewatch.sources.managed import UpsertTable
from tidewatch.sources.messages import parse_messages
from tidewatch.sources.telemetry import alert_view, telemetry
from tidewatch.streaming import runner
from tidewatch.streaming import stateful as S

DAY = 86_400_000


@query("r1_streaming_ingest", with_ctes(TEL, """
SELECT device_id, event_id AS message_id, pos::INTEGER AS pos, CASE WHEN event_id % 43 = 0 THEN 'UNKNOWN' ELSE event_type END AS event_type, package_name, data
FROM tel, (VALUES (0), (1)) AS copies(pos)
WHERE event_id % 97 <> 0 AND (pos = 0 OR event_id % 3 = 0) AND device_id <> 'dev_0' AND device_id NOT LIKE 'dev\\_9%' ESCAPE '\\'
  AND (package_name IS NULL OR package_name <> 'com.app7')"""))
def r1(spark, sf_dir):
    messages = P.drop_ignored_devices(wire_messages(runner.telemetry_stream(spark, sf_dir)), "dev_0", "dev_9")
    ignored = spark.createDataFrame([("com.app7",)], "package_name string")
    events = P.drop_ignored_packages(parse_messages(messages), ignored)
    return runner.append_to_table(events.select("device_id", "message_id", "pos", "event_type", "package_name", "data"), "ingest")


@query("s9_publish_events", with_ctes(TEL, "SELECT event_id, device_id, event_type FROM tel"))
def s9(spark, sf_dir):
    stream = runner.telemetry_stream(spark, sf_dir).select("event_id", "device_id", "event_type")
    return runner.publish(stream, "events-topic").drop("batch_id")


@query("s9_publish_alerts", with_ctes(ALR, "SELECT anomaly_id, device_id, severity, message FROM alr"))
def s9_alerts(spark, sf_dir):
    made = alert_view(runner.telemetry_stream(spark, sf_dir).drop("event_time"))
    return runner.publish(made.select("anomaly_id", "device_id", "severity", "message"), "alerts-topic").drop("batch_id")


# One fleet-wide key and hours instead of seconds: the events are minutes apart.
_LIMIT_SQL = with_ctes(TEL, """
SELECT event_id FROM tel QUALIFY row_number() OVER (PARTITION BY ts_ms // 3600000 ORDER BY ts_ms, event_id) <= 10""")


@query("r2_rate_limit", _LIMIT_SQL)
def r2(spark, sf_dir):
    messages = telemetry(spark, sf_dir).withColumn("device_id", F.lit("fleet"))
    return S.rate_limited(messages, 10, 3_600_000).select("event_id")


@query("r2_rate_limit_stream", _LIMIT_SQL)
def r2_stream(spark, sf_dir):
    stream = runner.telemetry_stream(spark, sf_dir).select(F.lit("fleet").alias("device_id"), "event_id", "ts_ms", "event_time")
    return runner.append_to_table(S.rate_limited_stream(stream, 10, 3_600_000), "rate-limit").select("event_id")


@query("r4_cooldown_stream", with_recursive(_ALL + _greedy("every", "device_id, indicator", 172_800_000), "SELECT device_id, event_id, indicator FROM g WHERE kept"))
def r4(spark, sf_dir):
    tel = runner.telemetry_stream(spark, sf_dir).drop("event_time")
    made = H.phishing_alerts(tel).unionByName(RU.canary_alerts(tel)).unionByName(RU.permission_alerts(tel))
    slim = runner.with_event_time(made.select("device_id", "event_id", "ts_ms", F.lower("indicator").alias("indicator")))
    return runner.append_to_table(S.cooldown_stream(slim, ["device_id", "indicator"], 172_800_000), "cooldown").select(
        "device_id", "event_id", "indicator")


@query("r5_window_stream", with_ctes(WIN, "SELECT device_id, window_id, event_id FROM win"))
def r5_windows(spark, sf_dir):
    with runner.keyed_state(spark):
        windows = runner.append_to_table(S.window_stream(runner.telemetry_stream(spark, sf_dir)), "windows")
    return windows.select("device_id", "window_id", F.explode("ev.event_id").alias("event_id"))


def detector_flow(spark, sf_dir, cfg, files_per_batch=runner.FILES_PER_BATCH, scores=None, slopes=None, **state):
    """Three chained streams: events to windows, windows to what the detector is told of them, and the detector."""
    tel = runner.telemetry_stream(spark, sf_dir, files_per_batch)
    windows = S.window_stream(tel, S.raw_fields(), **state)
    path = runner.append_to_path(windows, "windows")
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    inputs = lambda batch: IN.detector_inputs(S.window_rows(batch), BAD_APPS, BAD_DOMAINS, IGNORED, scores, slopes)
    shape = inputs(spark.createDataFrame([], windows.schema)).schema
    told = runner.each_batch(stream, inputs, "detector-inputs")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_batch).parquet(f"{told}/batch_id=*")
    return runner.append_to_table(S.detector_stream(stream, cfg, **state), "detector")


@query("r5_detector_stream")
def r5(spark, sf_dir):
    """With the rule alerts, sensitive permissions and time zones of each window, as in the batch form."""
    with runner.keyed_state(spark):
        return detector_flow(spark, sf_dir, DETECTOR)


_DAILY_RULES = with_ctes(TEL + """,
win AS (SELECT *, ts_ms // 86400000 * 86400000 AS window_id, row_number() OVER (PARTITION BY device_id, ts_ms // 86400000 ORDER BY ts_ms, event_id) AS pos FROM tel)""" + _RULES + _CAND, """
SELECT device_id, window_id, severity::INTEGER AS severity, threat_type, message, indicator FROM rule""")


@query("r6_time_window_rules", _DAILY_RULES)
def r6(spark, sf_dir):
    made = RU.rule_alerts(time_windows(telemetry(spark, sf_dir), DAY), BAD_APPS, BAD_DOMAINS, IGNORED)
    return made.select("device_id", "window_id", "severity", "threat_type", "message", "indicator")


@query("r6_rule_stream", _DAILY_RULES)
def r6_stream(spark, sf_dir):
    """Watermarked tumbling windows; a device-day is published again whenever it changes."""
    stream = runner.telemetry_stream(spark, sf_dir).withWatermark("event_time", "2 days")
    stream = stream.withColumn("period", F.window("event_time", "1 day"))
    made = RU.rule_alerts(stream, BAD_APPS, BAD_DOMAINS, IGNORED, keys=["device_id", "period"])
    made = made.withColumn("window_id", F.unix_millis("period.start"))
    topic = runner.publish(made.select("device_id", "window_id", "severity", "threat_type", "message", "indicator"), "rules", "update")
    return runner.newest_version(topic, ["device_id", "window_id"])


@query("r7_live_dashboard", with_ctes(_CLASSED, f"""
SELECT ts_ms // 86400000 AS day, count(*) FILTER (event_type LIKE 'NETWORK%') AS network, count(*) FILTER ({_AUTH}) AS auth_failures, count(anomaly_id) AS anomalies,
  count(*) FILTER (severity >= 9) AS critical, count(*) FILTER (ioc_type IN ('app','domain','phishing')) AS ioc, count(*) FILTER (ioc_type = 'app') AS ioc_app,
  count(*) FILTER (ioc_type = 'domain') AS ioc_domain, count(*) FILTER (ioc_type = 'phishing') AS phishing, count(*) FILTER (ioc_type = 'permission') AS permission FROM tel LEFT JOIN c ON c.alert_seq = tel.event_id GROUP BY ALL"""))
def r7(spark, sf_dir):
    """Daily dashboard counts kept current; reports read the newest version of each day."""
    tel = runner.telemetry_stream(spark, sf_dir).drop("event_time")
    day = F.floor(F.col("ts_ms") / DAY).alias("day")
    kind = F.upper("event_type")
    seen = {"network": kind.startswith("NETWORK"), "auth_failures": P.is_auth_failure(F.col("event_type"), F.col("data"))}
    ioc = F.coalesce(P.ioc_class(F.col("indicator"), F.col("threat_type"), F.col("message")), F.lit("none"))
    found = {
        "anomalies": F.lit(True), "critical": F.col("severity") >= 9, "ioc": ioc.isin("app", "domain", "phishing"), "ioc_app": ioc == "app",
        "ioc_domain": ioc == "domain", "phishing": ioc == "phishing", "permission": ioc == "permission",
    }
    ones = lambda tests: [tests.get(m, F.lit(False)).cast("int").alias(m) for m in R.MEASURES]
    made = alert_view(tel).select(F.floor(F.col("created_ms") / DAY).alias("day"), *ones(found))
    daily = tel.select(day, *ones(seen)).unionByName(made).groupBy("day").agg(*[F.sum(m).alias(m) for m in R.MEASURES])
    return runner.newest_version(runner.publish(daily, "dashboard", "update"), ["day"])


@query("r7_live_trend", SQL["a15_weekly_trend"])
def r7_trend(spark, sf_dir):
    """The last seven days of the live totals, a day without any as zeros."""
    measures = ["anomalies", "critical", "network", "auth_failures"]
    since = R.first_day(AS_OF, 7) // DAY
    daily = r7(spark, sf_dir).filter(F.col("day") >= since).select("day", *measures)
    return R.fill_days(daily, AS_OF, 7, measures)


@query("r8_upsert_stream", UPSERT_SQL)
def r8(spark, sf_dir):
    """Alert versions arrive as a stream; each micro-batch is merged into the table, which rewrites only the buckets it touches."""
    first = alert_view(runner.telemetry_stream(spark, sf_dir).drop("event_time")).select("anomaly_id", "alert_seq", "severity", "status", "message")
    third, fifth = F.col("alert_seq") % 3 == 0, F.col("alert_seq") % 5 == 0
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    version = lambda v, s, t, m: F.struct(F.lit(v).alias("version"), s.alias("severity"), t.alias("status"), m.alias("message"))
    versions = F.array_compact(F.array(
        version(1, F.col("severity"), F.col("status"), F.col("message")),
        F.when(third, version(2, none_int, F.lit("denied"), none_text)), F.when(fifth, version(3, F.lit(10), none_text, none_text))))
    stream = first.select("anomaly_id", F.explode(versions).alias("v")).select("anomaly_id", "v.*")
    table = UpsertTable(spark, scratch_dir(spark, "alert-table"), stream.schema, "anomaly_id", "version", ["severity", "status", "message"])
    runner.merge_batches(stream, table, "alert-table")
    return table.rows()
