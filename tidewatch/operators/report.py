"""Dashboard totals, trends, feeds and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import DAY_MS
from tidewatch.operators.predicates import event_severity, is_auth_failure, payload_preview, severity_label
from tidewatch.settings import RETENTION_DAYS

STATUSES = ["pending", "approved", "denied", "normal"]


def _day(ts_ms: str) -> Column:
    return F.floor(F.col(ts_ms) / DAY_MS)


def first_day(as_of_ms: int, days: int) -> int:
    """Start of the first of the last ``days`` days."""
    return (as_of_ms // DAY_MS - days + 1) * DAY_MS


def _measures(alerts: DataFrame, events: DataFrame, keys: list[Column], alert_keys: list[Column]) -> DataFrame:
    """Alert and event counts side by side; two aggregations, then a sum over both."""
    kind = F.upper("event_type")
    a = alerts.groupBy(*alert_keys).agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("severity") >= 9).alias("critical"),
        F.count_if(F.col("ioc_type").isin("app", "domain", "phishing")).alias("ioc"),
        F.count_if(F.col("ioc_type") == "app").alias("ioc_app"), F.count_if(F.col("ioc_type") == "domain").alias("ioc_domain"),
        F.count_if(F.col("ioc_type") == "phishing").alias("phishing"), F.count_if(F.col("ioc_type") == "permission").alias("permission"),
    )
    e = events.groupBy(*keys).agg(
        F.count_if(kind.startswith("NETWORK")).alias("network"),
        F.count_if(is_auth_failure(F.col("event_type"), F.col("data"))).alias("auth_failures"),
    )
    return a.unionByName(e, allowMissingColumns=True)


MEASURES = ["anomalies", "critical", "network", "auth_failures", "ioc", "ioc_app", "ioc_domain", "phishing", "permission"]


def dashboard_totals(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals; alerts need ``ioc_type``."""
    both = _measures(alerts, events, [], [])
    return both.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def daily_counts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    both = _measures(alerts, events, [_day("ts_ms").alias("day")], [_day("created_ms").alias("day")])
    return both.groupBy("day").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def fill_days(counts: DataFrame, as_of_ms: int, days: int, columns: list[str]) -> DataFrame:
    """The last ``days`` days up to as_of with zeros where nothing happened."""
    today = as_of_ms // DAY_MS
    calendar = counts.sparkSession.range(today - days + 1, today + 1).withColumnRenamed("id", "day")
    return calendar.join(counts, "day", "left").select(
        F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in columns],
    )


def weekly_trend(alerts: DataFrame, events: DataFrame, as_of_ms: int, days: int = 7) -> DataFrame:
    """Daily anomalies, critical alerts, network events and auth failures of the last days."""
    since = first_day(as_of_ms, days)
    recent = daily_counts(alerts.filter(F.col("created_ms") >= since), events.filter(F.col("ts_ms") >= since))
    return fill_days(recent, as_of_ms, days, ["anomalies", "critical", "network", "auth_failures"])


def day_distribution(alerts: DataFrame, events: DataFrame, as_of_ms: int) -> DataFrame:
    start = as_of_ms // DAY_MS * DAY_MS
    inside = lambda df, c: df.filter((F.col(c) >= start) & (F.col(c) < start + DAY_MS))
    return dashboard_totals(inside(alerts, "created_ms"), inside(events, "ts_ms")).select("anomalies", "critical", "network", "auth_failures")


def severity_bands(alerts: DataFrame) -> DataFrame:
    s, status = F.col("severity"), F.lower("status")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s >= 9).alias("critical"), F.count_if(s.between(7, 8)).alias("high"),
        F.count_if(s <= 6).alias("medium"), F.count_if(status == "pending").alias("pending"), F.count_if(status == "approved").alias("approved"),
    )


def weekly_insight(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """This week against the one before, as a sentence; percent rounded half up."""
    today = as_of_ms // DAY_MS
    day = _day("created_ms")
    c = alerts.filter(day.between(today - 13, today)).agg(
        F.count_if(day >= today - 6).alias("this_week"), F.count_if(day < today - 6).alias("previous_week")
    )
    now, before = F.col("this_week"), F.col("previous_week")
    delta = F.abs(now - before)
    percent = F.floor((delta * 200 + before) / F.when(before > 0, before * 2))
    text = (
        F.when((now == 0) & (before == 0), "No anomalies detected this week")
        .when(before == 0, "↑ 100% increase in anomalies this week")
        .when(now >= before, F.concat(F.lit("↑ "), percent.cast("string"), F.lit("% increase in anomalies this week")))
        .otherwise(F.concat(F.lit("↓ "), percent.cast("string"), F.lit("% decrease in anomalies this week")))
    )
    return c.withColumn("insight", text)


def alert_status_counts(devices: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("device_id").pivot("status", STATUSES).agg(F.count(F.lit(1)))
    return devices.join(counts, "device_id", "left").select(
        *[F.col(c) for c in devices.columns], *[F.coalesce(s, F.lit(0)).alias(s) for s in STATUSES]
    )


def latest_alerts(alerts: DataFrame, device_id: str, limit: int = 50) -> DataFrame:
    return alerts.filter(F.col("device_id") == device_id).orderBy(F.desc("created_ms"), F.desc("anomaly_id")).limit(limit)


def pending_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("status") == "pending").orderBy(F.desc("severity"), "anomaly_id")


def unsynced_events(events: DataFrame, synced: DataFrame) -> DataFrame:
    return events.join(synced.select("event_id"), "event_id", "left_anti")


def oldest(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy("ts_ms", "event_id").limit(limit)


def newest(df: DataFrame, limit: int, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def unified_feed(alerts: DataFrame, events: DataFrame, n_alerts: int = 10, n_events: int = 20) -> DataFrame:
    """Newest alerts and events in one list, newest first. Alerts need ``ioc_type``."""
    score = event_severity(F.col("event_type"))
    a = newest(alerts, n_alerts, "created_ms", "alert_seq").select(
        F.col("created_ms").alias("time_ms"), F.lit("ALERT").alias("source"), "device_id", F.col("threat_type").alias("event_type"),
        "message", F.col("severity").alias("severity_score"), severity_label(F.col("severity")).alias("severity"),
        F.coalesce("ioc_type", F.lit("none")).alias("ioc_type"),
    )
    e = newest(events, n_events, "ts_ms", "event_id").select(
        F.col("ts_ms").alias("time_ms"), F.lit("EVENT").alias("source"), "device_id", F.upper("event_type").alias("event_type"),
        payload_preview(F.col("data")).alias("message"), score.alias("severity_score"), severity_label(score).alias("severity"),
        F.lit("none").alias("ioc_type"),
    )
    return a.unionByName(e).orderBy(F.desc("time_ms"), "source", "device_id")


def retain(df: DataFrame, time: str, as_of_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows young enough to keep; a table with date folders is read from the day of the oldest such row on."""
    since = as_of_ms - days * DAY_MS
    if "event_date" in df.columns:
        df = df.filter(F.col("event_date") >= F.date_from_unix_date(F.lit(since // DAY_MS).cast("int")))
    return df.filter(F.col(time) >= since)


def retention_counts(df: DataFrame, time: str, as_of_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows kept and rows removed, in one pass."""
    old = F.col(time) < as_of_ms - days * DAY_MS
    return df.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("removed"))


def delete_device_alerts(alerts: DataFrame, devices: DataFrame) -> DataFrame:
    return alerts.join(devices.select("device_id").distinct(), "device_id", "left_anti")


def upsert(rows: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Newest non-null value of each column per key; a partial update keeps the other fields."""
    newest_of = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c)
    return rows.groupBy(key).agg(*[newest_of(c) for c in columns], F.max(version).alias(version))
