"""Recurrences over event values per device."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.ordered import number_rows
from tidewatch.operators import drift as D
from tidewatch.plans.common import TEL, with_ctes, with_recursive
from tidewatch.plans.registry import query
from tidewatch.sources.telemetry import table, telemetry


def series(spark, sf_dir):
    """Event values in time order as a numeric series per device."""
    values = table(spark, sf_dir, "events").select("event_id", "value")
    rows = telemetry(spark, sf_dir).select("device_id", "event_id", "ts_ms").join(values, "event_id")
    return number_rows(rows, ["device_id"]).select("device_id", "seq", "value")


_S = TEL + """,
s AS (SELECT tel.device_id, events.value, row_number() OVER (PARTITION BY tel.device_id ORDER BY ts_ms, tel.event_id) - 1 AS seq
      FROM tel JOIN events USING (event_id))"""
_SIG = _S + """,
sg AS (SELECT device_id, seq, value, CASE WHEN count(*) OVER w > 10 THEN greatest(stddev_pop(value) OVER w, 0.01) ELSE 1 END AS sigma
       FROM s WINDOW w AS (PARTITION BY device_id ORDER BY seq ROWS 39 PRECEDING))"""


@query("w6_rolling_sigma", with_ctes(_SIG, "SELECT device_id, seq, round(sigma, 6) AS sigma FROM sg"))
def w6(spark, sf_dir):
    return D.rolling_sigma(series(spark, sf_dir), window=40, chunk=48).select("device_id", "seq", F.round("sigma", 6).alias("sigma"))


@query("w7_cusum", with_recursive(_S, """,
c AS (SELECT device_id, seq, greatest(0, value - 60 - 2) AS p, greatest(0, 60 - value - 2) AS n FROM s WHERE seq = 0
  UNION ALL SELECT s.device_id, s.seq, greatest(0, p + value - 60 - 2), greatest(0, n + 60 - value - 2) FROM c JOIN s ON s.device_id = c.device_id AND s.seq = c.seq + 1)
SELECT device_id, seq, round(p, 6) + 0 AS cusum_pos, round(n, 6) + 0 AS cusum_neg FROM c"""))
def w7(spark, sf_dir):
    out = D.cusum(series(spark, sf_dir), 60.0, 2.0, chunk=32)
    return out.select("device_id", "seq", F.abs(F.round("cusum_pos", 6)).alias("cusum_pos"), F.abs(F.round("cusum_neg", 6)).alias("cusum_neg"))


@query("w8_tuned_cusum", with_recursive(_SIG, """,
a AS (SELECT *, 0.5 * sigma AS delta, 5 * sigma AS h, value - 60 AS dev FROM sg),
c AS (SELECT device_id, seq, CASE WHEN greatest(dev - delta, -dev - delta) > h THEN 0 ELSE greatest(0, dev - delta) END AS p,
    CASE WHEN greatest(dev - delta, -dev - delta) > h THEN 0 ELSE greatest(0, -dev - delta) END AS n, greatest(dev - delta, -dev - delta) > h AS drift, h FROM a WHERE seq = 0
  UNION ALL SELECT a.device_id, a.seq,
    CASE WHEN greatest(p + dev - delta, n - dev - delta) > a.h THEN 0 ELSE greatest(0, p + dev - delta) END,
    CASE WHEN greatest(p + dev - delta, n - dev - delta) > a.h THEN 0 ELSE greatest(0, n - dev - delta) END,
    greatest(p + dev - delta, n - dev - delta) > a.h, a.h
  FROM c JOIN a ON a.device_id = c.device_id AND a.seq = c.seq + 1)
SELECT device_id, seq, round(p, 6)::DOUBLE AS cusum_pos, round(n, 6)::DOUBLE AS cusum_neg, drift, round(h, 6)::DOUBLE AS h FROM c"""))
def w8(spark, sf_dir):
    s = D.rolling_sigma(series(spark, sf_dir), window=40, chunk=48).withColumn("mean", F.lit(60.0))
    out = D.tuned_cusum(s, "mean")
    return out.select("device_id", "seq", *[F.round(c, 6).alias(c) for c in ("cusum_pos", "cusum_neg", "h")], "drift")


@query("w9_rolling_median", with_ctes(_S, """
SELECT device_id, seq, round(CASE WHEN seq < 4 THEN value ELSE quantile_cont(value, 0.5) OVER (PARTITION BY device_id ORDER BY seq ROWS 4 PRECEDING) END, 6) AS smooth FROM s"""))
def w9(spark, sf_dir):
    return D.smoothed(series(spark, sf_dir), chunk=16).select("device_id", "seq", F.round("smooth", 6).alias("smooth"))


@query("w10_stability_ratio", with_ctes(_S, """
, f AS (SELECT device_id, seq, list(value) OVER (PARTITION BY device_id ORDER BY seq ROWS 9 PRECEDING) AS near,
      stddev_pop(value) OVER (PARTITION BY device_id ORDER BY seq ROWS 39 PRECEDING) AS sd, count(*) OVER (PARTITION BY device_id ORDER BY seq ROWS 39 PRECEDING) AS n FROM s),
d AS (SELECT device_id, seq, sd, n, unnest(near) AS x, quantile_cont_list AS mid FROM (SELECT *, list_aggregate(near, 'median') AS quantile_cont_list FROM f))
SELECT device_id, seq, round(CASE WHEN any_value(n) < 20 THEN 1 WHEN any_value(sd) < 1e-6 THEN 0 ELSE median(abs(x - mid)) / any_value(sd) END, 6)::DOUBLE AS stability
FROM d GROUP BY ALL"""))
def w10(spark, sf_dir):
    out = D.stability(series(spark, sf_dir), short=10, long=40, least=20, chunk=48)
    return out.select("device_id", "seq", F.round("stability", 6).alias("stability"))


@query("w18_distance_stats", with_recursive(_S, """,
c AS (SELECT device_id, seq, 0.05::DOUBLE * value AS m, 0.95 + 0.05::DOUBLE * value * value AS v FROM s WHERE seq = 0
  UNION ALL SELECT s.device_id, s.seq, (1 - 0.05 / (1 + s.seq / 500)) * m + 0.05 / (1 + s.seq / 500) * value,
    (1 - 0.05 / (1 + s.seq / 500)) * v + 0.05 / (1 + s.seq / 500) * (value - m) * (value - m)
  FROM c JOIN s ON s.device_id = c.device_id AND s.seq = c.seq + 1)
SELECT device_id, seq, round(m, 6)::DOUBLE AS distance_mean, round(sqrt(greatest(v, 1e-8)), 6)::DOUBLE AS distance_std FROM c"""))
def w18(spark, sf_dir):
    out = D.distance_stats(series(spark, sf_dir), chunk=24)
    return out.select("device_id", "seq", F.round("distance_mean", 6).alias("distance_mean"), F.round("distance_std", 6).alias("distance_std"))
