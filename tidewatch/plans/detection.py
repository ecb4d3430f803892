"""Baselines, distances, threat types, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import adaptive as AD
from tidewatch.operators import aggregates as A
from tidewatch.operators import alerts as AL
from tidewatch.operators import baseline as B
from tidewatch.operators import detect as D
from tidewatch.operators import inputs as IN
from tidewatch.operators import rules as R
from tidewatch.operators import windows as W
from tidewatch.plans.common import ALR, WIN, millionths, with_ctes, with_recursive
from tidewatch.plans.registry import also, query
from tidewatch.plans.rules import BAD_APPS, BAD_DOMAINS, IGNORED, RULE_CTES
from tidewatch.session import materialise
from tidewatch.sources.telemetry import alerts, table, telemetry

DAY = 86_400_000


def vectors(spark, sf_dir):
    """Embeddings as feature vectors, their label as the device."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def diagonal_baselines(spark, sf_dir):
    m = B.mean_vectors(vectors(spark, sf_dir), ["label"])
    return m.select("label", "n", "mean", F.expr(
        "transform(sequence(0, size(mean) * size(mean) - 1), i -> IF(i % (size(mean) + 1) = 0, get(variance, CAST(i div (size(mean) + 1) AS INT)), 0D))").alias("cov"))


_EMB = """
u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
b AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM u GROUP BY ALL),
d AS (SELECT vec_id, label, dim, x, m, x - m AS diff, (x - m) * (x - m) / (v + 1e-6) AS part, (dim % 5 <> vec_id % 5)::INT AS mk FROM u JOIN b USING (label, dim)),
dist AS (SELECT vec_id, label, sqrt(sum(part)) AS distance, sqrt(sum(part * mk) * 64 / sum(mk)) AS masked FROM d GROUP BY ALL)"""
_INTS = "string_agg(CAST(round({} * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY dim)"


@query("a20_mean_vectors", with_ctes(_EMB, f"SELECT label, any_value(n) AS n, {_INTS.format('m')} AS mean, {_INTS.format('v')} AS variance FROM b GROUP BY label"))
def a20(spark, sf_dir):
    m = B.mean_vectors(vectors(spark, sf_dir), ["label"])
    return m.select("label", "n", millionths("mean").alias("mean"), millionths("variance").alias("variance"))


@query("a20_fleet_covariance", with_ctes(_EMB, """
SELECT a.dim::INTEGER AS i, b.dim::INTEGER AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM u a JOIN u b USING (vec_id) GROUP BY ALL"""))
def a20_fleet(spark, sf_dir):
    fleet = B.fit_baselines(vectors(spark, sf_dir).withColumn("fleet", F.when(F.col("vec_id").isNotNull(), "all")), ["fleet"], "vec_id", chunk=100)
    return fleet.select(F.posexplode("cov").alias("p", "cov")).select(
        F.expr("CAST(p div 64 AS INT)").alias("i"), (F.col("p") % 64).alias("j"), F.round("cov", 6).alias("cov"))


def device_covariance(spark, sf_dir):
    fitted = B.fit_baselines(vectors(spark, sf_dir), ["label"], "vec_id", chunk=20)
    return fitted.select("label", F.posexplode("cov").alias("p", "cov")).select(
        "label", F.expr("CAST(p div 64 AS INT)").alias("i"), (F.col("p") % 64).alias("j"), F.round("cov", 6).alias("cov"))


@query("a20_device_covariance", with_ctes(_EMB, """
SELECT label, a.dim::INTEGER AS i, b.dim::INTEGER AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM u a JOIN u b USING (vec_id, label) GROUP BY ALL"""))
def a20_device_whole(spark, sf_dir):
    return device_covariance(spark, sf_dir)


also("a20_device_covariance_whole", "a20_device_covariance")


def scored(spark, sf_dir, mask=None):
    v = vectors(spark, sf_dir)
    if mask:
        v = v.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 5 != F.col("vec_id") % 5).cast("double")))
    return D.score_vectors(v, diagonal_baselines(spark, sf_dir), "label", ["vec_id"], mask=mask, rows_per_task=20)


@query("d1_mahalanobis", with_ctes(_EMB, "SELECT vec_id, label, round(distance, 6) AS distance FROM dist"))
def d1(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("d1_mahalanobis_full")
def d1_full(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return D.score_vectors(v, B.fit_baselines(v, ["label"], "vec_id"), "label", ["vec_id"]).select("vec_id", "label", "distance")


@query("d1_full_two_dimensions", with_ctes("""
v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS a, covar_samp(x, y) AS b, var_samp(y) + 1e-6 AS c FROM v GROUP BY label)""", """
SELECT vec_id, label, round(sqrt((c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b)), 6) AS distance
FROM v JOIN m USING (label)"""))
def d1_two(spark, sf_dir):
    """Full covariance against the closed form of a 2 x 2 inverse."""
    v = vectors(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 2))
    out = D.score_vectors(v, B.fit_baselines(v, ["label"], "vec_id", chunk=20), "label", ["vec_id"], rows_per_task=20)
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("d2_masked_mahalanobis", with_ctes(_EMB, "SELECT vec_id, label, round(masked, 6) AS distance FROM dist"))
def d2(spark, sf_dir):
    return scored(spark, sf_dir, "mask").select("vec_id", "label", F.round("distance", 6).alias("distance"))


_CONTRIB = """,
sh AS (SELECT vec_id, label, dim, part / sum(part) OVER (PARTITION BY vec_id) AS share FROM d),
top5 AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, dim DESC) <= 5),
con AS (SELECT vec_id, label, dim::INTEGER AS idx, share FROM top5 WHERE share > 0.05)"""


@query("d7_contributions", with_ctes(_EMB + _CONTRIB, "SELECT vec_id, idx, round(share, 6) AS weight FROM con"))
def d7(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", F.explode("contributions").alias("idx", "weight")).withColumn("weight", F.round("weight", 6))


@query("d8_factor_texts", with_ctes(_EMB + _CONTRIB, """
SELECT vec_id, string_agg(CASE WHEN idx < 24 THEN 'Highly unusual device activity around ' || idx || ':00 ' WHEN idx < 34 THEN 'Abnormal frequency of specific app usage '
  WHEN idx < 44 THEN 'Unusual app switching behavior / transition entropy ' WHEN idx < 52 THEN 'Unexpected opening sequence between apps '
  WHEN idx < 57 THEN 'Anomalous keystroke dynamics detected ' WHEN idx < 62 THEN 'Atypical touch durations (possible automation or fatigue) '
  ELSE 'Irregular swipe velocities ' END || printf('(contributed %.1f%%', share * 100) || CASE WHEN idx < 24 THEN ' to anomaly score).' ELSE ').' END, '|' ORDER BY share DESC, idx) AS factors
FROM con GROUP BY vec_id"""))
def d8(spark, sf_dir):
    out = scored(spark, sf_dir).filter(F.size("contributions") > 0)
    return out.select("vec_id", F.array_join(D.factor_texts(F.col("contributions")), "|").alias("factors"))


# Distances with per-label statistics; the factors spread them around the threshold.
_DET = _EMB + """,
st AS (SELECT label, avg(distance) AS dm, CASE WHEN label = 0 THEN 0 ELSE stddev_pop(distance) END AS ds FROM dist GROUP BY label),
th AS (SELECT vec_id, label, distance, vec_id % 4 = 0 AS tz_active, ((CASE WHEN ds > 0 THEN dm + ds ELSE 1 * sqrt(64) END) * (CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END)
   * (([0.1, 0.15, 0.4, 0.75, 0.95, 1.2])[vec_id % 6 + 1])::DOUBLE) AS threshold FROM dist JOIN st USING (label)),
sl AS (SELECT vec_id, sqrt(sum(diff * diff) FILTER (dim < 24)) AS t, (vec_id % 5) * sqrt(sum(diff * diff) FILTER (dim BETWEEN 24 AND 51)) AS s,
   (vec_id % 7) * sqrt(sum(diff * diff) FILTER (dim >= 52)) AS i FROM d GROUP BY vec_id),
cl AS (SELECT th.*, distance > threshold AS is_anomaly, CASE WHEN distance <= threshold THEN 'NONE' WHEN s > 2 * t AND distance > 2 * threshold THEN 'MALWARE_MIMICRY'
   WHEN i > 2 * t THEN 'INSIDER_THREAT' WHEN (vec_id % 13) / 2 + (vec_id % 7) / 2 > (CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 4 END) AND distance < 1.5 * threshold THEN 'USER_DRIFT'
   ELSE 'DEVICE_MISUSE' END AS threat_type, distance / threshold AS z FROM th JOIN sl USING (vec_id)),
sv AS (SELECT *, (CASE WHEN NOT is_anomaly THEN greatest(1, least(3, floor(z + 1))) WHEN z < 4 THEN 5 WHEN z < 6 THEN 7 WHEN z < 8 THEN 8 ELSE least(10, floor(z) + 1) END)::INTEGER AS severity FROM cl)"""


def detections(spark, sf_dir):
    base = scored(spark, sf_dir)
    stats = base.groupBy("label").agg(F.avg("distance").alias("dm"), F.when(F.col("label") == 0, 0.0).otherwise(F.stddev_pop("distance")).alias("ds"))
    i = F.col("vec_id")
    factor = F.element_at(F.array(*[F.lit(f) for f in (0.1, 0.15, 0.4, 0.75, 0.95, 1.2)]), (i % 6 + 1).cast("int"))
    means = B.mean_vectors(vectors(spark, sf_dir), ["label"]).select("label", "mean")
    both = vectors(spark, sf_dir).drop("label").join(base, "vec_id").join(stats, "label").join(means, "label")
    return both.select(
        "vec_id", "label", "distance", "contributions", (i % 4 == 0).alias("tz_active"),
        (D.threshold(F.col("dm"), F.col("ds"), F.lit(64.0), 1.0, i % 4 == 0) * factor).alias("threshold"),
        F.expr("transform(zip_with(vector, mean, (x, m) -> x - m), (x, i) -> x * CASE WHEN i < 24 THEN 1 WHEN i < 52 THEN vec_id % 5 ELSE vec_id % 7 END)").alias("diff"),
        (i % 13 / 2.0).alias("cusum_pos"), (i % 7 / 2.0).alias("cusum_neg"), F.when(i % 2 == 1, 4.0).alias("cusum_h"),
    )


@query("d3_dynamic_threshold", with_ctes(_DET, "SELECT vec_id, tz_active, round(threshold, 6) AS threshold FROM th"))
def d3(spark, sf_dir):
    return detections(spark, sf_dir).select("vec_id", "tz_active", F.round("threshold", 6).alias("threshold"))


@query("d4_probability", with_ctes(_DET, """
SELECT vec_id, round(CASE WHEN z2 >= 0 THEN 1 / (1 + exp(-z2)) ELSE exp(z2) / (1 + exp(z2)) END, 6) AS probability
FROM (SELECT vec_id, greatest(-700, least(700, 0.02 * (distance * distance - threshold * threshold))) AS z2 FROM th)"""))
def d4(spark, sf_dir):
    return detections(spark, sf_dir).select("vec_id", F.round(D.anomaly_probability(F.col("distance"), F.col("threshold"), 0.02), 6).alias("probability"))


@query("d5_threat_type", with_ctes(_DET, "SELECT vec_id, is_anomaly, threat_type FROM sv"))
def d5(spark, sf_dir):
    return D.classify(detections(spark, sf_dir), k=1.0).select("vec_id", "is_anomaly", "threat_type")


_MESSAGE = """CASE threat_type WHEN 'NONE' THEN 'Normal behavior detected'
  WHEN 'USER_DRIFT' THEN printf('Gradual behavioral drift detected (distance %.1f vs threshold %.1f)', distance, threshold)
  WHEN 'DEVICE_MISUSE' THEN 'Sudden behavioral deviation detected — possible device misuse (severity ' || severity || '/10)'
  WHEN 'MALWARE_MIMICRY' THEN printf('Suspicious app transition pattern — possible malware (distance %.1f, %d/10 severity)', distance, severity)
  WHEN 'INSIDER_THREAT' THEN 'Unusual interaction patterns — possible unauthorized user (severity ' || severity || '/10)' END"""


@query("d6_severity_message", with_ctes(_DET, f"SELECT vec_id, severity, {_MESSAGE} AS message FROM sv"))
def d6(spark, sf_dir):
    return D.classify(detections(spark, sf_dir), k=1.0).select("vec_id", "severity", "message")


@query("d9_adversarial_stability", with_ctes(_DET, """
SELECT vec_id, CASE WHEN hit THEN 'ADVERSARIAL_MIMICRY' ELSE threat_type END AS threat_type,
  (CASE WHEN hit THEN greatest(1, least(3, floor(3 * distance / (threshold + 1e-6)))) ELSE severity END)::INTEGER AS severity
FROM (SELECT *, threat_type = 'NONE' AND vec_id % 100 >= 50 AND vec_id % 10 < 3 AND distance > threshold / 2 AS hit FROM sv)"""))
def d9(spark, sf_dir):
    found = D.classify(detections(spark, sf_dir), k=1.0).withColumn("stability", F.col("vec_id") % 10 / 10.0).withColumn("n_scores", F.col("vec_id") % 100)
    return D.flag_adversarial(found).select("vec_id", "threat_type", "severity")


@query("a25_stable_contributions", with_ctes(_DET + _CONTRIB, """,
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rk FROM (SELECT DISTINCT label, vec_id FROM sv WHERE is_anomaly) QUALIFY rk <= 5),
w AS (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n FROM r),
m AS (SELECT w.label, idx, sum(share) / any_value(n) AS avg_w FROM con JOIN w USING (vec_id) GROUP BY ALL HAVING count(*) >= greatest(1, any_value(n) // 2)),
s AS (SELECT label, idx, avg_w / sum(avg_w) OVER (PARTITION BY label) AS weight FROM m)
SELECT 'dev_' || label AS device_id, idx, round(weight, 6) AS weight FROM s WHERE weight > 0.05 QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, idx) <= 3"""))
def a25_whole(spark, sf_dir):
    """Of every window that the detector calls an anomaly."""
    hits = D.classify(detections(spark, sf_dir), k=1.0).filter("is_anomaly").select(
        F.concat(F.lit("dev_"), F.col("label").cast("string")).alias("device_id"), F.col("vec_id").alias("window_id"), "contributions")
    return D.aggregated_contributions(hits).withColumn("weight", F.round("weight", 6))


also("a25_stable_contributions_whole", "a25_stable_contributions")


@query("d13_learning_gate", with_ctes(_DET, """
SELECT vec_id, (NOT (is_anomaly OR vec_id % 9 = 0) OR (threat_type = 'USER_DRIFT' AND severity <= 5)) AND vec_id % 8 * 100 <= 600 AS learn FROM sv"""))
def d13(spark, sf_dir):
    found = D.classify(detections(spark, sf_dir), k=1.0)
    gate = B.learning_gate(F.col("is_anomaly") | (F.col("vec_id") % 9 == 0), F.col("threat_type"), F.col("severity"), F.col("vec_id") % 8 * 100_000)
    return found.select("vec_id", gate.alias("learn"))


@query("d10_baseline_blend", with_ctes(_EMB, f"""
SELECT vec_id, {_INTS.format('CASE WHEN vec_id % 17 = 0 THEN m ELSE w * m + (1 - w) * x END')} AS mean
FROM (SELECT *, greatest(0, least(1, 1 - (vec_id % 10 - 1) / 7)) AS w FROM d) GROUP BY vec_id"""))
def d10(spark, sf_dir):
    means = B.mean_vectors(vectors(spark, sf_dir), ["label"]).select("label", "mean")
    v = vectors(spark, sf_dir).join(means, "label").withColumn("own", F.when(F.col("vec_id") % 17 != 0, F.col("vector")))
    v = v.withColumn("w", B.generic_weight(F.col("vec_id") % 10 * DAY))
    return v.withColumn("b", B.blend(F.col("own"), F.col("mean"), F.col("w"))).select("vec_id", millionths("b").alias("mean"))


_EMA = with_recursive(_EMB, """,
o AS (SELECT u.*, row_number() OVER (PARTITION BY label, dim ORDER BY vec_id) - 1 AS i FROM u),
al AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 5 = 0 THEN least(0.5, 5 * 0.05 / (1 + i / 1000)) ELSE 0.05 / (1 + i / 1000) END AS a FROM o),
e AS (SELECT label, dim, i, a * x AS m, (1 - a) + a * x * (x - a * x) AS v FROM al WHERE i = 0
  UNION ALL SELECT al.label, al.dim, al.i, (1 - al.a) * m + al.a * x, (1 - al.a) * v + al.a * (x - m) * (x - ((1 - al.a) * m + al.a * x))
  FROM e JOIN al ON al.label = e.label AND al.dim = e.dim AND al.i = e.i + 1)
SELECT label, i + 1 AS n, dim::INTEGER AS dim, round(m, 6) AS mean, round(v, 6) AS variance FROM e QUALIFY row_number() OVER (PARTITION BY label, dim ORDER BY i DESC) = 1""")


def ema_baselines(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumns({"learn": F.col("vec_id") % 3 != 0, "drift": F.col("vec_id") % 5 == 0})
    start = v.select("label").distinct().select("label", F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0.0), 64).alias("mean"),
                                                F.expr("transform(sequence(0, 4095), i -> IF(i % 65 = 0, 1D, 0D))").alias("cov"))
    return B.update_baselines(v, start, "label", "vec_id")


def ema_dimensions(spark, sf_dir):
    return ema_baselines(spark, sf_dir).select("label", "n", "cov", F.posexplode("mean").alias("dim", "mean")).select(
        "label", "n", "dim", F.round("mean", 6).alias("mean"), F.round(F.expr("get(cov, dim * 65)"), 6).alias("variance"))


@query("d12_ema_update", _EMA)
def d12_whole(spark, sf_dir):
    return ema_dimensions(spark, sf_dir)


also("d12_ema_update_whole", "d12_ema_update")


_YJ = "CASE WHEN x >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END END"


@query("d14_power_fit", with_ctes(_EMB, f""",
g AS (SELECT label, dim, x, (g * 5 - 200) / 100.0::DOUBLE AS lam FROM u, range(81) AS r(g)),
l AS (SELECT label, dim, lam, count(*) AS n, var_pop({_YJ}) AS v, sum(sign(x) * ln(1 + abs(x))) AS j, max(x) - min(x) AS span FROM g GROUP BY ALL)
SELECT label, dim::INTEGER AS dim, n, CASE WHEN span > 0 THEN lam ELSE 1 END AS lam FROM l
QUALIFY row_number() OVER (PARTITION BY label, dim ORDER BY round(-n / 2 * ln(v) + (lam - 1) * j, 6) DESC, lam) = 1"""))
def d14_fit(spark, sf_dir):
    """The first grid only, as its SQL asks."""
    return B.grid_lambdas(vectors(spark, sf_dir), ["label"]).select("label", "dim", "n", "lam")


@query("d14_power_fit_whole")
def d14_fit_whole(spark, sf_dir):
    return B.fit_lambdas(vectors(spark, sf_dir), ["label"]).select("label", "dim", "n", "lam")


@query("d14_power_apply", with_ctes(_EMB, f"SELECT vec_id, {_INTS.format(_YJ)} AS vec FROM (SELECT *, (dim % 9 - 4) / 2 AS lam FROM u WHERE label <> 1 UNION ALL SELECT *, 1 FROM u WHERE label = 1) GROUP BY vec_id"))
def d14_apply(spark, sf_dir):
    v = vectors(spark, sf_dir)
    lam = v.filter("label <> 1").select("label").distinct().select("label", F.posexplode(F.expr("transform(sequence(0, 63), d -> (d % 9 - 4) / 2D)")).alias("dim", "lam"))
    return B.apply_power(v, lam, ["label"]).select("vec_id", millionths("vector").alias("vec"))


def windows_with_state(spark, sf_dir, customers):
    state = customers.select(
        F.concat(F.lit("dev_"), F.col("c_custkey").cast("string")).alias("device_id"), F.col("c_acctbal").alias("distance_mean"))
    wins = W.window_span(W.count_windows(telemetry(spark, sf_dir))).select("device_id", "window_id")
    return B.with_device_state(wins, state).select("device_id", "window_id", "distance_mean")


@query("j1_window_device_state", with_ctes(WIN, """
SELECT w.device_id, w.window_id, c.c_acctbal AS distance_mean FROM (SELECT DISTINCT device_id, window_id FROM win) w
LEFT JOIN customer c ON w.device_id = 'dev_' || c.c_custkey"""))
def j1_whole(spark, sf_dir):
    """With every stored state; a device without one is new."""
    return windows_with_state(spark, sf_dir, table(spark, sf_dir, "customer"))


also("j1_window_device_state_whole", "j1_window_device_state")


@query("d16_user_calibration")
def d16(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    scores = docs.select(F.col("lang").alias("user_id"), F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                         (F.log1p("n_chars") + F.col("quality") * 0.5).alias("score"))
    return AL.calibrate(scores, min_samples=50)


_ENS = """,
en AS (SELECT *, CASE WHEN vec_id % 6 <> 1 THEN (vec_id % 100) / 100 END AS a0, CASE WHEN vec_id % 7 <> 2 THEN (vec_id * 37 % 100) / 100 END AS b0,
  distance / threshold > 0.8 AND distance / threshold < 1.2 AS asked FROM sv),
en2 AS (SELECT *, CASE WHEN asked THEN a0 END AS a, CASE WHEN asked THEN b0 END AS b FROM en),
en3 AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0 ELSE (coalesce(0.7 * a, 0) + coalesce(0.3 * b, 0)) / ((CASE WHEN a IS NULL THEN 0 ELSE 0.7 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END)) END AS raw FROM en2),
ens AS (SELECT *, round(raw, 4)::DOUBLE AS score, (a IS NOT NULL OR b IS NOT NULL) AND (raw >= 0.42 OR coalesce(a >= 0.34, false) OR coalesce(b >= 0.5, false)) AS pred,
  (vec_id % 90) / 100 AS conf FROM en3)"""


def ensemble(spark, sf_dir):
    i = F.col("vec_id")
    found = D.classify(detections(spark, sf_dir), k=1.0).withColumn("confidence", i % 90 / 100.0)
    found = found.withColumn("tabular_prob", F.when(i % 6 != 1, i % 100 / 100.0)).withColumn("text_prob", F.when(i % 7 != 2, i * 37 % 100 / 100.0))
    return AL.ensemble_decision(found, mode="fallback")


@query("d21_ensemble_decision", with_ctes(_DET + _ENS, """
SELECT vec_id, asked AS ensemble_asked, score AS ensemble_score, pred AS ensemble_pred,
  (CASE WHEN NOT pred THEN severity WHEN is_anomaly THEN CASE WHEN score >= 0.7 THEN least(10, severity + 1) ELSE severity END ELSE greatest(severity, 7) END)::INTEGER AS severity,
  round(CASE WHEN NOT pred THEN conf WHEN is_anomaly THEN greatest(conf, least(0.99, score + 0.12)) ELSE greatest(conf, least(0.98, score + 0.2)) END, 6)::DOUBLE AS confidence,
  CASE WHEN pred AND NOT is_anomaly THEN 'DEVICE_MISUSE' ELSE threat_type END AS threat_type FROM ens"""))
def d21(spark, sf_dir):
    out = AL.raise_by_ensemble(ensemble(spark, sf_dir))
    return out.select("vec_id", "ensemble_asked", "ensemble_score", "ensemble_pred", "severity", F.round("confidence", 6).alias("confidence"), "threat_type")


@query("d22_final_alert", with_ctes(_DET, """,
es AS (SELECT vec_id, is_anomaly, CASE WHEN is_anomaly AND vec_id % 10 = 1 THEN least(10, severity + 2) ELSE severity END AS sev,
  CASE WHEN is_anomaly AND vec_id % 10 = 1 THEN 'INSIDER_THREAT' ELSE threat_type END AS threat, (vec_id % 100) / 100 AS conf, distance, vec_id % 3 = 0 AS rule FROM sv WHERE is_anomaly OR vec_id % 3 = 0),
al AS (SELECT vec_id, CASE WHEN NOT is_anomaly THEN 'rule' WHEN rule THEN 'model+rule' ELSE 'model' END || CASE WHEN vec_id % 11 = 0 THEN '+ensemble' ELSE '' END AS source,
  CASE WHEN NOT is_anomaly OR (rule AND 8 > sev) THEN 8 ELSE sev END::INTEGER AS severity, CASE WHEN NOT is_anomaly OR (rule AND 8 > sev) THEN 'MALWARE_MIMICRY' ELSE threat END AS threat_type,
  (CASE WHEN NOT is_anomaly THEN 0.94 WHEN rule THEN greatest(conf, 0.94) ELSE conf END)::DOUBLE AS confidence, CASE WHEN NOT is_anomaly THEN 0 ELSE round(distance, 6) END::DOUBLE AS distance FROM es)
SELECT *, CASE WHEN threat_type = 'MALWARE_MIMICRY' AND confidence > 0.95 THEN 'approved' ELSE 'pending' END AS status FROM al"""))
def d22(spark, sf_dir):
    i = F.col("vec_id")
    found = D.classify(detections(spark, sf_dir), k=1.0).withColumn("confidence", i % 100 / 100.0).withColumn("ensemble_pred", i % 11 == 0)
    found = found.withColumn("sensitive_permission", i % 10 == 1).withColumn("rule", F.when(i % 3 == 0, F.struct(
        F.lit(8).alias("severity"), F.lit("MALWARE_MIMICRY").alias("threat_type"), F.lit("known bad").alias("message"),
        F.lit(0.94).alias("confidence"), F.lit("domain:x").alias("indicator"))))
    out = AL.merge_findings(AL.escalate_sensitive(found))
    return out.select("vec_id", "source", "severity", "threat_type", "confidence", F.round("distance", 6).alias("distance"), "status")


_FB = """,
fb AS (SELECT anomaly_id, (['approved','denied','normal','later'])[alert_seq % 4 + 1] AS decision, created_ms + 60000 AS at_ms FROM alr WHERE alert_seq % 5 = 0
  UNION ALL SELECT anomaly_id, 'normal', created_ms + 120000 FROM alr WHERE alert_seq % 35 = 0),
la AS (SELECT anomaly_id, arg_max(decision, at_ms) AS decision, max(at_ms) AS at_ms FROM fb WHERE decision <> 'later' GROUP BY ALL)"""


def feedback(made):
    seq = F.col("alert_seq")
    choice = F.element_at(F.array(*[F.lit(x) for x in ("approved", "denied", "normal", "later")]), (seq % 4 + 1).cast("int"))
    first = made.filter(seq % 5 == 0).select("anomaly_id", choice.alias("decision"), (F.col("created_ms") + 60000).alias("at_ms"))
    return first.unionByName(made.filter(seq % 35 == 0).select("anomaly_id", F.lit("normal").alias("decision"), (F.col("created_ms") + 120000).alias("at_ms")))


@query("d24_feedback_status", with_ctes(ALR + _FB, """
SELECT anomaly_id, coalesce(la.decision, alr.status) AS status, la.at_ms AS responded_ms FROM alr LEFT JOIN la USING (anomaly_id)"""))
def d24(spark, sf_dir):
    made = alerts(spark, sf_dir)
    return AL.apply_feedback(made, feedback(made)).select("anomaly_id", "status", "responded_ms")


@query("d24_feedback_learning", with_recursive(_EMB, """,
o AS (SELECT u.*, row_number() OVER (PARTITION BY label, dim ORDER BY vec_id) - 1 AS i FROM u WHERE vec_id % 4 = 1),
e AS (SELECT o.label, o.dim, i, (1 - 0.25 / (1 + b.n / 1000)) * m + 0.25 / (1 + b.n / 1000) * x AS mean, b.n + 1 AS n FROM o JOIN b ON b.label = o.label AND b.dim = o.dim WHERE i = 0
  UNION ALL SELECT o.label, o.dim, o.i, (1 - 0.25 / (1 + e.n / 1000)) * mean + 0.25 / (1 + e.n / 1000) * x, e.n + 1 FROM e JOIN o ON o.label = e.label AND o.dim = e.dim AND o.i = e.i + 1),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label, dim ORDER BY i DESC) = 1)
SELECT label, n, string_agg(CAST(round(mean * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY dim) AS mean FROM f GROUP BY ALL"""))
def d24_learning(spark, sf_dir):
    made = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("anomaly_id"), "label", "vec_id", F.col("vector").alias("feature_vector"))
    told = made.filter("vec_id % 2 = 1").select("anomaly_id", F.when(F.col("vec_id") % 4 == 1, "normal").otherwise("denied").alias("decision"), F.col("vec_id").alias("at_ms"))
    out = AL.learn_from_feedback(made, told, diagonal_baselines(spark, sf_dir), "label")
    return out.select("label", "n", millionths("mean").alias("mean"))


@query("d25_response_plan", with_ctes(ALR, """
SELECT anomaly_id, concat_ws(',', CASE WHEN severity > 3 THEN 'notify' END, CASE WHEN severity > 6 AND alert_seq % 2 = 0 THEN 'kill_process:p' || (alert_seq % 5) END,
  CASE WHEN severity > 6 AND alert_seq % 3 = 0 THEN 'block_network:' || (10000 + alert_seq % 7) END, CASE WHEN severity > 8 AND alert_seq % 2 = 0 THEN 'quarantine_app:p' || (alert_seq % 5) END,
  CASE WHEN severity > 8 AND alert_seq % 2 = 0 THEN 'uninstall_app:p' || (alert_seq % 5) END, CASE WHEN severity > 8 THEN 'lock_device' END) AS actions FROM alr"""))
def d25(spark, sf_dir):
    seq = F.col("alert_seq")
    package = F.when(seq % 2 == 0, F.concat(F.lit("p"), (seq % 5).cast("string")))
    plan = AL.response_plan(F.col("severity"), package, F.when(seq % 3 == 0, 10000 + seq % 7))
    shown = F.transform(plan, lambda a: F.concat_ws(":", a["name"], a["target_package"], a["target_uid"].cast("string")))
    return alerts(spark, sf_dir).select("anomaly_id", F.array_join(shown, ",").alias("actions"))


def explained(spark, sf_dir):
    """Rule alerts of windows with their context; every second one with a model distance as well."""
    wins = W.count_windows(telemetry(spark, sf_dir))
    key = ["device_id", "window_id"]
    made = R.rule_alerts(wins, BAD_APPS, BAD_DOMAINS, IGNORED)
    joined = (
        made.join(W.window_span(wins), key).join(A.top_event_types(wins, 3), key)
        .join(A.action_targets(wins, IGNORED).select(*key, F.col("target_package").alias("dominant_package")), key)
    )
    even = F.col("window_id") % 2 == 0
    return AL.explain(
        joined.withColumn("source", F.when(even, "model+rule").otherwise("rule"))
        .withColumn("distance", F.when(even, 18.0 + F.col("window_id") % 7).otherwise(0.0)).withColumn("threshold", F.when(even, 6.0))
        .withColumn("contributions", F.lit(None).cast("map<int,double>")).withColumn("ensemble_score", F.lit(None).cast("double"))
        .withColumn("ensemble_pred", F.lit(False))
    )


@query("d26_explanations", with_ctes(RULE_CTES, """,
tc AS (SELECT device_id, window_id, event_type, count(*) AS n, min(pos) AS seen FROM win GROUP BY ALL),
tt AS (SELECT device_id, window_id, string_agg(event_type || ' x' || n, ', ' ORDER BY n DESC, seen) AS top FROM (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY device_id, window_id ORDER BY n DESC, seen) <= 3) GROUP BY ALL),
pk AS (SELECT device_id, window_id, p AS pkg, count(*) AS n, min(pos) AS seen FROM (SELECT device_id, window_id, pos, unnest([package_name, data->>'$.packageName']) AS p FROM win) WHERE p <> 'com.app7' GROUP BY ALL),
dp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY device_id, window_id ORDER BY n DESC, seen) = 1),
j AS (SELECT r.*, cnt.n AS ev, (end_ms - start_ms) / 1000.0::DOUBLE AS span, top, pkg, 18 + r.window_id % 7 AS dist, r.window_id % 2 = 0 AS model
  FROM rule r JOIN cnt USING (device_id, window_id) JOIN tt USING (device_id, window_id) LEFT JOIN dp USING (device_id, window_id))
SELECT device_id, window_id, CASE WHEN model THEN round(dist / 6, 3) END::DOUBLE AS distance_ratio,
  CASE WHEN model THEN printf('%s risk: %d events in this window; distance %.2f vs threshold 6.00 (%.2fx), confidence %.2f.', threat_type, ev, dist::DOUBLE, round(dist / 6, 3)::DOUBLE, round(confidence, 6)::DOUBLE)
    WHEN indicator IS NOT NULL THEN printf('%s risk: matched indicator %s across %d recent events (confidence %.2f).', threat_type, indicator, ev, round(confidence, 6)::DOUBLE)
    ELSE printf('%s risk: %d recent events triggered security rules (confidence %.2f).', threat_type, ev, round(confidence, 6)::DOUBLE) END AS summary,
  concat_ws('|', CASE WHEN model THEN printf('Model anomaly score crossed threshold (%.2f > 6.00).', dist::DOUBLE) END, 'Matched configured threat indicator: ' || indicator || '.',
    'Dominant package in window: ' || pkg || '.', 'Top activity types: ' || top || '.', printf('Behavioral window span: %.2fs.', round(span, 3))) AS factors FROM j"""))
def d26(spark, sf_dir):
    return explained(spark, sf_dir).select("device_id", "window_id", "xai.model.distance_ratio", "xai.summary", F.array_join("xai.factors", "|").alias("factors"))


def detector_windows(spark, sf_dir):
    """What the detector is told of each window; the windows are numbered and joined once."""
    wins = materialise(W.count_windows(telemetry(spark, sf_dir)), "windows")
    return IN.detector_inputs(wins, BAD_APPS, BAD_DOMAINS, IGNORED)


# Windows are days apart here, so a device counts as idle only after thirty days.
DETECTOR = AD.DetectorConfig(idle_ms=30 * DAY, smoothing=5)


@query("d23_adaptive_detector")
def d23(spark, sf_dir):
    """With the rule alerts of each window, so that a window that breaks a rule does not train the baseline."""
    return AD.run_detector(detector_windows(spark, sf_dir), DETECTOR)
