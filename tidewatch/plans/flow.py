"""The whole way from telemetry to explained alerts, as one batch job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import adaptive as AD
from tidewatch.operators import aggregates as A
from tidewatch.operators import alerts as AL
from tidewatch.operators import baseline as B
from tidewatch.operators import features as X
from tidewatch.operators import phishing as H
from tidewatch.operators import rules as R
from tidewatch.operators import windows as W
from tidewatch.operators.detect import message
from tidewatch.operators.inputs import GROUPS, KEY, detector_inputs
from tidewatch.operators.predicates import drop_ignored_devices
from tidewatch.plans import learning
from tidewatch.plans.detection import DETECTOR, feedback
from tidewatch.plans.registry import query
from tidewatch.plans.rules import BAD_APPS, BAD_DOMAINS, IGNORED
from tidewatch.session import materialise, scratch_dir
from tidewatch.settings import COOLDOWN_SECONDS, ENSEMBLE_DEFAULTS
from tidewatch.sources.artifacts import WindowModels, load_models, save_models
from tidewatch.sources.tables import alert_id, stored_baseline
from tidewatch.sources.telemetry import alerts as stored_alerts
from tidewatch.sources.telemetry import telemetry

ALERT = [
    "anomaly_id", "device_id", "window_id", "severity", "threat_type", "message", "confidence", "distance", "probability", "indicator", "source",
    "actions", "xai", "feature_vector", "status", "created_ms",
]


def fast_path_alerts(tel: DataFrame, gap_ms: int = COOLDOWN_SECONDS * 1000) -> DataFrame:
    """Alerts that do not wait for a window: phishing sites, permissions of side-loaded apps, decoy files.

    One event is enough for each; an indicator of a device rests for ``gap_ms`` after an alert. They have no window, vector or distance.
    """
    made = H.phishing_alerts(tel).unionByName(R.permission_alerts(tel)).unionByName(R.canary_alerts(tel))
    made = materialise(made.withColumn("_low", F.lower("indicator")), "fast-path")
    kept = R.greedy_cooldown(made, ["device_id", "_low"], gap_ms).drop("_low")
    kind = F.when(F.col("source") == "phishing-analyzer", "WEB_DOMAIN").when(F.col("source") == "permission-monitor", "PERMISSION_ACCESS").otherwise("CANARY_FILE_ACCESS")
    none = F.lit(None).cast("double")
    told = kept.withColumns({
        "n": F.lit(1), "span_seconds": none, "top_event_types": F.array(F.struct(kind.alias("event_type"), F.lit(1).cast("long").alias("n"))),
        "dominant_package": F.col("target_package"), "threshold": none, "distance": F.lit(0.0), "contributions": F.lit(None).cast("map<int,double>"),
        "ensemble_score": none, "ensemble_pred": F.lit(False)})
    approved = (F.col("threat_type") == "MALWARE_MIMICRY") & (F.col("confidence") > 0.95)
    out = AL.explain(told).withColumns({
        "window_id": F.lit(None).cast("long"), "probability": none, "feature_vector": F.lit(None).cast("array<double>"),
        "actions": AL.response_plan(F.col("severity"), F.col("target_package"), F.lit(None).cast("long")), "anomaly_id": alert_id("device_id", "event_id", "source"),
        "created_ms": F.col("ts_ms"), "status": F.when(approved, "approved").otherwise("pending"), "xai": F.to_json("xai")})
    return out.select(*ALERT)


def detect_alerts(
    tel: DataFrame, cfg: AD.DetectorConfig, bad_apps: Sequence[str] = (), bad_domains: Sequence[str] = (),
    ignored_packages: Sequence[str] = (), model_scores: DataFrame | None = None, mode: str = "fallback",
    models: WindowModels | None = None, slopes: DataFrame | None = None,
) -> DataFrame:
    """Alerts with action plan and explanation: of windows, and of the fast paths. ``model_scores`` has tabular_prob and text_prob per
    window; with ``models`` they are made here. ``slopes`` has a calibrated slope per device.

    The numbered windows are written once: rules, features, context and permissions all read
    them, and numbering is the one step that shuffles every event. So is what the detector is told of each.
    """
    wins = materialise(W.count_windows(tel), "windows")
    if models is not None:
        model_scores = materialise(models.scores(A.connection_rows(wins), A.text_samples(wins)), "scores")
    inputs = materialise(detector_inputs(wins, bad_apps, bad_domains, ignored_packages, model_scores, slopes), "inputs")
    found = AD.run_detector(inputs, replace(cfg, ensemble_mode=mode)).withColumn("confidence", F.col("probability"))
    found = found.withColumn(
        "message", message(F.col("threat_type"), F.col("severity"), F.col("distance"), F.col("threshold")))
    told = inputs.select(*KEY, "n", "vector", "rule", F.col("sensitive").alias("sensitive_permission"), "tabular_prob", "text_prob")
    found = AL.raise_by_ensemble(AL.ensemble_decision(found.join(told, KEY), mode=mode))
    # A rule alert that repeats within its cooldown, with no anomaly beside it, is dropped.
    passed = AL.escalate_sensitive(found).withColumn("rule", F.when(F.col("rule_passed"), F.col("rule")))
    merged = AL.merge_findings(passed).withColumnRenamed("vector", "feature_vector")
    context = (
        W.window_span(wins).join(A.top_event_types(wins, 3), KEY).join(A.action_targets(wins, ignored_packages), KEY)
        .withColumn("dominant_package", F.col("target_package"))
    )
    alerts = AL.explain(merged.join(context, KEY).withColumn("ensemble_score", F.when(F.col("ensemble_asked"), F.col("ensemble_score"))))
    slow = alerts.withColumns({
        "actions": AL.response_plan(F.col("severity"), F.col("target_package"), F.col("target_uid")), "anomaly_id": alert_id("device_id", "window_id", "source"),
        "created_ms": F.col("end_ms"), "xai": F.to_json("xai")})
    return slow.select(*ALERT).unionByName(fast_path_alerts(tel, cfg.cooldown_ms))


@query("e2e_telemetry_to_alerts")
def end_to_end(spark, sf_dir):
    kept = drop_ignored_devices(telemetry(spark, sf_dir), "dev_0")
    return detect_alerts(kept, DETECTOR, BAD_APPS, BAD_DOMAINS, IGNORED)


def train_models(spark, sf_dir, path, **settings) -> int:
    """Fits both models on the labelled rows and saves them with the weights and thresholds of the ensemble."""
    tabular = learning.M.train_tabular(materialise(learning.connections(spark, sf_dir), "connections"), **settings)
    text = learning.M.train_text(materialise(learning.log_texts(spark, sf_dir, include_level=False), "log-texts"), "text")
    return save_models(spark, path, WindowModels(tabular, text, dict(ENSEMBLE_DEFAULTS)))


def fleet_start(spark, tel: DataFrame, path: str) -> tuple[list[float], list[float]]:
    """Mean and covariance of all windows of the fleet, stored as the baseline artifact and read back from it."""
    vectors = X.feature_groups(W.count_windows(tel)).select(
        F.lit("fleet").alias("fleet"), F.concat_ws("/", *KEY).alias("id"), F.concat(*GROUPS).alias("vector"))
    fitted = B.fit_baselines(vectors, ["fleet"], "id")
    rows = F.expr("transform(sequence(0, size(mean) - 1), i -> slice(cov, i * size(mean) + 1, size(mean)))")
    fitted.select(F.col("mean").alias("baseline_mean"), rows.alias("baseline_covariance")).coalesce(1).write.json(path)
    row = stored_baseline(spark, path, 72).first()
    return list(row["mean"]), list(row["cov"])


def device_slopes(spark, sf_dir, min_samples: int = 20) -> DataFrame:
    """(device_id, slope): calibrated on the severity of alerts and what users said of them; devices with too few have the default."""
    made = stored_alerts(spark, sf_dir)
    told = feedback(made).filter(F.col("decision").isin("approved", "denied"))
    scored = made.join(told.groupBy("anomaly_id").agg(F.max_by("decision", "at_ms").alias("decision")), "anomaly_id").select(
        F.col("device_id").alias("user_id"), F.col("alert_seq").alias("id"), (F.col("decision") == "approved").cast("int").alias("label"),
        (F.col("severity") + F.col("confidence")).cast("double").alias("score"))
    return AL.calibrate(scored, min_samples=min_samples).select(F.col("user_id").alias("device_id"), F.col("platt_slope").alias("slope"))


@query("e2e_scored_alerts")
def end_to_end_scored(spark, sf_dir):
    """The whole flow: the fleet's baseline as the start of every device, saved models, calibrated slopes, rules and fast paths."""
    kept = materialise(drop_ignored_devices(telemetry(spark, sf_dir), "dev_0"), "telemetry")
    store = scratch_dir(spark, "models")
    train_models(spark, sf_dir, store)
    mean, cov = fleet_start(spark, kept, scratch_dir(spark, "fleet-baseline"))
    cfg = replace(DETECTOR, generic_mean=mean, generic_cov=cov)
    return detect_alerts(kept, cfg, BAD_APPS, BAD_DOMAINS, IGNORED, mode="primary", models=load_models(spark, store), slopes=device_slopes(spark, sf_dir))
