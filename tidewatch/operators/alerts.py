"""From findings to alerts: ensemble, merge, response plan, explanation, feedback and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import number_rows
from tidewatch.functions.text import fixed
from tidewatch.operators.baseline import update_baselines
from tidewatch.operators.detect import factor_texts
from tidewatch.session import materialise
from tidewatch.settings import ENSEMBLE_DEFAULTS, K_SIGMA, PLATT_SLOPE, RESPONSE_ACTIONS

TABULAR, TEXT = "nsl-rf", "loghub-text"
SENSITIVE = ["CAMERA", "RECORD_AUDIO", "FINE_LOCATION"]


def two(value: Column) -> Column:
    return fixed(value, 2)


# --- ensemble ---------------------------------------------------------------------------


def combine_scores(tabular: Column, text: Column, cfg: dict[str, float]) -> Column:
    """Weighted mean of the scores that are there; plain mean when the weights are zero."""
    wa = F.when(tabular.isNotNull(), max(0.0, cfg["w_tabular"])).otherwise(0.0)
    wb = F.when(text.isNotNull(), max(0.0, cfg["w_text"])).otherwise(0.0)
    a, b = F.coalesce(tabular, F.lit(0.0)), F.coalesce(text, F.lit(0.0))
    n = tabular.isNotNull().cast("int") + text.isNotNull().cast("int")
    return F.when(wa + wb > 0, (wa * a + wb * b) / (wa + wb)).when(n > 0, (a + b) / n).otherwise(0.0)


def ensemble_decision(df: DataFrame, cfg: dict[str, float] | None = None, mode: str = "fallback") -> DataFrame:
    """Adds the decision of the two supervised models (``tabular_prob``, ``text_prob``).

    In fallback mode only windows near the threshold ask the models.
    """
    cfg = {**ENSEMBLE_DEFAULTS, **(cfg or {})}
    ratio = F.when(F.col("threshold") > 0, F.col("distance") / F.col("threshold"))
    asked = {"primary": F.lit(True), "fallback": F.coalesce((ratio > 0.8) & (ratio < 1.2), F.lit(False))}.get(mode, F.lit(False))
    a, b = F.when(asked, F.col("tabular_prob")), F.when(asked, F.col("text_prob"))
    raw = combine_scores(a, b, cfg)
    hit_a, hit_b = F.coalesce(a >= cfg["t_tabular"], F.lit(False)), F.coalesce(b >= cfg["t_text"], F.lit(False))
    any_model = a.isNotNull() | b.isNotNull()
    return (
        df.withColumn("ensemble_asked", asked)
        .withColumn("ensemble_score", F.bround(raw, 4))
        .withColumn("ensemble_pred", any_model & ((raw >= cfg["t_ensemble"]) | hit_a | hit_b))
        .withColumn("_sa", F.bround(F.coalesce(a, F.lit(0.0)), 4)).withColumn("_sb", F.bround(F.coalesce(b, F.lit(0.0)), 4))
        .withColumn("_names", F.concat_ws(", ", F.when(a.isNotNull(), TABULAR), F.when(b.isNotNull(), TEXT)))
    )


def raise_by_ensemble(df: DataFrame) -> DataFrame:
    """A positive ensemble makes a finding, or strengthens one that is there already."""
    hit, score, was = F.col("ensemble_pred"), F.col("ensemble_score"), F.col("is_anomaly")
    suffix = F.concat(
        F.lit("Ensemble ML ("), F.when(F.col("_names") == "", "ensemble").otherwise(F.col("_names")), F.lit(") score="), two(score),
        F.lit(" (nsl="), two(F.col("_sa")), F.lit(", loghub="), two(F.col("_sb")), F.lit(")."),
    )
    level = F.when(was, F.when(score >= 0.70, F.least(F.lit(10), F.col("severity") + 1)).otherwise(F.col("severity"))).otherwise(
        F.greatest(F.col("severity"), F.lit(7)))
    sure = F.when(was, F.greatest("confidence", F.least(F.lit(0.99), score + 0.12))).otherwise(
        F.greatest("confidence", F.least(F.lit(0.98), score + 0.20)))
    text = F.when(was, F.concat_ws(" | ", "message", suffix)).otherwise(
        F.concat(F.lit("Supervised ensemble flagged suspicious behavior. "), suffix))
    changed = {
        "severity": level.cast("int"), "confidence": sure, "message": text,
        "threat_type": F.when(~was & (F.col("threat_type") == "NONE"), "DEVICE_MISUSE").otherwise(F.col("threat_type")),
        "is_anomaly": F.lit(True),
    }
    return df.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])


def escalate_sensitive(df: DataFrame, flag: str = "sensitive_permission") -> DataFrame:
    hit = F.col("is_anomaly") & F.col(flag)
    changed = {
        "severity": F.least(F.lit(10), F.col("severity") + 2).cast("int"), "threat_type": F.lit("INSIDER_THREAT"),
        "message": F.concat("message", F.lit(" | Escalate: Correlated with sensitive permission access.")),
    }
    return df.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])


def merge_findings(df: DataFrame) -> DataFrame:
    """One alert per suspicious window from the model finding and the rule (``rule`` struct or null)."""
    model, rule = F.col("is_anomaly"), F.col("rule").isNotNull()
    r = lambda c: F.col(f"rule.{c}")
    only_rule, both = ~model & rule, model & rule
    stronger = both & (r("severity") > F.col("severity"))
    use_rule = only_rule | stronger
    source = F.concat(
        F.when(only_rule, "rule").when(both, "model+rule").otherwise("model"),
        F.when(F.col("ensemble_pred"), "+ensemble").otherwise(""),
    )
    threat = F.when(use_rule, r("threat_type")).otherwise(F.col("threat_type"))
    sure = F.when(only_rule, r("confidence")).when(both, F.greatest("confidence", r("confidence"))).otherwise(F.col("confidence"))
    text = F.when(use_rule, r("message")).when(both, F.concat_ws(" | ", "message", r("message"))).otherwise(F.col("message"))
    out = df.filter(model | rule).select(
        *[c for c in df.columns if c not in ("severity", "threat_type", "message", "confidence", "distance")],
        F.when(use_rule, r("severity")).otherwise(F.col("severity")).cast("int").alias("severity"), threat.alias("threat_type"),
        text.alias("message"), sure.alias("confidence"), F.when(only_rule, 0.0).otherwise(F.col("distance")).alias("distance"),
        source.alias("source"), r("indicator").alias("indicator"),
    )
    approved = (F.col("threat_type") == "MALWARE_MIMICRY") & (F.col("confidence") > 0.95)
    return out.withColumn("status", F.when(approved, "approved").otherwise("pending")).withColumn("action_executed", approved)


def response_plan(severity: Column, package: Column, uid: Column) -> Column:
    """Recommended actions of a severity; those without a target are left out."""
    names = lambda band: F.array(*[F.lit(a) for a in RESPONSE_ACTIONS[band]])
    planned = F.when(severity <= 3, F.array().cast("array<string>")).when(severity <= 6, names("medium")).when(
        severity <= 8, names("high")).otherwise(names("critical"))
    has_package = F.coalesce(package, F.lit("")) != ""

    def possible(a: Column) -> Column:
        return F.when(a.isin("kill_process", "quarantine_app", "uninstall_app"), has_package).when(
            a == "block_network", uid.isNotNull()).otherwise(True)

    def planned_action(a: Column) -> Column:
        return F.struct(
            a.alias("name"),
            F.when(a.isin("kill_process", "quarantine_app", "uninstall_app"), package).alias("target_package"),
            F.when(a == "block_network", uid.cast("long")).alias("target_uid"),
        )

    return F.transform(F.filter(planned, possible), planned_action)


def explain(df: DataFrame) -> DataFrame:
    """Adds ``xai``: a structured explanation of each alert.

    Needs the alert columns plus n, span_seconds, top_event_types, dominant_package,
    threshold (null without a model), contributions and ensemble columns (may be null).
    """
    d, t = F.col("distance"), F.col("threshold")
    has_model = F.coalesce(t > 0, F.lit(False))
    ratio = F.when(has_model, F.bround(d / t, 3))
    sure, n = two(F.col("confidence")), F.col("n").cast("string")
    tagged = F.coalesce(F.trim("indicator"), F.lit("")) != ""
    head = F.concat(F.col("threat_type"), F.lit(" risk: "))
    summary = (
        F.when(has_model, F.concat(head, n, F.lit(" events in this window; distance "), two(d), F.lit(" vs threshold "), two(t),
                                   F.lit(" ("), two(ratio), F.lit("x), confidence "), sure, F.lit(".")))
        .when(tagged, F.concat(head, F.lit("matched indicator "), F.col("indicator"), F.lit(" across "), n,
                               F.lit(" recent events (confidence "), sure, F.lit(").")))
        .otherwise(F.concat(head, n, F.lit(" recent events triggered security rules (confidence "), sure, F.lit(").")))
    )
    asked = F.col("ensemble_score").isNotNull()
    types = F.array_join(
        F.transform("top_event_types", lambda e: F.concat(e["event_type"], F.lit(" x"), e["n"].cast("string"))), ", ")
    none = F.array().cast("array<string>")
    factors = F.concat(
        F.array(F.when(has_model, F.concat(F.lit("Model anomaly score crossed threshold ("), two(d), F.lit(" > "), two(t), F.lit(").")))),
        F.when(has_model & F.col("contributions").isNotNull(), factor_texts(F.col("contributions"))).otherwise(none),
        F.array(
            F.when(asked, F.concat(F.lit("Supervised ensemble score "), two(F.col("ensemble_score")), F.lit("."))),
            F.when(asked & F.col("ensemble_pred"), F.lit("Ensemble threshold exceeded, increasing attack recall sensitivity.")),
            F.when(tagged, F.concat(F.lit("Matched configured threat indicator: "), F.col("indicator"), F.lit("."))),
            F.when(F.col("dominant_package").isNotNull(), F.concat(F.lit("Dominant package in window: "), F.col("dominant_package"), F.lit("."))),
            F.when(F.size("top_event_types") > 0, F.concat(F.lit("Top activity types: "), types, F.lit("."))),
            F.when(F.col("span_seconds").isNotNull(), F.concat(F.lit("Behavioral window span: "), two(F.col("span_seconds")), F.lit("s."))),
        ),
    )
    return df.withColumn("xai", F.struct(
        F.lit("xai-v1").alias("version"), summary.alias("summary"), F.col("source"), F.col("threat_type"), F.col("severity"),
        F.bround("confidence", 3).alias("confidence"), F.col("message"), F.slice(F.array_compact(factors), 1, 5).alias("factors"),
        F.struct(F.col("n").alias("event_count"), "span_seconds", "top_event_types", "dominant_package").alias("window"),
        F.struct(F.bround(d, 4).alias("distance"), F.when(has_model, F.bround(t, 4)).alias("threshold"), ratio.alias("distance_ratio"),
                 F.when(asked, F.struct("ensemble_score", "ensemble_pred")).alias("ensemble")).alias("model"),
        F.struct(F.when(tagged, F.col("indicator")).alias("indicator")).alias("rule"),
    ))


# --- feedback ---------------------------------------------------------------------------

DECISIONS = ["approved", "denied", "normal"]


def apply_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Status and response time of the latest decision per alert (anomaly_id, decision, at_ms)."""
    latest = feedback.filter(F.col("decision").isin(*DECISIONS)).groupBy("anomaly_id").agg(
        F.max_by("decision", "at_ms").alias("_decision"), F.max("at_ms").alias("responded_ms"))
    return (
        alerts.join(latest, "anomaly_id", "left").withColumn("status", F.coalesce("_decision", "status")).drop("_decision")
    )


def learn_from_feedback(alerts: DataFrame, feedback: DataFrame, baselines: DataFrame, key: str = "device_id") -> DataFrame:
    """Baselines after alerts marked normal were learned with raised weight, in decision order."""
    normal = feedback.filter(F.col("decision") == "normal").select("anomaly_id", "at_ms")
    told = alerts.filter(F.col("feature_vector").isNotNull()).join(normal, "anomaly_id").select(
        key, "at_ms", F.col("feature_vector").alias("vector"), F.lit(True).alias("learn"), F.lit(True).alias("drift"))
    return update_baselines(told, baselines.join(told.select(key).distinct(), key, "left_semi"), key, "at_ms")


# --- per-user calibration ---------------------------------------------------------------


def calibrate(scored: DataFrame, min_samples: int = 100, tolerance: float = 1e-9, most: int = 60, folds: int = 5, dim: int = 72) -> DataFrame:
    """Slope and threshold of a logistic curve per user (user_id, id, score, label 0/1).

    All users and all cross-validation folds are fitted together by Newton steps; each step
    is one aggregation that shuffles five sums per model, so a user may have any number of
    scores. Steps are taken until none changes by more than ``tolerance``. The penalty on the
    slope is 1/2 * slope^2. Users with too few scores or only one class get the defaults, and so
    do users whose model still moves after ``most`` steps; ``converged`` tells them apart.
    """
    stats = scored.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"),
        F.sum("label").alias("positives"))
    usable = stats.filter((F.col("n") >= min_samples) & (F.col("positives") > 0) & (F.col("positives") < F.col("n")) & (F.col("sd") > 0))
    # Fold of a row: rows of a class are dealt out in blocks so that every fold has its share.
    placed = number_rows(scored.withColumn("_zero", F.col("id")), ["user_id", "label"], ts_ms="_zero", tie="id", target="_rank", bucket_ms=100_000)
    joined = placed.join(usable, "user_id")
    first = F.when(F.col("label") == 0, 0).otherwise(F.col("n") - F.col("positives"))
    size = F.when(F.col("label") == 0, F.col("n") - F.col("positives")).otherwise(F.col("positives"))
    running = F.lit(0)
    fold = F.lit(folds - 1)
    bounds = []
    for i in range(folds):
        running = running + F.floor((first + size - 1 - i) / folds) - F.floor((first - 1 - i) / folds)
        bounds.append(running)
    for i in reversed(range(folds)):
        fold = F.when(F.col("_rank") < bounds[i], i).otherwise(fold)
    data = materialise(
        joined.select("user_id", ((F.col("score") - F.col("mu")) / F.col("sd")).alias("x"), F.col("label").cast("double").alias("y"), fold.alias("fold")),
        "calibration")
    models = usable.select("user_id", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))).alias("model"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("step"))
    models = materialise(models, "calibration-0")
    for i in range(most):
        seen = data.join(models, "user_id").filter(F.col("model") != F.col("fold"))
        p = 1.0 / (1.0 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        w, r = p * (1.0 - p), p - F.col("y")
        sums = seen.groupBy("user_id", "model", "a", "b").agg(
            F.sum(r * F.col("x")).alias("g0"), F.sum(r).alias("g1"), F.sum(w * F.col("x") * F.col("x")).alias("h00"),
            F.sum(w * F.col("x")).alias("h01"), F.sum(w).alias("h11"))
        g0, h00 = F.col("g0") + F.col("a"), F.col("h00") + 1.0
        det = h00 * F.col("h11") - F.col("h01") * F.col("h01")
        da, db = (F.col("h11") * g0 - F.col("h01") * F.col("g1")) / det, (h00 * F.col("g1") - F.col("h01") * g0) / det
        models = materialise(sums.select(
            "user_id", "model", (F.col("a") - da).alias("a"), (F.col("b") - db).alias("b"),
            F.greatest(F.abs(da), F.abs(db)).alias("step")), f"calibration-{i + 1}")
        worst = models.agg(F.max("step")).first()[0]
        if worst is None or worst <= tolerance:
            break
    full = models.filter("model = -1").select("user_id", "a", "b", (F.col("step") <= tolerance).alias("converged"))
    right = (
        data.join(models.withColumnRenamed("model", "fold"), ["user_id", "fold"])
        .groupBy("user_id", "fold").agg(F.avg(((F.col("a") * F.col("x") + F.col("b") > 0).cast("double") == F.col("y")).cast("double")).alias("acc"))
        .groupBy("user_id").agg(F.avg("acc").alias("_acc")))
    fitted = stats.join(full, "user_id", "left").join(right, "user_id", "left")
    ok = F.coalesce((F.abs("a") >= 1e-10) & F.col("converged"), F.lit(False))
    default_limit = K_SIGMA * F.sqrt(F.lit(float(dim)))
    return fitted.select(
        "user_id", "n", F.when(ok, F.col("a")).otherwise(PLATT_SLOPE).alias("platt_slope"),
        F.when(ok, -F.col("b") / F.col("a")).alias("scaled_threshold"),
        F.when(ok, F.col("mu") - F.col("sd") * F.col("b") / F.col("a")).otherwise(default_limit).alias("optimal_threshold"),
        F.coalesce("_acc", F.lit(0.0)).alias("calibration_score"), "converged",
    )
