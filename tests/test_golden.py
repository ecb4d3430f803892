"""Cases with results worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import adaptive as AD
from tidewatch.operators import federated as FL
from tidewatch.operators import phishing as H
from tidewatch.operators import rules as R
from tidewatch.operators import windows as W
from tidewatch.operators.detect import Whitener
from tidewatch.operators.features import feature_vectors
from tidewatch.operators.predicates import drop_ignored_devices
from tidewatch.schema import TELEMETRY

BASE = 1_700_000_000_000


def events(spark, rows, device="d1"):
    """rows: (event_type, package, payload[, ts offset])"""
    data = [
        (device, i, r[0], r[1], BASE + (r[3] if len(r) > 3 else i * 1000), r[2] if isinstance(r[2], str) else json.dumps(r[2]))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, TELEMETRY)


def one_window(df):
    return df.withColumn("window_id", F.lit(0).cast("long")).withColumn("pos", F.col("event_id").cast("int"))


def vector(df):
    row = feature_vectors(one_window(df)).first()
    return np.array(row["vector"]), np.array(row["mask"])


def sample_events(spark):
    apps = [f"com.app{i}" for i in range(6)]
    rows = [("APP_USAGE", apps[i % 6], {"totalTime": 1000}, i * 60_000) for i in range(30)]
    rows += [("KEYSTROKE", None, {"latency": 50 + 2 * i}, i * 1000) for i in range(20)]
    rows += [("TOUCH", None, {"duration": 100 + 10 * i}, i * 2000) for i in range(15)]
    rows += [("SWIPE", None, {"velocity": 500 + 50 * i}, i * 3000) for i in range(10)]
    return events(spark, rows)


def test_sample_vector(spark):
    v, m = vector(sample_events(spark))
    assert v.shape == (72,) and np.isfinite(v).all() and m.sum() == 72
    assert v[:24].sum() == pytest.approx(1.0)
    assert v[24:30] == pytest.approx([1 / 6] * 6) and (v[30:34] == 0).all()
    latency = np.array([50 + 2 * i for i in range(20)])
    assert v[52:57] == pytest.approx([latency.mean(), latency.std(), 50, 88, 0.2])
    assert v[67] == pytest.approx(75 / 500) and v[68] == pytest.approx(45 / 75)


def test_no_interaction_is_masked(spark):
    v, m = vector(events(spark, [("APP_USAGE", f"com.app{i % 3}", {}, i * 1000) for i in range(10)]))
    assert (v[52:67] == 0).all() and (m[52:67] == 0).all() and (m[:52] == 1).all()


def test_signals(spark):
    v, _ = vector(events(spark, [
        ("NETWORK_TRAFFIC", None, {"rxBytesDelta": 5_000_000, "txBytesDelta": 1_000_000}),
        ("NETWORK_APP", "com.a", {"uid": 10001, "rxBytesDelta": 1_000_000, "txBytesDelta": 500_000}),
        ("SECURITY_AUTH_EVENT", None, {"event": "USER_PRESENT"}),
        ("SYSTEM_STATE", None, {"lowMemory": True, "batteryPct": 12}),
        ("SYSTEM_LOGCAT_ACCESS", None, {"status": "restricted"}),
    ]))
    assert v[69] == pytest.approx(2 / 5 + (7_500_000 / 1048576 / 10) * 0.5)
    assert v[70] == pytest.approx(0.2) and v[71] == pytest.approx(1.0)


def test_string_false_is_not_low_memory(spark):
    v, _ = vector(events(spark, [("SYSTEM_STATE", None, {"lowMemory": "false"}, 0), ("TOUCH", None, {}, 0), ("TOUCH", None, {}, 0)]))
    assert v[71] == pytest.approx(1 / 3)


def rule(spark, rows, **lists):
    return R.rule_alerts(one_window(events(spark, rows)), **lists).collect()


def test_rule_cases(spark):
    assert rule(spark, [("APP_USAGE", "com.a", {}), ("TOUCH", "com.a", {"duration": 5})]) == []
    burst = rule(spark, [("SECURITY_PACKAGE_EVENT", "com.a", {"action": "PACKAGE_ADDED"}), ("SECURITY_PACKAGE_EVENT", "com.b", {})])[0]
    assert (burst["threat_type"], burst["severity"]) == ("INSIDER_THREAT", 8)
    stress_rows = [("SYSTEM_STATE", None, {"lowMemory": True, "batteryPct": 50}),
                   ("NETWORK_TRAFFIC", None, {"rxBytesDelta": 26 * 1024 * 1024, "txBytesDelta": 0})]
    stress = rule(spark, stress_rows)[0]
    assert (stress["threat_type"], stress["severity"]) == ("DEVICE_MISUSE", 8)
    assert "26.0 MB" in stress["message"]
    both = rule(spark, [("SECURITY_PACKAGE_EVENT", "com.a", {}), ("SECURITY_PACKAGE_EVENT", "com.b", {}), *stress_rows])[0]
    assert (both["threat_type"], both["severity"]) == ("DEVICE_MISUSE", 8)  # the later one of equal severity


def test_indicator_rules(spark):
    app = rule(spark, [("APP_USAGE", "COM.Bad.App ", {})], bad_apps=["com.bad.app"])[0]
    assert app["indicator"] == "app:com.bad.app" and app["severity"] == 9 and app["target_package"] == "com.bad.app"
    web = [("WEB_DOMAIN", "com.android.chrome", {"domain": "https://login.evil.test/path"})]
    domain = rule(spark, web, bad_domains=["evil.test"])[0]
    assert domain["indicator"] == "domain:login.evil.test" and domain["severity"] == 8
    assert rule(spark, web, bad_domains=["vil.test"]) == []
    assert rule(spark, [("APP_USAGE", "com.bad.app", {})], bad_apps=["com.bad.app"], ignored_packages=["com.bad.app"]) == []


def test_fast_paths(spark):
    tel = events(spark, [
        ("CANARY_FILE_ACCESS", "system_level", {"fileName": "tax.pdf", "action": "MODIFY"}),
        ("PERMISSION_ACCESS", "com.side", {"permission": "CAMERA", "isSideLoaded": True, "packageName": "com.side"}),
        ("PERMISSION_ACCESS", "com.ok", {"permission": "CAMERA", "isSideLoaded": False, "packageName": "com.ok"}),
        ("WEB_DOMAIN", "chrome", {"domain": "paypal-secure-login-update.tk", "tfliteScore": 0.85}),
    ])
    canary = R.canary_alerts(tel).collect()
    assert [(r["severity"], r["confidence"], r["indicator"]) for r in canary] == [(10, 0.99, "canary:tax.pdf")]
    perm = R.permission_alerts(tel).collect()
    assert [(r["severity"], r["indicator"]) for r in perm] == [(8, "perm:com.side:CAMERA")]
    phish = H.phishing_alerts(tel).first()
    assert phish["severity"] == 9 and phish["confidence"] == 1.0 and "impersonating paypal" in phish["message"] and "100%" in phish["message"]


def test_ignored_devices(spark):
    df = spark.createDataFrame([(x,) for x in ("ioc_test_device", "test_device_9", "IOC_TEST_x", "real", "")], "device_id string")
    kept = drop_ignored_devices(df, "ioc_test_device", "test_device_,ioc_test_").collect()
    assert [r[0] for r in kept] == ["real"]


@pytest.mark.parametrize("domain,model,exempt,score,kind,brand", [
    ("paypal-secure-login-update.tk", 0.85, True, 1.0, "phishing", "paypal"),
    ("google.com", None, True, 0.0, "safe", None),
    ("google.com", None, False, 0.5, "suspicious", "google"),
    ("mail.google.com", None, True, 0.0, "safe", None),
    ("faceb00k.com", None, True, 0.5, "suspicious", "facebook"),
    ("192.168.0.1", None, True, 0.45, "suspicious", None),
])
def test_phishing_cases(spark, domain, model, exempt, score, kind, brand):
    df = spark.createDataFrame([(domain, model)], "domain string, model double")
    row = H.analyse(df, "domain", None, "model", exempt).first()
    assert (row["risk_score"], row["classification"], row["matched_brand"]) == (score, kind, brand)


def test_federated_round(spark):
    updates = spark.createDataFrame(
        [("a", 1, 1, 10, [0.2, -0.1, 0.3]), ("b", 1, 1, 30, [0.0, 0.2, 0.1])],
        "client_id string, round_id int, base_model_version int, num_samples long, weights_delta array<double>")
    model = spark.createDataFrame([(1, 1, [])], "round_id int, version long, weights array<double>")
    row = FL.close_rounds(updates, model).first()
    assert row["weights"] == pytest.approx([0.05, 0.125, 0.15]) and row["version"] == 2 and row["next_round_id"] == 2
    waiting = FL.close_rounds(updates.limit(1), model).first()
    assert waiting["status"] == "waiting" and waiting["version"] == 1
    clients = spark.createDataFrame([("a",)], "client_id string")
    reasons = {r["client_id"]: r["reason"] for r in FL.check_updates(updates, clients, 1, 1, 3).collect()}
    assert reasons == {"a": None, "b": "client_id is not registered"}


def detect(x, **state):
    s = AD.DetectorState(distance_mean=8.0, distance_std=1.0, **state)
    return AD.step(s, {"vector": x, "mask": np.ones(72), "end_ms": BASE}, AD.DetectorConfig())


def _walk(*windows, **cfg):
    s = AD.DetectorState(distance_mean=8.0, distance_std=1.0)
    vectors = np.random.default_rng(4).normal(0, 0.1, (len(windows), 72))
    return [AD.step(s, {"vector": v, "mask": np.ones(72), "end_ms": BASE + 60_000 * i, **w}, AD.DetectorConfig(**cfg))
            for i, (v, w) in enumerate(zip(vectors, windows))]


def test_ensemble_hit_does_not_learn():
    hit = {"tabular_prob": 0.9, "text_prob": 0.9}
    assert [r["learned"] for r in _walk({}, hit, {}, ensemble_mode="primary")] == [True, False, True]
    # In fallback mode a window far from the threshold asks no model.
    assert [r["learned"] for r in _walk({}, hit, {}, ensemble_mode="fallback")] == [True, True, True]


def test_repeated_rule_alert_is_dropped_and_learns():
    rule = {"rule_hit": True, "rule_indicator": "App:X", "rule_threat": "MALWARE_MIMICRY", "rule_severity": 8}
    rows = _walk(rule, rule, {}, {**rule, "rule_indicator": "app:x"})
    assert [r["rule_passed"] for r in rows] == [True, False, False, True]  # 180 s later the cooldown of 120 s is over
    assert [r["learned"] for r in rows] == [False, True, True, False]
    mild = {**rule, "rule_threat": "USER_DRIFT", "rule_severity": 4}
    assert [r["learned"] for r in _walk(mild)] == [True]


def test_idle_windows_stay_out_of_the_cusum_history():
    s = AD.DetectorState(distance_mean=8.0, distance_std=1.0)
    for at in (0, 60_000, 10_000_000, 10_060_000):
        AD.step(s, {"vector": np.ones(72), "mask": np.ones(72), "end_ms": BASE + at}, AD.DetectorConfig())
    assert len(s.distances) == 4 and len(s.awake) == 3



def test_detector_cases():
    quiet = detect(np.random.default_rng(1).normal(0, 0.5, 72))
    assert not quiet["is_anomaly"] and quiet["threat_type"] == "NONE"
    loud = detect(np.ones(72) * 20)
    assert loud["distance"] == pytest.approx(20 * math.sqrt(72) / math.sqrt(1 + 1e-6)) and loud["threshold"] == 11.0
    assert loud["is_anomaly"] and 1 <= loud["severity"] <= 10
    seq, act = np.zeros(72), np.zeros(72)
    seq[24:52], act[52:] = 15, 15
    assert detect(seq)["threat_type"] == "MALWARE_MIMICRY"
    assert detect(act)["threat_type"] == "INSIDER_THREAT"
    for factor in (0.1, 1, 5, 20):
        assert 1 <= detect(np.ones(72) * factor)["severity"] <= 10


def test_window_tail_and_idle(spark):
    tel = events(spark, [("TOUCH", None, {}, i * 1000) for i in range(12)])
    assert W.count_windows(tel).count() == 10
    gap = events(spark, [("TOUCH", None, {}, i * 1000 + (7_200_000 if i >= 4 else 0)) for i in range(12)])
    out = W.count_windows(gap, idle_ms=3_600_000).select("window_id").distinct().count()
    assert out == 1  # four expire, then eight give one window


def test_masked_distance_is_scaled():
    w = Whitener(np.zeros(4), np.eye(4), ridge=0.0)
    d, _ = w.score(np.array([[3.0, 4.0, 9.0, 9.0]]), np.array([[1.0, 1.0, 0.0, 0.0]]))
    assert d[0] == pytest.approx(5 * math.sqrt(2))
    assert w.score(np.ones((1, 4)), np.zeros((1, 4)))[0][0] == 0.0
