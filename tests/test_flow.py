"""One device through the branches of the whole flow, and models that are saved and loaded."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import adaptive as AD
from tidewatch.operators import aggregates as A
from tidewatch.operators import inputs as IN
from tidewatch.operators import windows as W
from tidewatch.plans import flow, learning
from tidewatch.session import scratch_dir
from tidewatch.settings import ENSEMBLE_DEFAULTS
from tidewatch.sources.artifacts import WindowModels, load_models, save_models

SF = "/root/testdata/sf0.001"
MINUTE = 60_000


def _event(i, kind, package=None, data=None, at=None):
    return ("d", i, kind, package, (1000 + i) * MINUTE if at is None else at, json.dumps(data or {}))


def test_one_device_through_all_branches(spark):
    calm = [_event(i, "APP_USAGE", "com.mail", {"totalTime": 5}) for i in range(10)]
    odd = [
        _event(10, "SECURITY_PACKAGE_EVENT", "com.evil", {"action": "PACKAGE_ADDED", "package": "com.evil"}),
        _event(11, "PERMISSION_ACCESS", "com.side", {"permission": "CAMERA", "isSideLoaded": True, "packageName": "com.side"}),
        _event(12, "WEB_DOMAIN", "com.browser", {"domain": "paypa1-secure-login.tk", "url": "http://paypa1-secure-login.tk/verify"}),
        _event(13, "CANARY_FILE_ACCESS", None, {"fileName": "pay.xls", "action": "DELETE"}),
        _event(14, "CANARY_FILE_ACCESS", None, {"fileName": "PAY.xls", "action": "DELETE"}, at=1013 * MINUTE + 100_000),
    ]
    later = [_event(15 + i, "CANARY_FILE_ACCESS" if i == 4 else "TOUCH", None, {"fileName": "pay.xls", "action": "READ", "duration": 9}) for i in range(5)]
    tel = spark.createDataFrame([*calm, *odd, *later], "device_id string, event_id long, event_type string, package_name string, ts_ms long, data string")
    windows = W.count_windows(tel)
    scores = windows.select("device_id", "window_id").distinct().select("device_id", "window_id", F.lit(0.99).alias("tabular_prob"), F.lit(0.98).alias("text_prob"))
    slopes = spark.createDataFrame([("d", 0.25)], "device_id string, slope double")
    mean, cov = [0.0] * 72, (np.eye(72) * 1e-4).ravel().tolist()
    cfg = AD.DetectorConfig(generic_mean=mean, generic_cov=cov)
    rows = flow.detect_alerts(tel, cfg, ["com.evil"], [], [], scores, "primary", slopes=slopes).collect()
    fast = {(r.source, r.created_ms): r for r in rows if r.window_id is None}
    # Decoy files: the second touch comes within the cooldown of the first, whatever the case of the name; the last one does not.
    assert sorted(k for k in fast) == [
        ("canary-manager", 1013 * MINUTE), ("canary-manager", 1019 * MINUTE), ("permission-monitor", 1011 * MINUTE), ("phishing-analyzer", 1012 * MINUTE)]
    assert fast["canary-manager", 1013 * MINUTE].severity == 10 and fast["canary-manager", 1013 * MINUTE].status == "approved"
    assert fast["permission-monitor", 1011 * MINUTE].severity == 8 and "com.side" in fast["permission-monitor", 1011 * MINUTE].message
    assert fast["phishing-analyzer", 1012 * MINUTE].severity in (6, 9) and json.loads(fast["phishing-analyzer", 1012 * MINUTE].xai)["rule"]["indicator"].startswith("phishing:")
    slow = {r.window_id: r for r in rows if r.window_id is not None}
    # A rule, the models and the sensitive permission meet in the third window, which therefore trains nothing.
    assert "ensemble" in slow[2].source and "rule" in slow[2].source and slow[2].severity >= 9
    told = {r.window_id: r for r in AD.run_detector(IN.detector_inputs(windows, ["com.evil"], [], [], scores, slopes), cfg).collect()}
    plain = {r.window_id: r for r in AD.run_detector(IN.detector_inputs(windows, ["com.evil"], [], [], scores), cfg).collect()}
    assert not told[2].learned and told[2].rule_passed and told.keys() == plain.keys()
    near = [w for w in told if abs(told[w].distance**2 - told[w].threshold**2) < 100]
    assert all(told[w].probability != plain[w].probability for w in near)


def test_saved_models_score_as_the_fitted_ones(spark):
    rows = learning.connections(spark, SF)
    tabular = learning.M.train_tabular(rows, trees=5)
    text = learning.M.train_text(learning.log_texts(spark, SF, include_level=False), "text")
    fitted = WindowModels(tabular, text, dict(ENSEMBLE_DEFAULTS))
    path = scratch_dir(spark, "models")
    with pytest.raises(FileNotFoundError):
        load_models(spark, path)
    assert [save_models(spark, path, fitted), save_models(spark, path, WindowModels(tabular, text, {"t_text": 0.5}))] == [1, 2]
    assert load_models(spark, path).config == {"t_text": 0.5} and load_models(spark, path, 1).config == ENSEMBLE_DEFAULTS
    samples = A.text_samples(W.count_windows(learning.telemetry(spark, SF)))
    want, got = ({(r[0], r[1]): r[2:] for r in m.scores(rows, samples).collect()} for m in (fitted, load_models(spark, path)))
    assert want.keys() == got.keys() and want
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_fleet_start_is_the_stored_fit_of_all_windows(spark):
    tel = learning.telemetry(spark, SF)
    mean, cov = flow.fleet_start(spark, tel, scratch_dir(spark, "fleet"))
    inputs = IN.detector_inputs(W.count_windows(tel)).select("vector").collect()
    x = np.array([r.vector for r in inputs])
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.reshape(cov, (72, 72)), np.cov(x.T), atol=1e-9)
