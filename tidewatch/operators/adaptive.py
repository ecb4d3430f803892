"""The per-device detector: score, classify, track drift and learn, window after window.

One step function serves the batch fold and the stream, so both give the same results.
Everything a step needs is in ``DetectorState``; its size does not grow with the history.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ordered import ordered_fold
from tidewatch.operators.baseline import PowerMoments, ema_update, ensure_psd, learning_rate, refit_now, transform_one
from tidewatch.operators.detect import contribution_map, whiten_one
from tidewatch.settings import (
    COOLDOWN_SECONDS, CUSUM_C1, CUSUM_C2, CUSUM_H, CUSUM_WINDOW, EMA_RATE, ENSEMBLE_DEFAULTS, IDLE_SECONDS, INTERACTION, K_SIGMA, PLATT_SLOPE, SEQUENTIAL, TEMPORAL,
    TZ_SHIFT_MULTIPLIER,
)

DAY_MS = 86_400_000
LONG_HISTORY = 2000


@dataclass
class DetectorConfig:
    k: float = K_SIGMA
    slope: float = PLATT_SLOPE
    idle_ms: int = IDLE_SECONDS * 1000
    ema_rate: float = EMA_RATE
    smoothing: int = 5
    stability_ratio: float = 0.3
    stability_least: int = 200
    drift_limit: int = 5
    cooldown_ms: int = COOLDOWN_SECONDS * 1000
    ensemble_mode: str = "fallback"
    power_first: int = 100  # windows after which the power transform is fitted first; 0: never
    power_every: int = 5000
    generic_mean: list[float] | None = None
    generic_cov: list[float] | None = None


@dataclass
class DetectorState:
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None
    n: int = 0
    distance_mean: float = 0.0
    distance_std: float = 1.0
    cusum_pos: float = 0.0
    cusum_neg: float = 0.0
    cusum_h: float = CUSUM_H
    first_ms: int = 0
    last_ms: int = 0
    tz: int | None = None
    tz_until: int = 0
    probabilities: list[float] = field(default_factory=list)
    distances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    awake: np.ndarray = field(default_factory=lambda: np.zeros(0))  # distances of windows that updated the CUSUM
    alerted: dict[str, int] = field(default_factory=dict)  # indicator of a rule alert -> when it was last let through
    lambdas: np.ndarray | None = None
    power: PowerMoments | None = None


@cache
def _unit_baseline(dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(dim), np.eye(dim)


def generic_baseline(cfg: DetectorConfig, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if cfg.generic_mean is None:
        return _unit_baseline(dim)
    return np.asarray(cfg.generic_mean, float), np.asarray(cfg.generic_cov, float).reshape(dim, dim)


def _probability(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1.0 + np.exp(z)))


def _stability(distances: np.ndarray, least: int) -> float:
    if len(distances) < least:
        return 1.0
    near, spread = distances[-50:], float(np.std(distances))
    return 0.0 if spread < 1e-6 else float(np.median(np.abs(near - np.median(near))) / spread)


def _severity(z: float, anomalous: bool) -> int:
    if not anomalous:
        return max(1, min(3, int(z + 1)))
    for bound, level in ((4, 5), (6, 7), (8, 8)):
        if z < bound:
            return level
    return min(10, int(z) + 1)


def _given(value) -> bool:
    return value is not None and not pd.isna(value)


def ensemble_hit(window: dict, d: float, limit: float, cfg: DetectorConfig) -> bool:
    """Whether the two models call the window an attack; the same decision as ``alerts.ensemble_decision``."""
    asked = cfg.ensemble_mode == "primary" or (cfg.ensemble_mode == "fallback" and limit > 0 and 0.8 < d / limit < 1.2)
    e, scores = ENSEMBLE_DEFAULTS, {}
    for name in ("tabular", "text"):
        if asked and _given(p := window.get(f"{name}_prob")):
            scores[name] = float(p)
    if not scores:
        return False
    mean = sum(e[f"w_{k}"] * p for k, p in scores.items()) / sum(e[f"w_{k}"] for k in scores)
    return mean >= e["t_ensemble"] or any(p >= e[f"t_{k}"] for k, p in scores.items())


def rule_passes(state: DetectorState, window: dict, anomalous: bool, now: int, cfg: DetectorConfig) -> bool:
    """Whether the rule alert of a window is let through. Without an anomaly beside it, an indicator rests after an alert.

    Indicators are forgotten when they have rested, so the state holds those of one cooldown only.
    """
    if not (_given(window.get("rule_hit")) and window["rule_hit"]):
        return False
    indicator = window.get("rule_indicator")
    if anomalous or not _given(indicator):
        return True
    state.alerted = {k: t for k, t in state.alerted.items() if now - t < cfg.cooldown_ms}
    if (name := str(indicator).lower()) in state.alerted:
        return False
    state.alerted[name] = now
    return True


def step(state: DetectorState, window: dict, cfg: DetectorConfig) -> dict:
    """Advances ``state`` by one window (vector, mask, end_ms) and returns its result.

    Optional fields: tz_offset; rule_hit, rule_indicator, rule_threat, rule_severity; tabular_prob, text_prob; sensitive (a
    sensitive permission was used); slope (the device's own). They decide, as in the alert that is made of them later,
    whether the window counts as suspicious and may train the baseline.

    The vector is transformed by the lambdas of the device before it is scored. They are fitted on the moments of the vectors that trained the
    baseline, first after ``power_first`` windows, then every ``power_every``.
    """
    x, mask, now = np.asarray(window["vector"], float), np.asarray(window["mask"], float), int(window["end_ms"])
    plain = x
    if state.lambdas is not None:
        x = transform_one(x, state.lambdas)
    transformed = state.lambdas is not None
    if state.first_ms == 0:
        state.first_ms = state.last_ms = now
    tz = window.get("tz_offset")
    if tz is not None and not pd.isna(tz):
        if state.tz is not None and state.tz != int(tz):
            state.tz_until = now + DAY_MS
        state.tz = int(tz)

    generic_mean, generic_cov = generic_baseline(cfg, len(x))
    if state.mean is None:
        mean, cov = generic_mean, generic_cov
    else:
        progress = (now - state.first_ms - DAY_MS) / (7 * DAY_MS)
        w = 1.0 - min(1.0, max(0.0, progress))
        mean = w * generic_mean + (1 - w) * state.mean if w else state.mean
        cov = ensure_psd(w * generic_cov + (1 - w) * state.cov if w else state.cov, generic_cov)

    parts = whiten_one(mean, cov, (x - mean) * mask)
    observed = mask.sum()
    d = float(np.sqrt(parts.sum() * len(x) / observed)) if observed > 0 else 0.0
    limit = state.distance_mean + cfg.k * state.distance_std if state.distance_std > 0 else cfg.k * np.sqrt(len(x))
    if state.tz_until > now:
        limit *= TZ_SHIFT_MULTIPLIER
    anomalous = d > limit
    slope = float(window["slope"]) if _given(window.get("slope")) else cfg.slope
    raw = _probability(slope * (d * d - limit * limit))
    recent = [*state.probabilities, raw][-cfg.smoothing:]
    state.probabilities = recent
    probability = raw if len(recent) < cfg.smoothing else float(np.median(recent))
    state.distances = np.append(state.distances, d)[-LONG_HISTORY:]

    z = d / (limit / cfg.k) if limit > 0 else 0.0
    threat, level = "NONE", _severity(z, anomalous)
    if anomalous:
        diff = x - mean
        t, s, i = (float(np.linalg.norm(diff[a:b])) for a, b in (TEMPORAL, SEQUENTIAL, INTERACTION))
        if s > 2 * t and d > 2 * limit:
            threat = "MALWARE_MIMICRY"
        elif i > 2 * t:
            threat = "INSIDER_THREAT"
        elif abs(state.cusum_pos) + abs(state.cusum_neg) > state.cusum_h and d < 1.5 * limit:
            threat = "USER_DRIFT"
        else:
            threat = "DEVICE_MISUSE"
    elif len(state.distances) >= 50 and d > 0.5 * limit and _stability(state.distances, cfg.stability_least) < cfg.stability_ratio:
        threat, level = "ADVERSARIAL_MIMICRY", max(1, min(3, int(3 * d / (limit + 1e-6))))

    rule = rule_passes(state, window, anomalous, now, cfg)
    flagged, acting, acting_level = anomalous, threat, level
    if not anomalous and ensemble_hit(window, d, limit, cfg):
        flagged, acting_level = True, max(level, 7)
        acting = "DEVICE_MISUSE" if threat == "NONE" else threat
    if flagged and _given(window.get("sensitive")) and window["sensitive"]:
        acting, acting_level = "INSIDER_THREAT", min(10, acting_level + 2)
    if not flagged and rule:
        acting, acting_level = window.get("rule_threat"), window.get("rule_severity")
    suspicious = flagged or rule
    awake = now - state.last_ms <= cfg.idle_ms
    drift = False
    if awake:
        state.awake = history = np.append(state.awake, d)[-CUSUM_WINDOW:]
        sigma = max(float(np.std(history)), 0.01) if len(history) > 10 else 1.0
        delta, state.cusum_h = CUSUM_C1 * sigma, CUSUM_C2 * sigma
        off = d - state.distance_mean
        state.cusum_pos = max(0.0, state.cusum_pos + off - delta)
        state.cusum_neg = max(0.0, state.cusum_neg - off - delta)
        drift = state.cusum_pos > state.cusum_h or state.cusum_neg > state.cusum_h
        if drift:
            state.cusum_pos = state.cusum_neg = 0.0
        a = cfg.ema_rate / (1 + state.n / 500.0)
        variance = (1 - a) * state.distance_std**2 + a * off * off
        state.distance_mean = (1 - a) * state.distance_mean + a * d
        state.distance_std = float(np.sqrt(max(variance, 1e-8)))
    learned = awake and (not suspicious or (acting == "USER_DRIFT" and acting_level <= cfg.drift_limit))
    if learned:
        state.mean, state.cov = ema_update(mean, cov, x, learning_rate(state.n, drift, cfg.ema_rate))
        if cfg.power_first:
            state.power = state.power or PowerMoments.empty(len(x))
            state.power.add(plain)
    elif state.mean is None:
        state.mean, state.cov = mean, cov
    if cfg.power_first and state.power is not None and state.power.n > 1 and refit_now(state.n, cfg.power_first, cfg.power_every):
        state.lambdas, state.power = state.power.fitted()
    state.n += 1
    state.last_ms = now
    return {
        "distance": d, "threshold": float(limit), "is_anomaly": bool(anomalous), "probability": probability, "threat_type": threat,
        "severity": level, "drift": bool(drift), "learned": bool(learned), "rule_passed": bool(rule), "transformed": transformed, "contributions": contribution_map(parts),
        "distance_mean": state.distance_mean, "distance_std": state.distance_std, "cusum_pos": state.cusum_pos,
        "cusum_neg": state.cusum_neg, "cusum_h": state.cusum_h,
    }


RESULT_DDL = (
    "device_id string, window_id bigint, end_ms bigint, distance double, threshold double, is_anomaly boolean, probability double, "
    "threat_type string, severity int, drift boolean, learned boolean, rule_passed boolean, transformed boolean, contributions map<int,double>, distance_mean double, "
    "distance_std double, cusum_pos double, cusum_neg double, cusum_h double"
)


OPTIONAL = {
    "tz_offset": "bigint", "rule_hit": "boolean", "rule_indicator": "string", "rule_threat": "string", "rule_severity": "int",
    "tabular_prob": "double", "text_prob": "double", "sensitive": "boolean", "slope": "double",
}


def with_optional(windows: DataFrame) -> DataFrame:
    """What ``step`` reads of a window; optional fields that are not there are null."""
    df = windows.withColumns({n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in windows.columns})
    return df.select("device_id", "window_id", "end_ms", "vector", "mask", *[F.col(n).cast(kind).alias(n) for n, kind in OPTIONAL.items()])


def run_detector(windows: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """Detector results for windows (device_id, window_id, end_ms, vector, mask, and the optional fields of ``step``).

    Each window depends on what was learned before, so a device is walked in window order;
    its windows are streamed past one fixed-size state.
    """
    cfg = cfg or DetectorConfig()
    df = with_optional(windows)

    if cfg.generic_mean is not None:
        cfg = replace(cfg, generic_mean=np.asarray(cfg.generic_mean, float), generic_cov=np.asarray(cfg.generic_cov, float))

    def walk(state: DetectorState, part: pd.DataFrame) -> list[dict]:
        rows, names = [], list(part.columns)
        for values in zip(*(part[c] for c in names)):
            record = dict(zip(names, values))
            result = step(state, record, cfg)
            rows.append({"device_id": record["device_id"], "window_id": record["window_id"], "end_ms": record["end_ms"], **result})
        return rows

    return ordered_fold(df, ["device_id"], ["window_id"], lambda part: DetectorState(), walk, RESULT_DDL)
