"""Keyed state of the streams over several micro-batches: the same as in batch, and forgotten when a device goes silent."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.operators import adaptive as AD
from tidewatch.operators import baseline as B
from tidewatch.operators import windows as W
from tidewatch.plans import detection, streams
from tidewatch.session import scratch_dir
from tidewatch.sources.telemetry import telemetry
from tidewatch.streaming import runner
from tidewatch.streaming import stateful as ST

SF = "/root/testdata/sf0.001"
DAY = 86_400_000


@pytest.fixture(scope="module")
def thirds(tmp_path_factory):
    """The events in three files, in order of time."""
    folder = tmp_path_factory.mktemp("thirds")
    events = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    third = events.num_rows // 3
    for i in range(3):
        pq.write_table(events.slice(i * third, third if i < 2 else None), f"{folder}/events{i}.parquet")
    return str(folder)


def test_detector_over_micro_batches_equals_batch(spark, thirds):
    """With rules, sensitive permissions, scores, slopes and a transform that is fitted on the way."""
    cfg = dataclasses.replace(detection.DETECTOR, power_first=4, power_every=3, ensemble_mode="primary")
    inputs = detection.detector_windows(spark, SF)
    every = inputs.select("device_id", "window_id").distinct()
    u = F.pmod(F.xxhash64("device_id", "window_id"), F.lit(1000)) / 1000.0
    scores = every.select("device_id", "window_id", u.alias("tabular_prob"), (u * u).alias("text_prob")).persist()
    slopes = every.select("device_id").distinct().withColumn("slope", F.lit(0.5)).persist()
    told = inputs.drop("tabular_prob", "text_prob", "slope").join(scores, ["device_id", "window_id"]).join(slopes, "device_id")
    assert told.filter("rule_hit").count() and told.filter("rule_indicator is not null").count()
    want = {(r.device_id, r.window_id): r for r in AD.run_detector(told, cfg).collect()}
    got = {(r.device_id, r.window_id): r for r in streams.detector_flow(spark, thirds, cfg, 1, scores, slopes).collect()}
    assert want.keys() == got.keys() and want
    assert any(r.transformed for r in want.values()) and any(r.rule_passed for r in want.values())
    for k, r in want.items():
        for name, value in r.asDict().items():
            other = got[k][name]
            assert (other == pytest.approx(value, rel=1e-9, abs=1e-12)) if isinstance(value, float) else other == value, (k, name)


def _windows(spark, folder, part, rows):
    shape = "device_id string, window_id bigint, end_ms bigint, vector array<double>, mask array<int>, tz_offset bigint"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/batch_id={part}")
    return shape


def test_a_silent_device_is_forgotten_and_starts_anew(spark):
    folder = scratch_dir(spark, "silent")
    rng = np.random.default_rng(5)
    window = lambda d, i, day: (d, i, day * DAY, rng.normal(size=72).tolist(), [1] * 72, None)
    first = [window("a", i, 1 + i) for i in range(3)] + [window("b", i, 1 + i) for i in range(3)]
    # The clock moves on with b; the state of a ends 90 days after day 3, 30 days behind the newest event.
    parts = [first, [window("b", 3, 60)], [window("b", 4, 140)], [window("b", 5, 141)], [window("a", 3, 142), window("b", 6, 142)]]
    for i, rows in enumerate(parts):
        shape = _windows(spark, folder, i, rows)
    # A row with a null slope and no rule is what with_optional makes of these.
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/batch_id=*")
    got = {(r.device_id, r.window_id): r for r in runner.append_to_table(ST.detector_stream(stream, AD.DetectorConfig(idle_ms=400 * DAY)), "silent-out").collect()}
    fresh = next(r for k, r in got.items() if k == ("a", 3))
    alone = AD.step(AD.DetectorState(), dict(zip(("device_id", "window_id", "end_ms", "vector", "mask", "tz_offset"), parts[4][0])), AD.DetectorConfig(idle_ms=400 * DAY))
    assert fresh.distance == pytest.approx(alone["distance"]) and fresh.threshold == pytest.approx(alone["threshold"])
    assert got["b", 6].distance_mean != pytest.approx(alone["distance_mean"])


def test_waiting_events_are_forgotten(spark):
    folder = scratch_dir(spark, "waiting")
    shape = "device_id string, event_id bigint, event_type string, package_name string, ts_ms bigint, data string"
    parts = [
        [("a", i, "APP_USAGE", "p", DAY + i, "{}") for i in range(7)] + [("b", 10, "TOUCH", None, DAY, None)],
        [("b", 11, "TOUCH", None, 130 * DAY, None)], [("b", 12, "TOUCH", None, 131 * DAY, None)],
        [("a", 20 + i, "APP_USAGE", "p", 132 * DAY + i, "{}") for i in range(5)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/part={i}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    windows = runner.append_to_table(ST.window_stream(runner.with_event_time(stream), ST.raw_fields()), "waiting-out")
    got = {(r.device_id, r.window_id, tuple(e.event_id for e in r.ev)) for r in windows.collect()}
    # The first window of a, and after its return a first one again, without the two events that waited.
    assert got == {("a", 0, (0, 1, 2, 3, 4)), ("a", 0, (20, 21, 22, 23, 24))}


def test_power_moments_against_an_unbounded_search():
    rng = np.random.default_rng(12)
    n = 400
    x = np.column_stack([rng.beta(1, 30, n), -rng.beta(1, 30, n), rng.normal(0, 1, n), rng.lognormal(2, 1, n), np.full(n, 3.0), rng.gamma(2, 2, n)])

    def likelihood(v, lam):
        y = B.transform_one(v, np.full(len(v), lam))
        return -n / 2 * np.log(y.var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    # The same vectors again and again: the grid moves to the optimum and narrows.
    moments = B.PowerMoments.empty(6)
    for _ in range(8):
        halves = [B.PowerMoments.around(moments.centre, moments.scale) for _ in range(2)]
        for i, row in enumerate(x):
            halves[i % 2].add(row)
        halves[0].merge(halves[1])
        lam, moments = halves[0].fitted()
    for d in (0, 1, 2, 3, 5):
        low, high, g = -60.0, 60.0, (5**0.5 - 1) / 2
        while high - low > 1e-7:
            p, q = high - g * (high - low), low + g * (high - low)
            low, high = (low, q) if likelihood(x[:, d], p) > likelihood(x[:, d], q) else (p, high)
        assert abs(lam[d] - low) < 2e-3, (d, lam[d], low)
    assert lam[4] == 1.0 and lam[0] < -4


def test_transform_is_applied_after_the_first_fit_and_refitted(spark):
    cfg = AD.DetectorConfig(idle_ms=400 * DAY, power_first=50, power_every=120)
    rng = np.random.default_rng(3)
    rows = rng.beta(1, 20, size=(260, 72))
    state, told = AD.DetectorState(), []
    for i, row in enumerate(rows):
        told.append(AD.step(state, {"vector": row, "mask": np.ones(72), "end_ms": (i + 1) * 1000}, cfg))
        if i == 49:
            first = state.lambdas.copy()
    assert [t["transformed"] for t in told] == [False] * 50 + [True] * 210
    assert not np.allclose(first, state.lambdas) and state.power.n < 260 - 120


@pytest.mark.parametrize("name", ["r5_window_stream", "r5_detector_stream"])
def test_keyed_streams_run_in_any_session(spark, name):
    """With Spark's default store, which holds no state of several columns; the session keeps its settings."""
    provider, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before, environment = spark.conf.get(provider), dict(spark.sparkContext.environment)
    spark.conf.set(provider, default)
    try:
        got = {(r.device_id, r.window_id) for r in entry.queries()[name](spark, SF).select("device_id", "window_id").collect()}
        assert spark.conf.get(provider) == default and spark.sparkContext.environment == environment
    finally:
        spark.conf.set(provider, before)
    assert got == {tuple(r) for r in W.count_windows(telemetry(spark, SF)).select("device_id", "window_id").distinct().collect()} and got


def test_detector_state_is_kept_as_bytes():
    """A covariance that is symmetric, as all are, is half of it."""
    rng = np.random.default_rng(2)
    cov = rng.normal(size=(6, 6))
    for m in (cov @ cov.T / 3 + (cov @ cov.T / 3).T, cov):
        power = B.PowerMoments.empty(6)
        power.add(rng.normal(size=6))
        for s in (AD.DetectorState(rng.normal(size=6), m, 4, 1.5, 0.25, probabilities=[0.5, 0.25], distances=rng.random(3), awake=rng.random(2), alerted={"a": 5},
                                   tz=7, lambdas=rng.normal(size=6), power=power), AD.DetectorState(np.zeros(6), m)):
            kept = ST._save(s)
            again = ST._load(kept)
            assert not any(isinstance(v, list) and v and isinstance(v[0], float) for v in kept)
            assert np.array_equal(again.cov, s.cov) and np.array_equal(again.mean, s.mean) and again.n == s.n and again.alerted == s.alerted and again.tz == s.tz
            assert again.probabilities == s.probabilities and np.array_equal(again.distances, s.distances) and np.array_equal(again.awake, s.awake)
            assert (again.lambdas is None) == (s.lambdas is None) and (s.lambdas is None or np.array_equal(again.lambdas, s.lambdas))
            assert (again.power is None) == (s.power is None)
            if s.power is not None:
                assert again.power.n == 1 and all(np.array_equal(getattr(again.power, n), getattr(s.power, n)) for n in ("centre", "scale", "mean", "m2", "jac"))
    assert len(kept[1]) == 8 * 36 and len(ST._save(AD.DetectorState(np.zeros(6), np.eye(6)))[1]) == 8 * 21


def test_few_messages_to_the_store_a_device():
    """Each is a round trip to the JVM: four for the windows of a new device, three for its detector."""
    calls = []

    class State:
        kept = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.kept = args[0]
                return {"get": self.kept, "exists": True}.get(name)

            return call

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        getListState = getValueState  # noqa: N815

        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    from pyspark.sql import Row
    from pyspark.sql.types import LongType, StructField, StructType

    windows = ST.CountWindows(StructType([StructField("ts_ms", LongType()), StructField("event_id", LongType())]), 5, DAY)
    windows.init(Handle())
    assert len(list(windows.handleInputRows(("a",), iter([Row(ts_ms=i, event_id=i) for i in range(7)]), None))) == 1
    assert sorted(calls) == ["get", "put", "registerTimer", "update"]
    calls.clear()
    detector = ST.Detector(AD.DetectorConfig(), ["window_id", "distance"], DAY)
    detector.init(Handle())
    row = Row(window_id=0, end_ms=DAY, vector=[0.5] * 72, mask=[1.0] * 72)
    assert len(list(detector.handleInputRows(("a",), iter([row]), None))) == 1
    assert sorted(calls) == ["get", "registerTimer", "update"]
    calls.clear()
    late = Row(window_id=1, end_ms=DAY - 5, vector=[0.5] * 72, mask=[1.0] * 72)
    assert len(list(detector.handleInputRows(("a",), iter([late]), None))) == 1 and sorted(calls) == ["get", "update"]
