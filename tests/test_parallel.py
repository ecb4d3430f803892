"""Work on one hot key spread over many tasks gives what a plain fold of it gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import baseline as B
from tidewatch.operators import drift as D
from tidewatch.operators import rules as RU
from tidewatch.session import scratch_dir
from tidewatch.sources.managed import DayTable, UpsertTable

DAY = 86_400_000


def test_updates_of_one_key_in_many_pieces_equal_the_fold(spark):
    rng = np.random.default_rng(1)
    d, n = 12, 900
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [("hot", i, x[i].tolist(), bool(i % 4), i % 7 == 0) for i in range(n)] + [("cold", 0, x[0].tolist(), True, False)]
    v = spark.createDataFrame(rows, "k string, o long, vector array<double>, learn boolean, drift boolean")
    start = np.diag(np.arange(1.0, d + 1))
    base = spark.createDataFrame(
        [("hot", 40, [0.5] * d, start.ravel().tolist()), ("idle", 3, [1.0] * d, np.eye(d).ravel().tolist())], "k string, n long, mean array<double>, cov array<double>")
    out = B.update_baselines(v, base, "k", "o", pieces=11, fan_in=2)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {"hot", "cold", "idle"} and (got["hot"].n, got["cold"].n, got["idle"].n) == (940, 1, 3)
    for key, mean, cov, at, count in (("hot", np.full(d, 0.5), start, 40, n), ("cold", np.zeros(d), np.eye(d), 0, 1)):
        for _, i, _, learn, drift in [r for r in rows if r[0] == key][:count]:
            if learn:
                mean, cov = B.ema_update(mean, cov, x[i], B.learning_rate(at, drift))
            at += 1
        assert np.allclose(got[key].mean, mean, atol=1e-10) and np.allclose(np.reshape(got[key].cov, (d, d)), cov, atol=1e-9)
    assert got["idle"].mean == [1.0] * d and np.allclose(np.reshape(got["idle"].cov, (d, d)), np.eye(d))


def test_runs_of_updates_compose_in_any_grouping():
    rng = np.random.default_rng(2)
    x, rates = rng.normal(size=(30, 5)), rng.random(30) * 0.5
    mean, cov = rng.normal(size=5), np.eye(5)
    for cut in (0, 1, 13, 29, 30):
        a, b = B.UpdateRun.empty(5), B.UpdateRun.empty(5)
        m, c = mean, cov
        for i in range(30):
            (a if i < cut else b).learn(x[i], rates[i])
            m, c = B.ema_update(m, c, x[i], rates[i])
        a.then(b)
        got = a.apply(mean, cov)
        assert np.allclose(got[0], m) and np.allclose(got[1], c)


def test_covariance_in_levels(spark):
    x = np.random.default_rng(3).normal(size=(500, 6)) + 1e3
    v = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "k string, i long, vector array<double>")
    r = B.fit_baselines(v, ["k"], "i", chunk=20, fan_in=3).first()
    assert r.n == 500 and np.allclose(r.mean, x.mean(axis=0)) and np.allclose(np.reshape(r.cov, (6, 6)), np.cov(x.T), atol=1e-8)


def test_rolling_windows_of_default_size_on_a_long_series(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(9000) < 0.001, 1e7, rng.normal(size=9000)).round(6)
    x[4000:7500] = 5.0  # a constant stretch after outliers: nothing may be left of them
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "device_id string, seq long, value double")
    sigma = {(r.device_id, r.seq): r.sigma for r in D.rolling_sigma(df, chunk=2000).collect()}
    ratio = {(r.device_id, r.seq): r.stability for r in D.stability(df, chunk=4000).collect()}
    assert len(sigma) == len(ratio) == 9001 and sigma["b", 0] == 1.0
    for i in [*range(0, 9000, 37), 10, 11, 199, 200, 999, 1000, 1999, 2000, 4998, 5000, 6500, 8999]:
        w, far, near = x[max(0, i - 999) : i + 1], x[max(0, i - 1999) : i + 1], x[max(0, i - 49) : i + 1]
        assert sigma["a", i] == pytest.approx(max(w.std(), 0.01) if len(w) > 10 else 1.0, rel=1e-9), i
        mad = np.median(np.abs(near - np.median(near)))
        want = 1.0 if len(far) < 200 else 0.0 if far.std() < 1e-6 else mad / far.std()
        assert ratio["a", i] == pytest.approx(want, rel=1e-8, abs=1e-12), i


def test_cooldown_with_a_million_times_in_an_hour(spark):
    gap = 7_000
    df = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("event_id"), (F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("ts_ms"))
    got = sorted(r.ts_ms for r in RU.greedy_cooldown(df, ["k"], gap).collect())
    times = np.sort(df.select("ts_ms").toPandas()["ts_ms"].to_numpy())
    want, ready = [], -1
    while (i := int(np.searchsorted(times, ready))) < len(times):
        want.append(int(times[i]))
        ready = times[i] + gap
    assert got == want and len(want) > 400


def test_retention_removes_days_without_reading_them(spark):
    rows = spark.range(1000).select("id", (F.col("id") * (DAY // 10)).alias("ts_ms"))  # ten a day
    table = DayTable(spark, scratch_dir(spark, "days"), rows.schema, "ts_ms")
    table.append(rows.filter("id < 500"))
    table.append(rows.filter("id >= 500"))
    before = {p["part"]: p["folder"] for p in table.version()[1]["parts"]}
    assert table.retain(40 * DAY) == {"kept": 600, "removed": 400}
    assert {p["part"]: p["folder"] for p in table.version()[1]["parts"]} == {d: f for d, f in before.items() if d >= 40}
    assert table.retain(50 * DAY + DAY // 2) == {"kept": 495, "removed": 105}
    after = {p["part"]: p["folder"] for p in table.version()[1]["parts"]}
    assert after[50] != before[50] and all(after[d] == before[d] for d in range(51, 100))
    assert sorted(r.id for r in table.read().collect()) == list(range(505, 1000))
    assert table.retain(0) == {"kept": 495, "removed": 0}
    assert table.remove_unlisted(1) == 51 and table.read().count() == 495


def test_upserts_rewrite_only_touched_buckets_and_know_their_batches(spark):
    shape = "id string, v int, a string, b int"
    make = lambda rows: spark.createDataFrame(rows, shape)
    first = [(f"k{i}", 1, "x", i) for i in range(50)]
    table = UpsertTable(spark, scratch_dir(spark, "upserts"), make([]).schema, "id", "v", ["a", "b"], buckets=16)
    table.merge(make(first), 0)
    before = {p["part"]: p["folder"] for p in table.version()[1]["parts"]}
    # An older version that comes late changes only what nothing newer has set.
    table.merge(make([("k7", 3, None, 70), ("k7", 2, "y", 60), ("new", 1, None, None)]), 1)
    table.merge(make([("k7", 9, "repeated", 9)]), 1)
    after = {p["part"]: p["folder"] for p in table.version()[1]["parts"]}
    assert sum(after.get(b) != f for b, f in before.items()) <= 2
    got = {r.id: (r.v, r.a, r.b) for r in table.rows().collect()}
    assert len(got) == 51 and got["k7"] == (3, "y", 70) and got["new"] == (1, None, None) and got["k8"] == (1, "x", 8)
    with pytest.raises(RuntimeError):
        table._commit(0, {"parts": [], "applied": 5})


def test_merges_get_small_groups_and_folds_take_rows(spark):
    """A merge gets its fan-in as one batch, not 10,000 summaries; a step of a fold may return plain rows."""
    from tidewatch.functions.ordered import merge_levels, ordered_fold

    parts = spark.range(300).select(F.lit("a").alias("k"), F.col("id").alias("place"), F.col("id").cast("string").alias("text"))
    begin, add = lambda part: [], lambda state, part: state.extend(part["text"])
    merged = merge_levels(parts, ["k"], "place", 300, begin, add, lambda state: {"text": " ".join(state)}, 8)
    assert "FlatMapGroupsInPandas" in merged._jdf.queryExecution().executedPlan().toString()
    assert [r.text.split() for r in merged.collect()] == [[str(i) for i in range(300)]]
    rows = spark.range(500).select((F.col("id") % 200).alias("k"), "id")
    step = lambda state, part: [{"k": int(k), "id": int(i)} for k, i in zip(part["k"], part["id"])]
    got = ordered_fold(rows, ["k"], ["id"], lambda part: None, step, "k bigint, id bigint").collect()
    assert sorted(r.id for r in got) == list(range(500)) and all(r.k == r.id % 200 for r in got)


def test_isolation_forest_scores_its_rows_once(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from tidewatch.operators import learn as M

    calls, score = [], M.IsolationForest.score
    monkeypatch.setattr(M.IsolationForest, "score", lambda self, *a: calls.append(1) or score(self, *a))
    df = spark.range(300).select("id", array_to_vector(F.array(F.rand(1), F.rand(2), F.lit(0.0))).alias("features"))
    df = spark.createDataFrame(df.collect(), df.schema)
    forest = M.IsolationForest(trees=20, sample=64).fit(df, "features", "id")
    kept = {r.id: r.anomaly_score for r in forest.decide_fitted().collect()}
    assert len(calls) == 1
    again = {r.id: r.anomaly_score for r in forest.decide(df, "features", "id").collect()}
    assert kept == again and len(kept) == 300 and 20 <= sum(v < 0 for v in kept.values()) <= 30
