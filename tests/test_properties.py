"""Scalable forms against plain ones, streams against batches, fits against numpy."""

import json
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from tidewatch.functions import ordered as O
from tidewatch.functions.text import fixed
from tidewatch.operators import adaptive as AD
from tidewatch.operators import alerts as AL
from tidewatch.operators import baseline as B
from tidewatch.operators import detect as D
from tidewatch.operators import drift as DR
from tidewatch.operators import evaluate as E
from tidewatch.operators import learn as M
from tidewatch.operators.rules import greedy_cooldown
from tidewatch.plans import detection
from tidewatch.streaming import runner
from tidewatch.streaming import stateful as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; many equal times, and rows without a time."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}"
        ts = 0 if rng.random() < 0.1 else rng.randrange(1, 400) * 1000
        rows.append((key, i * 40, ts, rng.random() * 10, rng.choice([None, rng.randrange(5)])))
    return spark.createDataFrame(rows, "k string, id long, ts long, v double, x long").cache()


def test_number_rows(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = skewed.select("k", "id", (F.row_number().over(w) - 1).alias("seq"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    got = O.number_rows(skewed, ["k"], "ts", "id", "seq", "n", bucket_ms=5000).select("k", "id", "seq", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_previous_and_carry(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = skewed.select("id", F.lag("v").over(w).alias("p"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    got = O.with_previous(skewed, ["k"], ["v"], "ts", "id", "p", 5000)
    got = O.carry_forward(got, ["k"], "x", "c", "ts", "id", 5000).select("id", "p.v", "c")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_running_and_framed(skewed):
    s = O.number_rows(skewed, ["k"], "ts", "id")
    w = Window.partitionBy("k").orderBy("seq")
    want = {r["id"]: r for r in s.select(
        "id", F.sum("v").over(w).alias("a"), F.min("v").over(w).alias("b"), F.avg("v").over(w.rowsBetween(-6, 0)).alias("c")).collect()}
    got = O.running(s, ["k"], "seq", {"a": ("sum", F.col("v")), "b": ("min", F.col("v"))}, 50)
    got = O.framed(got, ["k"], "seq", 6, lambda frame: {"c": F.avg("v").over(frame(7))}, 20)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert [r["a"], r["b"], r["c"]] == pytest.approx([want[r["id"]][c] for c in "abc"])


def test_distance_stats_do_not_depend_on_the_chunk(spark, skewed):
    s = O.number_rows(skewed, ["k"], "ts", "id").select(F.col("k").alias("device_id"), "seq", F.col("v").alias("value"))
    a = {(r["device_id"], r["seq"]): (r["distance_mean"], r["distance_std"]) for r in DR.distance_stats(s, chunk=17).collect()}
    b = {(r["device_id"], r["seq"]): (r["distance_mean"], r["distance_std"]) for r in DR.distance_stats(s, chunk=100_000).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_cusum_is_never_negative(skewed):
    s = O.number_rows(skewed, ["k"], "ts", "id").select(F.col("k").alias("device_id"), "seq", F.col("v").alias("value"))
    low = DR.cusum(s, 5.0, 0.1, chunk=64).agg(F.min("cusum_pos"), F.min("cusum_neg")).first()
    assert min(low) >= 0


@pytest.mark.parametrize("gap,slab", [(3000, 3000), (3000, 20_000), (50_000, 60_000)])
def test_greedy_cooldown_brute_force(skewed, gap, slab):
    want, last = [], {}
    for r in sorted(skewed.collect(), key=lambda r: (r["k"], r["ts"], r["id"])):
        if r["k"] not in last or r["ts"] - last[r["k"]] >= gap:
            last[r["k"]] = r["ts"]
            want.append(r["id"])
    got = greedy_cooldown(skewed, ["k"], gap, "ts", "id", slab_ms=slab)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_fit_baselines_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    keys = ["a" if i < 250 else "b" for i in range(300)]
    df = spark.createDataFrame([(k, i, [float(v) for v in row]) for i, (k, row) in enumerate(zip(keys, x))], "k string, i long, vector array<double>")
    for row in B.fit_baselines(df, ["k"], "i", chunk=40).collect():
        part = x[:250] if row["k"] == "a" else x[250:]
        assert row["n"] == len(part)
        assert np.allclose(row["mean"], part.mean(axis=0)) and np.allclose(np.array(row["cov"]).reshape(5, 5), np.cov(part.T))


def test_full_distance_and_contributions(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(6, 6))
    cov, mean = a @ a.T + np.eye(6), rng.normal(size=6)
    x = rng.normal(size=(40, 6)) * 3
    v = spark.createDataFrame([("d", i, [float(t) for t in r]) for i, r in enumerate(x)], "device_id string, i long, vector array<double>")
    b = spark.createDataFrame([("d", mean.tolist(), cov.ravel().tolist())], "device_id string, mean array<double>, cov array<double>")
    inverse = np.linalg.inv(cov + 1e-6 * np.eye(6))
    for r in D.score_vectors(v, b, "device_id", ["i"], rows_per_task=7).collect():
        d = x[r["i"]] - mean
        assert r["distance"] == pytest.approx(np.sqrt(d @ inverse @ d))
        assert r["squared_sum"] == pytest.approx(r["distance"] ** 2)
        assert len(r["contributions"]) <= 5 and sum(r["contributions"].values()) <= 1 + 1e-9
    lone = D.score_vectors(v, b.limit(0), "device_id", ["i"]).filter("i = 0").first()
    assert lone["distance"] == pytest.approx(np.linalg.norm(x[0]), rel=1e-5)


def test_psd_guard():
    bad, fallback = -np.eye(3), np.eye(3)
    assert B.ensure_psd(bad, fallback) is fallback
    good = np.eye(3) * 2
    assert B.ensure_psd(good, fallback) is good
    flat = np.zeros((3, 3))
    assert np.allclose(B.ensure_psd(flat, fallback), 1e-6 * np.eye(3))


def test_blend_weight_falls(spark):
    hours = spark.range(0, 24 * 10).select(B.generic_weight(F.col("id") * 3_600_000).alias("w")).collect()
    w = [r["w"] for r in hours]
    assert w[0] == 1.0 and w[24] == 1.0 and w[-1] == 0.0 and all(a >= b for a, b in zip(w, w[1:]))


def test_constant_dimension_keeps_lambda_one(spark):
    df = spark.createDataFrame([("a", [1.0, float(i)]) for i in range(20)], "k string, vector array<double>")
    lam = {r["dim"]: r["lam"] for r in B.fit_lambdas(df, ["k"]).collect()}
    assert lam[0] == 1.0 and -2 <= lam[1] <= 2


def test_refit_schedule(spark):
    due = spark.range(0, 10_001).filter(B.refit_due(F.col("id"))).collect()
    assert [r["id"] for r in due] == [99, 5000, 10_000]


def test_calibration_matches_newton(spark):
    rng = np.random.default_rng(6)
    score = rng.normal(5, 2, 400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(score - 6)))).astype(int)
    df = spark.createDataFrame([("u", i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))] + [("few", 1000 + i, float(i), i % 2) for i in range(20)],
                               "user_id string, id long, score double, label int")
    out = {r["user_id"]: r for r in AL.calibrate(df).collect()}
    x = (score - score.mean()) / score.std()
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        g = np.array([((p - label) * x).sum() + a, (p - label).sum()])
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert out["u"]["platt_slope"] == pytest.approx(a, rel=1e-6)
    assert out["u"]["optimal_threshold"] == pytest.approx(score.mean() - score.std() * b / a, rel=1e-6)
    assert 0.5 < out["u"]["calibration_score"] <= 1
    assert out["few"]["platt_slope"] == 2.0 and out["few"]["calibration_score"] == 0.0


def test_exact_quantile(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.beta(2, 5, 5000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for q in (0.0, 0.1, 0.333, 0.5, 1.0):
        assert M.exact_quantile(df, "v", q, 0.0, 1.0, bins=64) == pytest.approx(np.quantile(x, q))


def test_isolation_forest_finds_the_odd_rows(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(8)
    rows = [(i, Vectors.dense(rng.normal(0, 1, 3))) for i in range(400)] + [(1000 + i, Vectors.dense([9.0, -9.0, 9.0])) for i in range(4)]
    df = spark.createDataFrame(rows, ["id", "features"])
    out = M.IsolationForest(trees=60, sample=64, contamination=0.05).fit(df, "features", "id").decide(df, "features", "id")
    worst = {r["id"] for r in out.orderBy("anomaly_score").limit(4).collect()}
    assert worst == {1000, 1001, 1002, 1003}
    assert out.filter("predicted_anomaly = 1").count() == pytest.approx(0.05 * 404, abs=8)


def test_text_features_match_the_formula(spark):
    texts = ["open file open", "open door", "close file door", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    f = M.TextFeatures(100, sublinear=True).fit(df, "text")
    row = f.transform(df, "text").filter("id = 0").first()["features"]
    vocabulary = f.counter.vocabulary
    idf = {t: np.log(5 / 3) + 1 for t in ("open", "file", "door")}
    raw = {"open": (1 + np.log(2)) * idf["open"], "file": idf["file"]}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert set(vocabulary) == {"open", "file", "door"}
    assert {vocabulary[i]: v for i, v in zip(row.indices, row.values)} == pytest.approx({k: v / norm for k, v in raw.items()})


def test_auc_extremes(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    assert E.roc_auc(df).first()["roc_auc"] == 1.0
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert E.roc_auc(same).first()["roc_auc"] == 0.5
    assert E.roc_auc(same.filter("label = 1")).first()["roc_auc"] is None


def test_fixed_decimals_print_like_python(spark):
    rng = random.Random(9)
    values = [rng.randrange(10**9) / 1000 for _ in range(300)] + [rng.random() for _ in range(300)] + [0.0, 0.5, 2.5, 0.125, 25.25, -1.005, 99662.935]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", fixed(F.col("v"), 2).alias("two"), fixed(F.col("v"), 1).alias("one")).collect():
        assert (r["two"], r["one"]) == (f"{r['v']:.2f}", f"{r['v']:.1f}")


def test_detector_stream_equals_batch(spark):
    keep = ["device_id", "window_id", "distance", "threshold", "probability", "threat_type", "severity", "drift", "learned", "cusum_pos"]
    windows = detection.detector_windows(spark, SF)
    batch = {(r[0], r[1]): r for r in AD.run_detector(windows, detection.DETECTOR).select(*keep).collect()}
    stream = {(r[0], r[1]): r for r in entry.queries()["r5_detector_stream"](spark, SF).select(*keep).collect()}
    assert batch.keys() == stream.keys() and batch
    for k, r in batch.items():
        assert list(r)[2:5] == pytest.approx(list(stream[k])[2:5]) and list(r)[5:9] == list(stream[k])[5:9]
        assert r["cusum_pos"] >= 0 and 1 <= r["severity"] <= 10


def test_streams_carry_state_across_micro_batches(spark, tmp_path):
    """Events in three files, one a batch: windows that span batches, cooldowns and limits are the same as in one batch."""
    events = pq.read_table(f"{SF}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    third = events.num_rows // 3
    for i in range(3):
        pq.write_table(events.slice(i * third, third if i < 2 else None), f"{tmp_path}/events{i}.parquet")
    stream = runner.telemetry_stream(spark, str(tmp_path), files_per_batch=1)
    windows = runner.append_to_table(ST.window_stream(stream), "windows")
    got = {(r[0], r[1], r[2]) for r in windows.select("device_id", "window_id", F.explode("ev.event_id")).collect()}
    want = {tuple(r) for r in entry.queries()["r5_window_stream"](spark, SF).select("device_id", "window_id", "event_id").collect()}
    assert got == want and want
    batches = {r[0] for r in runner.publish(stream.select("event_id"), "batches").select("batch_id").distinct().collect()}
    assert batches == {0, 1, 2}
    slim = stream.select(F.lit("fleet").alias("device_id"), "event_id", "ts_ms", "event_time")
    limited = runner.append_to_table(ST.rate_limited_stream(slim, 10, 3_600_000), "limit")
    want = {r[0] for r in entry.queries()["r2_rate_limit"](spark, SF).collect()}
    assert {r[0] for r in limited.select("event_id").collect()} == want


def test_detector_ignores_partitioning(spark):
    one = entry.queries()["d23_adaptive_detector"](spark, SF).agg(F.sum("distance"), F.sum("severity")).first()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = entry.queries()["d23_adaptive_detector"](spark, SF).agg(F.sum("distance"), F.sum("severity")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one[0] == pytest.approx(two[0]) and one[1] == two[1]


def test_whole_flow(spark):
    rows = entry.queries()["e2e_telemetry_to_alerts"](spark, SF).collect()
    assert rows and len({r["anomaly_id"] for r in rows}) == len(rows)
    for r in rows:
        xai = json.loads(r["xai"])
        assert 1 <= r["severity"] <= 10 and len(xai["factors"]) <= 5 and xai["version"] == "xai-v1"
        if r["window_id"] is None:
            assert r["source"] in ("phishing-analyzer", "permission-monitor", "canary-manager") and r["feature_vector"] is None and r["distance"] == 0
        else:
            assert ("rule" in r["source"] or "model" in r["source"]) and len(r["feature_vector"]) == 72
    assert any(r["window_id"] is None for r in rows) and any(r["window_id"] is not None for r in rows)


@pytest.mark.parametrize("name", ["m2_text_classifier", "m4_scaled_forest"])
def test_models_report(spark, name):
    row = entry.queries()[name](spark, SF).first()
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] > 0 and 0 <= row["accuracy"] <= 1


def test_device_covariance_and_ema_use_whole_vectors(spark):
    """All 64 dimensions, and the parts of the 64 x 64 state off its diagonal, against numpy."""
    rows = [(r.label, r.vec_id, np.asarray(r.vector)) for r in detection.vectors(spark, SF).orderBy("vec_id").collect()]
    cov = {(r.label, r.i, r.j): r.cov for r in entry.queries()["a20_device_covariance_whole"](spark, SF).collect()}
    state = {r.label: r for r in detection.ema_baselines(spark, SF).collect()}
    labels = {label for label, _, _ in rows}
    assert set(cov) == {(label, i, j) for label in labels for i in range(64) for j in range(64)} and set(state) == labels
    for label in labels:
        x = np.stack([v for k, _, v in rows if k == label])
        assert np.allclose([[cov[label, i, j] for j in range(64)] for i in range(64)], np.cov(x.T), atol=2e-6)
        mean, c = np.zeros(64), np.eye(64)
        for n, (vec_id, v) in enumerate((i, v) for k, i, v in rows if k == label):
            if vec_id % 3:
                a = 0.05 / (1 + n / 1000)
                a = min(0.5, 5 * a) if vec_id % 5 == 0 else a
                old, mean = v - mean, mean + a * (v - mean)
                c = (1 - a) * c + a / 2 * (np.outer(old, v - mean) + np.outer(v - mean, old))
        assert np.allclose(state[label].mean, mean) and np.allclose(np.reshape(state[label].cov, (64, 64)), c)


def test_no_partner_is_hidden(spark):
    """The queries on whole tables see the ids that a filter on the id used to hide."""
    ids = lambda name, column: {r[column] for r in entry.queries()[name](spark, SF).select(column).collect()}
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    customers = {f"dev_{r[0]}" for r in read("customer").select("c_custkey").collect()}
    assert customers <= ids("s10_device_dimension_whole", "device_id")
    state = {r.device_id for r in entry.queries()["j1_window_device_state_whole"](spark, SF).filter("distance_mean is not null").collect()}
    assert state == customers & ids("j1_window_device_state", "device_id")
    assert {r.registered_clients for r in entry.queries()["a22_federation_status_whole"](spark, SF).collect()} == {read("embeddings").count()}
    assert any(i % 7 == 0 for i in ids("r9_stale_clients_whole", "vec_id"))
    unknown = entry.queries()["j6_update_validation_whole"](spark, SF).filter("reason = 'client_id is not registered'").count()
    assert 0 < unknown < read("embeddings").count()


def test_power_fit_has_no_bounds(spark):
    """Skewed dimensions with optima outside -2..2, over several chunks of a key, against a golden-section search."""
    rng = np.random.default_rng(12)
    n = 300
    x = np.column_stack([rng.beta(1, 30, n), -rng.beta(1, 30, n), 1 - rng.beta(1, 30, n), rng.normal(0, 1, n), rng.lognormal(2, 1, n), np.full(n, 3.0)])
    df = spark.createDataFrame([("a", row.tolist()) for row in x], "k string, vector array<double>")
    got = {r["dim"]: r["lam"] for r in B.fit_lambdas(df, ["k"], chunk=100).collect()}

    def likelihood(v, lam):
        size = np.log1p(np.abs(v))
        y = np.where(v >= 0, np.expm1(lam * size) / lam, -np.expm1((2 - lam) * size) / (2 - lam))
        return -n / 2 * np.log(y.var()) + (lam - 1) * (np.sign(v) * size).sum()

    for d in range(5):
        low, high, g = -60.0, 60.0, (5**0.5 - 1) / 2
        while high - low > 1e-7:
            p, q = high - g * (high - low), low + g * (high - low)
            low, high = (low, q) if likelihood(x[:, d], p) > likelihood(x[:, d], q) else (p, high)
        assert abs(got[d] - low) < 2e-4, d
    assert min(got.values()) < -2 and max(got.values()) > 2 and got[5] == 1.0


@pytest.mark.parametrize("name", ["m9_window_inference", "t6_feature_importance"])
def test_forests_are_of_full_size(spark, monkeypatch, name):
    class Asked(Exception):
        pass

    def train(rows, **settings):
        raise Asked(settings)

    monkeypatch.setattr(M, "train_tabular", train)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](spark, SF)
    assert asked.value.args == ({},)


def test_forest_in_pieces(spark, monkeypatch):
    """Upper nodes from histograms, subtrees a task each, small blocks and rounds: as good as a tree grown in one task, and as MLlib's."""
    from tidewatch.operators import forest as FO

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(3000, 4)), rng.integers(0, 3, (3000, 3))]).astype(float)
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 4] < 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t), 1.0) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double, weight double")
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0").select("id", "y", "x")
    for node_rows, block_rows, round_rows in ((1 << 18, 1 << 14, 1 << 27), (400, 256, 20_000)):
        for name, value in (("NODE_ROWS", node_rows), ("BLOCK_ROWS", block_rows), ("ROUND_ROWS", round_rows)):
            monkeypatch.setattr(FO, name, value)
        grown = FO.grow_forest(train, 20, 30)
        scored = grown.score(test, "p").collect()
        assert {r.id for r in scored} == set(range(0, 3000, 4)) and len(scored) == 750
        assert np.mean([(r.p >= 0.5) == (r.y > 0) for r in scored]) > 0.95 and all(0 <= r.p <= 1 for r in scored)
        gain = grown.importances()
        assert abs(gain.sum() - 1) < 1e-9 and set(np.argsort(gain)[-3:]) == {0, 1, 4}
        assert (len(grown.top[0]["feature"]) > 1) == (node_rows == 400)
        # Fully grown: leaves are pure or cannot be cut by bins.
        leaves = np.concatenate([t["p"][t["feature"] < 0] for t in map(FO._loaded, grown.subtrees.collect())])
        assert np.mean((leaves == 0) | (leaves == 1)) > 0.95


def test_forest_is_sent_to_the_rows_or_rows_to_its_nodes(spark, monkeypatch):
    """Few nodes go to every block; only the rows of a forest of many nodes are shuffled, once a tree. Both give the same scores."""
    from tidewatch.operators import forest as FO

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(900, 3)), np.zeros(900), rng.integers(0, 3, 900)])
    df = spark.createDataFrame([(i, v.tolist(), float(v[0] * v[1] > 0), 1.0 + (i % 2)) for i, v in enumerate(x)], "id long, x array<double>, y double, weight double")
    monkeypatch.setattr(FO, "BLOCK_ROWS", 256)
    for node_rows in (1 << 18, 300):
        monkeypatch.setattr(FO, "NODE_ROWS", node_rows)
        grown = FO.grow_forest(df, 8, 30)
        monkeypatch.setattr(FO, "SENT_BYTES", 1 << 26)
        assert len(grown._sent()) == 1
        sent = {r.id: r.p for r in grown.score(df.select("id", "x"), "p").collect()}
        monkeypatch.setattr(FO, "SENT_BYTES", 0)
        assert grown._sent() == []
        asked = {r.id: r.p for r in grown.score(df.select("id", "x"), "p").collect()}
        assert len(sent) == 900 and sent == asked


def test_large_nodes_are_cut_as_small_ones(monkeypatch):
    from tidewatch.operators import forest as FO

    rng = np.random.default_rng(6)
    bins = rng.integers(0, 6, (12, 4000)).astype(np.uint8)
    bins[[2, 5, 9]] = 0  # no cut
    y, c = (bins[0] + bins[1] + rng.integers(0, 3, 4000) > 6).astype(float), rng.poisson(1.0, 4000) + 1.0
    made = []
    for rows in (1, 50, 1 << 30):
        monkeypatch.setattr(FO, "LONE_ROWS", rows)
        made.append(FO.grow_subtree(bins, y, c * (0.3 + 0.9 * y), c, np.random.default_rng(1), 30, 2, 4))
    assert len(made[0]["feature"]) > 100
    for other in made[1:]:
        assert all(np.array_equal(made[0][k], other[k]) for k in other)


def test_vocabulary_of_many_texts_is_that_of_mllib(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    from tidewatch.operators import learn as M

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.6, 12) if i < 90) + (" once once" if n == 3 else "") for n in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = M.TextFeatures.tokens(df, "text")
    for least in (1, 2, 3):
        every = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=100_000, minDF=least).fit(tokens).vocabulary
        assert sorted(M.top_terms(tokens, 100_000, least)) == sorted(every)
    assert "once" in M.top_terms(tokens, 100_000, 1) and "once" not in M.top_terms(tokens, 100_000, 2)
    counts = dict(tokens.select(F.explode("_terms").alias("t")).groupBy("t").count().collect())
    best = M.top_terms(tokens, 40, 2)
    assert best == sorted(best, key=lambda t: (-counts[t], t)) and min(counts[t] for t in best) >= max(
        counts[t] for t in M.top_terms(tokens, 100_000, 2) if t not in best)

    # Texts are taken apart once for the vocabulary and once for the counts, which the weights and the rows fitted on share.
    calls, split = [], M.TextFeatures.tokens
    monkeypatch.setattr(M.TextFeatures, "tokens", staticmethod(lambda *a: calls.append(1) or split(*a)))
    monkeypatch.setattr(M, "FEW_TEXTS", 100)
    fitted = M.TextFeatures(40, sublinear=True).fit(df, "text")
    vectors = {r.id: r.features for r in fitted.transform_fitted().collect()}
    assert calls == [1] and fitted.counter.vocabulary == best
    assert vectors == {r.id: r.features for r in fitted.transform(df, "text").collect()} and len(vectors) == 300


def test_class_weights_do_not_gather_a_class(spark):
    from tidewatch.operators import evaluate as E

    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.balanced_weights(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
