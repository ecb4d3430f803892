"""Distances to a baseline, thresholds, threat types and explanations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.ordered import ordered_fold
from tidewatch.functions.text import fixed
from tidewatch.settings import CUSUM_H, INTERACTION, K_SIGMA, PLATT_SLOPE, RIDGE, SEQUENTIAL, TEMPORAL, TZ_SHIFT_MULTIPLIER


class Whitener:
    """Factor of one baseline, computed once and used for every row scored against it."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, ridge: float = RIDGE):
        self.mean = np.asarray(mean, float)
        reg = np.asarray(cov, float).reshape(len(self.mean), -1) + ridge * np.eye(len(self.mean))
        try:
            # z = W diff has z'z equal to the squared distance.
            self.matrix = np.linalg.inv(np.linalg.cholesky(reg))
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(np.linalg.pinv(reg))
            self.matrix = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T

    def score(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and squared whitened parts of rows; masked dimensions count as mean."""
        observed = mask.sum(axis=1)
        z = ((x - self.mean) * mask) @ self.matrix.T
        parts = z * z
        scale = np.divide(x.shape[1], observed, out=np.zeros_like(observed, dtype=float), where=observed > 0)
        return np.sqrt(np.maximum(parts.sum(axis=1) * scale, 0.0)), parts


def whiten_one(mean: np.ndarray, cov: np.ndarray, diff: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Squared whitened parts of a single difference, without inverting the matrix."""
    try:
        wide = np.array(cov, float)
        wide.flat[:: len(mean) + 1] += ridge
        z = np.linalg.solve(np.linalg.cholesky(wide), diff)
    except np.linalg.LinAlgError:
        z = Whitener(mean, cov, ridge).matrix @ diff
    return z * z


def contribution_map(parts: np.ndarray, top: int = 5, least: float = 0.05) -> dict[int, float]:
    """Largest shares of the squared distance above ``least``; the higher index on ties."""
    total = parts.sum()
    if total <= 0:
        return {}
    share = parts / total
    order = np.lexsort((np.arange(len(share)), share))[::-1][:top]
    return {int(i): float(share[i]) for i in order if share[i] > least}


def score_vectors(
    vectors: DataFrame, baselines: DataFrame, key: str, id_columns: Sequence[str],
    vector: str = "vector", mask: str | None = None, rows_per_task: int = 200_000,
) -> DataFrame:
    """Distance and contributions of each row against the baseline of its key.

    Baselines and rows meet by a sorted union: a task reads a baseline, factors it once and
    scores the rows behind it batch by batch. Keys with many rows are cut into several
    parts, each with its own copy of the (small) baseline. Without a baseline the row is
    scored against zeros and identity.
    """
    ids = list(id_columns)
    parts = vectors.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows_per_task)).alias("_parts"))
    no_array = F.lit(None).cast("array<double>")
    rows = vectors.join(parts, key).select(
        key, F.pmod(F.xxhash64(*ids), F.col("_parts")).alias("_part"), F.lit(1).alias("_k"), *ids,
        F.col(vector).cast("array<double>").alias("_x"), (F.col(mask) if mask else no_array).alias("_m"),
    )
    empty = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in ids]
    models = baselines.join(parts, key).select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_k"), *empty,
        F.col("mean").alias("_x"), F.col("cov").alias("_m"),
    )

    def start(part: pd.DataFrame) -> list:
        first = part.iloc[0]
        if first["_k"] == 0:
            return [Whitener(np.asarray(first["_x"], float), np.asarray(first["_m"], float))]
        dim = len(first["_x"])
        return [Whitener(np.zeros(dim), np.eye(dim))]

    def walk(state: list, part: pd.DataFrame) -> pd.DataFrame | None:
        part = part[part["_k"] == 1]
        if part.empty:
            return None
        x = np.stack(part["_x"].to_numpy()).astype(float)
        m = np.ones_like(x) if part["_m"].iloc[0] is None else np.stack(part["_m"].to_numpy()).astype(float)
        distance, squares = state[0].score(x, m)
        return part[[key, *ids]].assign(
            distance=distance, squared_sum=squares.sum(axis=1), contributions=[contribution_map(s) for s in squares]
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(key, *ids).schema.fields)
    return ordered_fold(
        rows.unionByName(models), [key, "_part"], ["_k"], start, walk,
        f"{fields}, distance double, squared_sum double, contributions map<int,double>",
    )


def threshold(mean: Column, std: Column, dim: Column, k: float = K_SIGMA, tz_active: Column | None = None,
              tz_multiplier: float = TZ_SHIFT_MULTIPLIER) -> Column:
    """mean + k deviations, or k * sqrt(dim) without a deviation; widened after a time-zone shift."""
    base = F.when(std > 0, mean + k * std).otherwise(k * F.sqrt(dim))
    return base if tz_active is None else F.when(tz_active, base * tz_multiplier).otherwise(base)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def anomaly_probability(distance: Column, limit: Column, slope: Column | float = PLATT_SLOPE) -> Column:
    return sigmoid(slope * (distance * distance - limit * limit))


def slice_norm(diff: str, low: int, high: int) -> Column:
    return F.sqrt(F.expr(f"aggregate(slice({diff}, {low + 1}, {high - low}), 0D, (a, x) -> a + x * x)"))


def severity(distance: Column, limit: Column, is_anomaly: Column, k: float = K_SIGMA) -> Column:
    z = F.when(limit > 0, distance / (limit / k)).otherwise(0.0)
    high = F.when(z < 4, 5).when(z < 6, 7).when(z < 8, 8).otherwise(F.least(F.lit(10), F.floor(F.least(z, F.lit(1e9))) + 1))
    low = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.least(z, F.lit(1e9)) + 1)))
    return F.when(is_anomaly, high).otherwise(low).cast("int")


def one_decimal(value: Column) -> Column:
    return fixed(value, 1)


def message(threat: Column, level: Column, distance: Column, limit: Column) -> Column:
    of_ten = F.concat(F.lit("(severity "), level.cast("string"), F.lit("/10)"))
    return (
        F.when(threat == "NONE", "Normal behavior detected")
        .when(threat == "USER_DRIFT", F.concat(F.lit("Gradual behavioral drift detected (distance "), one_decimal(distance),
                                               F.lit(" vs threshold "), one_decimal(limit), F.lit(")")))
        .when(threat == "DEVICE_MISUSE", F.concat(F.lit("Sudden behavioral deviation detected — possible device misuse "), of_ten))
        .when(threat == "MALWARE_MIMICRY", F.concat(F.lit("Suspicious app transition pattern — possible malware (distance "),
                                                    one_decimal(distance), F.lit(", "), level.cast("string"), F.lit("/10 severity)")))
        .when(threat == "INSIDER_THREAT", F.concat(F.lit("Unusual interaction patterns — possible unauthorized user "), of_ten))
        .otherwise(F.concat(F.lit("Adversarial behavior detected — suspiciously stable pattern "), of_ten))
    )


def classify(df: DataFrame, diff: str = "diff", k: float = K_SIGMA, default_h: float = CUSUM_H) -> DataFrame:
    """Adds is_anomaly, threat_type, severity and message.

    Needs distance, threshold, cusum_pos, cusum_neg, cusum_h (null for the default) and the
    difference to the baseline mean.
    """
    d, t = F.col("distance"), F.col("threshold")
    h = F.coalesce("cusum_h", F.lit(default_h))
    df = (
        df.withColumn("_t", slice_norm(diff, *TEMPORAL)).withColumn("_s", slice_norm(diff, *SEQUENTIAL))
        .withColumn("_i", slice_norm(diff, *INTERACTION)).withColumn("is_anomaly", d > t)
    )
    threat = (
        F.when(~F.col("is_anomaly"), "NONE")
        .when((F.col("_s") > F.col("_t") * 2) & (d > t * 2), "MALWARE_MIMICRY")
        .when(F.col("_i") > F.col("_t") * 2, "INSIDER_THREAT")
        .when((F.abs("cusum_pos") + F.abs("cusum_neg") > h) & (d < t * 1.5), "USER_DRIFT")
        .otherwise("DEVICE_MISUSE")
    )
    df = df.withColumn("threat_type", threat).withColumn("severity", severity(d, t, F.col("is_anomaly"), k))
    return df.withColumn("message", message(F.col("threat_type"), F.col("severity"), d, t)).drop("_t", "_s", "_i")


def flag_adversarial(df: DataFrame, ratio: float = 0.3, least: int = 50) -> DataFrame:
    """Turns suspiciously stable, half-way distances without another threat into a finding.

    Needs ``stability`` and the number of scores seen so far in ``n_scores``.
    """
    hit = (
        (F.col("threat_type") == "NONE") & (F.col("n_scores") >= least) & (F.col("stability") < ratio)
        & (F.col("distance") > F.col("threshold") * 0.5)
    )
    level = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("distance") * 3 / (F.col("threshold") + 1e-6)))).cast("int")
    return (
        df.withColumn("_hit", hit)
        .withColumn("severity", F.when(F.col("_hit"), level).otherwise(F.col("severity")))
        .withColumn("threat_type", F.when(F.col("_hit"), "ADVERSARIAL_MIMICRY").otherwise(F.col("threat_type")))
        .drop("_hit")
    )


def factor_texts(contributions: Column) -> Column:
    """Sentences for contributions of at least five percent, the largest first."""
    entries = F.array_sort(
        F.transform(F.map_entries(contributions), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("i")))
    )
    kept = F.filter(entries, lambda e: -e["w"] * 100 >= 5.0)

    def sentence(e: Column) -> Column:
        i = e["i"]
        share = F.concat(F.lit("(contributed "), fixed(-e["w"] * 100, 1), F.lit("%"))
        text = (
            F.when(i < 24, F.concat(F.lit("Highly unusual device activity around "), i.cast("string"), F.lit(":00 ")))
            .when(i < 34, "Abnormal frequency of specific app usage ")
            .when(i < 44, "Unusual app switching behavior / transition entropy ")
            .when(i < 52, "Unexpected opening sequence between apps ")
            .when(i < 57, "Anomalous keystroke dynamics detected ")
            .when(i < 62, "Atypical touch durations (possible automation or fatigue) ")
            .when(i < 67, "Irregular swipe velocities ")
            .otherwise("Deviant network, security, or global interaction properties ")
        )
        return F.concat(text, share, F.when(i < 24, " to anomaly score).").otherwise(")."))

    return F.transform(kept, sentence)


def aggregated_contributions(windows: DataFrame, last: int = 5, top: int = 3, least: float = 0.05) -> DataFrame:
    """Features that keep contributing over a device's last anomalous windows.

    ``windows`` has device_id, window_id and contributions. Ranks start from pre-ranked
    chunks, so a device with very many anomalies is reduced in parallel first.
    """
    chunked = windows.withColumn("_c", F.floor(F.col("window_id") / 10_000))
    near = Window.partitionBy("device_id", "_c").orderBy(F.desc("window_id"))
    final = Window.partitionBy("device_id").orderBy(F.desc("window_id"))
    recent = (
        chunked.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= last)
        .withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= last)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("device_id")))
    )
    entries = recent.select("device_id", "_n", F.explode("contributions").alias("idx", "w"))
    means = entries.groupBy("device_id", "idx", "_n").agg(F.sum("w").alias("_s"), F.count(F.lit(1)).alias("_k"))
    stable = means.filter(F.col("_k") >= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).withColumn("_m", F.col("_s") / F.col("_n"))
    per_device = Window.partitionBy("device_id")
    shares = stable.withColumn("weight", F.col("_m") / F.sum("_m").over(per_device))
    ranked = shares.withColumn("_r", F.row_number().over(per_device.orderBy(F.desc("weight"), "idx")))
    return ranked.filter((F.col("_r") <= top) & (F.col("weight") > least)).select("device_id", "idx", "weight")
