"""Recurrences over a device's distances: CUSUM, rolling spread, smoothing and decaying averages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.ordered import framed, linear_recurrence, ordered_scan, running
from tidewatch.session import materialise
from tidewatch.settings import CUSUM_C1, CUSUM_C2, CUSUM_WINDOW, EMA_RATE

KEY = ["device_id"]


def rolling_spread(series: DataFrame, value: str, window: int, target: str, chunk: int = 50_000) -> DataFrame:
    """Adds ``target``: the population deviation of the last ``window`` values, and ``target``_n, how many there are.

    The series is cut in blocks of ``window``: the last values are the beginning of a row's own block and the end of the one before. Count, mean
    and variance run forward from each block's begin and backward from its end, and the two are merged, so a row
    costs the same for any window and nothing is subtracted that could cancel.
    """
    chunk = max(1, chunk // window) * window
    here = F.floor(F.col("seq") / chunk)
    homes = F.array(F.struct(here.alias("c"), F.lit(True).alias("own")))
    last = F.col("seq") % chunk >= chunk - (window - 1)
    homes = F.when(last, F.concat(homes, F.array(F.struct((here + 1).alias("c"), F.lit(False).alias("own"))))).otherwise(homes)
    rows = series.withColumn("_h", F.explode(homes))
    rows = rows.select(*series.columns, F.col("_h.c").alias("_c"), F.col("_h.own").alias("_own"), F.floor(F.col("seq") / window).alias("_b"))
    block = Window.partitionBy(*KEY, "_c", "_b")
    upto = lambda order: block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = lambda w: F.struct(F.count(value).over(w).alias("n"), F.avg(value).over(w).alias("m"), F.var_pop(value).over(w).alias("v"))
    rows = rows.withColumn("_pre", told(upto("seq"))).withColumn("_suf", told(upto(F.desc("seq"))))
    rows = rows.withColumn("_far", F.lag("_suf", window - 1).over(Window.partitionBy(*KEY, "_c").orderBy("seq")) if window > 1 else F.lit(None).cast("struct<n:bigint,m:double,v:double>"))
    # At the end of a block the window is the block itself.
    far = F.when(F.col("seq") % window < window - 1, F.col("_far"))
    n1, n2 = F.coalesce(far["n"], F.lit(0)), F.col("_pre.n")
    n, off = n1 + n2, F.coalesce(F.col("_pre.m") - far["m"], F.lit(0.0))
    m2 = F.coalesce(far["v"] * n1, F.lit(0.0)) + F.coalesce(F.col("_pre.v") * n2, F.lit(0.0)) + F.when(n > 0, off * off * (n1 * n2 / n)).otherwise(F.lit(0.0))
    rows = rows.withColumns({target: F.when(n > 0, F.sqrt(m2 / n)), f"{target}_n": n})
    return rows.filter("_own").drop("_c", "_own", "_b", "_pre", "_suf", "_far")


def rolling_sigma(series: DataFrame, value: str = "value", window: int = CUSUM_WINDOW, chunk: int = 50_000) -> DataFrame:
    """Adds ``sigma`` of the last values: 1 until more than ten are seen, never below 0.01."""
    out = rolling_spread(series, value, window, "_sd", chunk)
    sigma = F.when(F.col("_sd_n") > 10, F.greatest("_sd", F.lit(0.01))).otherwise(1.0)
    return out.withColumn("sigma", sigma).drop("_sd", "_sd_n")


def cusum(series: DataFrame, mean: float, allowance: float, value: str = "value", chunk: int = 50_000) -> DataFrame:
    """Two-sided CUSUM without reset: prefix sums less their running minimum, fully parallel."""
    sides = {"pos": 1.0, "neg": -1.0}
    out = materialise(series, "series")  # every pass reads its input twice
    out = running(out, KEY, "seq", {f"_p_{s}": ("sum", (F.col(value) - mean) * sign - allowance) for s, sign in sides.items()}, chunk)
    out = running(out, KEY, "seq", {f"_m_{s}": ("min", F.col(f"_p_{s}")) for s in sides}, chunk)
    for s in sides:
        out = out.withColumn(f"cusum_{s}", F.col(f"_p_{s}") - F.least(F.lit(0.0), F.col(f"_m_{s}")))
    return out.drop(*[f"_{x}_{s}" for x in "pm" for s in sides])


def tuned_cusum(
    series: DataFrame, mean: str, sigma: str = "sigma", value: str = "value", c1: float = CUSUM_C1, c2: float = CUSUM_C2
) -> DataFrame:
    """Self-tuned CUSUM that starts again after an alarm.

    The restart makes each state depend on the last one, so a device is walked in order.
    Batches are streamed: a task holds two numbers per device, not its history.
    """

    def begin(piece: dict[str, np.ndarray]) -> list[float]:
        return [0.0, 0.0]

    def walk(state: list[float], piece: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        pos, neg = state
        spread = piece[sigma].astype(float)
        dev = (piece[value].astype(float) - piece[mean].astype(float)).tolist()
        delta, h = c1 * spread, c2 * spread
        out_pos, out_neg, drift = [], [], []
        for d, allowed, limit in zip(dev, delta.tolist(), h.tolist()):
            pos, neg = max(0.0, pos + d - allowed), max(0.0, neg - d - allowed)
            alarm = pos > limit or neg > limit
            if alarm:
                pos = neg = 0.0
            out_pos.append(pos)
            out_neg.append(neg)
            drift.append(alarm)
        state[0], state[1] = pos, neg
        return {"cusum_pos": np.asarray(out_pos), "cusum_neg": np.asarray(out_neg), "drift": np.asarray(drift), "h": h}

    slim = series.select(*KEY, "seq", value, mean, sigma)
    kinds = {"cusum_pos": T.DoubleType(), "cusum_neg": T.DoubleType(), "drift": T.BooleanType(), "h": T.DoubleType()}
    return ordered_scan(slim, KEY, ["seq"], [value, mean, sigma], begin, walk, kinds)


def smoothed(series: DataFrame, value: str = "value", window: int = 5, chunk: int = 50_000) -> DataFrame:
    """Adds ``smooth``: median of the last values, the raw one until ``window`` are seen."""
    def build(frame):
        w = frame(window)
        return {"smooth": F.when(F.count(value).over(w) >= window, F.percentile(value, 0.5).over(w)).otherwise(F.col(value))}

    return framed(series, KEY, "seq", window - 1, build, chunk)


def stability(
    series: DataFrame, value: str = "value", short: int = 50, long: int = 2000, least: int = 200, chunk: int = 50_000
) -> DataFrame:
    """Adds ``stability``: deviation from the median of recent values over the long-run spread.

    The ``short`` recent values are one small array a row, from which both medians are read; the spread of the ``long`` ones costs the
    same whatever their number (``rolling_spread``).
    """
    out = rolling_spread(series, value, long, "_sd", chunk)
    out = framed(out, KEY, "seq", short - 1, lambda frame: {"_near": F.collect_list(value).over(frame(short))}, chunk)
    median = lambda a: f"(get({a}, CAST(floor((size({a}) - 1) / 2) AS INT)) + get({a}, CAST(floor(size({a}) / 2) AS INT))) / 2"
    out = out.withColumn("_near", F.array_sort("_near")).withColumn("_mid", F.expr(median("_near")))
    out = out.withColumn("_dev", F.expr("array_sort(transform(_near, x -> abs(x - _mid)))"))
    mad = F.expr(median("_dev"))
    ratio = F.when(F.col("_sd_n") < least, 1.0).when(F.col("_sd") < 1e-6, 0.0).otherwise(mad / F.nullif("_sd", F.lit(0.0)))
    return out.withColumn("stability", ratio).drop("_near", "_mid", "_sd", "_sd_n", "_dev")


def distance_stats(
    series: DataFrame, value: str = "value", rate: float = EMA_RATE, mean: float = 0.0, std: float = 1.0, chunk: int = 4096
) -> DataFrame:
    """Adds ``distance_mean`` and ``distance_std``: averages whose rate decays with the count."""
    alpha = F.lit(rate) / (F.col("seq") / 500.0 + 1.0)
    first = linear_recurrence(series, KEY, "seq", 1.0 - alpha, alpha * F.col(value), mean, "distance_mean", "_prior", chunk)
    off = F.col(value) - F.col("_prior")
    out = linear_recurrence(first, KEY, "seq", 1.0 - alpha, alpha * off * off, std * std, "_var", None, chunk)
    return out.withColumn("distance_std", F.sqrt(F.greatest("_var", F.lit(1e-8)))).drop("_prior", "_var")
