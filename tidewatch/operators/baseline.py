"""Baselines: fitting, blending, updating and the power transform."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ordered import merge_levels, ordered_fold
from tidewatch.functions.times import DAY_MS
from tidewatch.session import materialise
from tidewatch.settings import DRIFT_BOOST, DRIFT_BOOST_CAP, EMA_RATE, RIDGE

_FIT = "n bigint, mean array<double>, cov array<double>"


def mean_vectors(vectors: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Mean and population variance per dimension, without leaving the JVM."""
    long = vectors.select(*keys, F.posexplode(vector).alias("dim", "x"))
    per_dim = long.groupBy(*keys, "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return per_dim.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.expr("transform(array_sort(collect_list(struct(dim, m))), t -> t.m)").alias("mean"),
        F.expr("transform(array_sort(collect_list(struct(dim, v))), t -> t.v)").alias("variance"),
    )


def fit_baselines(
    vectors: DataFrame, keys: Sequence[str], row_id: str, vector: str = "vector", chunk: int = 20_000, fan_in: int = 64
) -> DataFrame:
    """Mean and sample covariance (row-major) per key.

    Moments are first accumulated over chunks of a key and then merged in levels of ``fan_in``, so a key with many
    rows is spread over many tasks and no task ever holds more than one batch of rows or ``fan_in`` partial results.
    """
    keys = list(keys)
    slim = vectors.select(*keys, F.pmod(F.xxhash64(row_id), F.lit(1 << 20)).alias("_h"), F.col(vector).alias("_x"))
    counts = vectors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_parts"))
    split = slim.join(counts, keys).withColumn("_part", F.col("_h") % F.col("_parts")).drop("_h")
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keys).schema.fields)

    def start(part: pd.DataFrame) -> dict:
        return {"head": part.iloc[:1].copy(), "n": 0, "mean": None, "m2": None}

    def merge(state: dict, n: int, mean: np.ndarray, m2: np.ndarray) -> None:
        if state["n"] == 0:
            state.update(n=n, mean=mean, m2=m2)
            return
        total = state["n"] + n
        shift = mean - state["mean"]
        state["m2"] = state["m2"] + m2 + np.outer(shift, shift) * (state["n"] * n / total)
        state["mean"] = state["mean"] + shift * (n / total)
        state["n"] = total

    def add_rows(state: dict, part: pd.DataFrame) -> None:
        x = np.stack(part["_x"].to_numpy()).astype(float)
        centred = x - x.mean(axis=0)
        merge(state, len(x), x.mean(axis=0), centred.T @ centred)

    def partial(state: dict) -> pd.DataFrame:
        head = state["head"]
        return head[[*keys, "_part", "_parts"]].assign(_n=state["n"], _mean=[state["mean"]], _m2=[state["m2"].ravel()])

    def add_partials(state: dict, part: pd.DataFrame) -> None:
        state["parts"] = int(part["_parts"].iloc[0])
        for n, mean, m2 in zip(part["_n"], part["_mean"], part["_m2"]):
            mean = np.asarray(mean, float)
            merge(state, int(n), mean, np.asarray(m2, float).reshape(len(mean), -1))

    def whole(state: dict) -> dict:
        return {"_parts": state["parts"], "_n": state["n"], "_mean": state["mean"], "_m2": state["m2"].ravel()}

    parts = ordered_fold(split, [*keys, "_part"], [], start, add_rows,
                         f"{key_fields}, _part bigint, _parts bigint, _n bigint, _mean array<double>, _m2 array<double>", partial)
    most = counts.agg(F.max("_parts")).first()[0] or 1
    if most > fan_in:
        parts = materialise(parts, "moments")
    merged = merge_levels(parts, keys, "_part", most, lambda part: {"n": 0}, add_partials, whole, fan_in)
    cov = F.expr("transform(_m2, v -> v / greatest(_n - 1, 1))")
    return merged.select(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), cov.alias("cov"))


def generic_weight(age_ms: Column, warm_ms: int = DAY_MS, blend_ms: int = 7 * DAY_MS) -> Column:
    """Share of the fleet baseline: 1 in the first day, then falling to 0 over a week."""
    age = F.greatest(F.lit(0), age_ms)
    return F.when(age <= warm_ms, 1.0).when(age < warm_ms + blend_ms, 1.0 - (age - warm_ms) / blend_ms).otherwise(0.0)


def blend(own: Column, generic: Column, weight: Column) -> Column:
    return F.when(own.isNull(), generic).otherwise(F.zip_with(own, generic, lambda p, g: weight * g + (1.0 - weight) * p))


def ensure_psd(cov: np.ndarray, fallback: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The matrix, or with a ridge, or the fallback: the first that has a Cholesky factor."""
    for candidate in (cov, cov + ridge * np.eye(len(cov))):
        try:
            np.linalg.cholesky(candidate)
            return candidate
        except np.linalg.LinAlgError:
            continue
    return fallback


def learning_rate(n: float, drift: bool, rate: float = EMA_RATE) -> float:
    alpha = rate / (1 + n / 1000.0)
    return min(alpha * DRIFT_BOOST, DRIFT_BOOST_CAP) if drift else alpha


def ema_update(mean: np.ndarray, cov: np.ndarray, x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially weighted mean and covariance; stays symmetric."""
    old = x - mean
    new_mean = mean + alpha * old
    spread = np.outer(old, x - new_mean)
    return new_mean, (1 - alpha) * cov + alpha * 0.5 * (spread + spread.T)


@dataclass
class UpdateRun:
    """What a run of updates does to any baseline it is entered with.

    With mean m and covariance C before, the mean after is a * m + b and the covariance a * C + p - q m' - m q' + r m m'. Each update is such
    a run (a = 1 - rate, b = rate * x, p = a * rate * x x', q = a * rate * x, r = a * rate), and one run after another is again one.
    """

    a: float
    b: np.ndarray
    p: np.ndarray
    q: np.ndarray
    r: float

    @classmethod
    def empty(cls, dim: int) -> UpdateRun:
        return cls(1.0, np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim), 0.0)

    def learn(self, x: np.ndarray, rate: float) -> None:
        keep, weight, off = 1.0 - rate, rate * (1.0 - rate), x - self.b
        self.p = keep * self.p + weight * np.outer(off, off)
        self.q = keep * self.q + weight * self.a * off
        self.r = keep * self.r + weight * self.a * self.a
        self.b, self.a = keep * self.b + rate * x, keep * self.a

    def then(self, other: UpdateRun) -> None:
        cross = np.outer(other.q, self.b)
        self.p = other.a * self.p + other.p - cross - cross.T + other.r * np.outer(self.b, self.b)
        self.q = other.a * self.q + self.a * other.q - other.r * self.a * self.b
        self.r = other.a * self.r + other.r * self.a * self.a
        self.b, self.a = other.a * self.b + other.b, other.a * self.a

    def apply(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cross = np.outer(self.q, mean)
        return self.a * mean + self.b, self.a * cov + self.p - cross - cross.T + self.r * np.outer(mean, mean)


_RUN = "_a double, _b array<double>, _p array<double>, _q array<double>, _r double"


def _run_row(run: UpdateRun) -> dict:
    return {"_a": run.a, "_b": run.b.tolist(), "_p": run.p.ravel().tolist(), "_q": run.q.tolist(), "_r": run.r}


def _run_of(row: dict) -> UpdateRun:
    b = np.asarray(row["_b"], float)
    return UpdateRun(float(row["_a"]), b, np.asarray(row["_p"], float).reshape(len(b), -1), np.asarray(row["_q"], float), float(row["_r"]))


def update_baselines(
    vectors: DataFrame, baselines: DataFrame, key: str, order: str, rate: float = EMA_RATE, pieces: int | None = None, fan_in: int = 64
) -> DataFrame:
    """Folds vectors (with ``learn`` and ``drift`` flags) into the baseline of their key, in order: (key, n, mean, cov).

    The rate of an update depends on its place only, so a key need not be walked in one task: rows are range-partitioned by key and order
    (into ``pieces``), every piece of a key becomes one ``UpdateRun``, neighbouring runs are composed in levels of ``fan_in``, and
    what is left, one run per key, is applied to its baseline. Keys without a baseline start from zeros and identity, n = 0; every row counts for n,
    learned or not; a baseline without rows stays as it is.
    """
    ranges = (key, order) if pieces is None else (pieces, key, order)
    rows = vectors.select(key, F.col(order).alias("_o"), F.col("vector").alias("_x"), F.coalesce("learn", F.lit(False)).alias("_learn"), F.coalesce("drift", F.lit(False)).alias("_drift"))
    rows = rows.repartitionByRange(*[("_o" if c == order else c) for c in ranges]).withColumn("_pid", F.spark_partition_id().cast("long"))
    rows = materialise(rows, "updates")
    before = Window.partitionBy(key).orderBy("_pid")
    held = rows.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_from": F.sum("_n").over(before) - F.col("_n"), "_place": F.row_number().over(before).cast("long") - 1,
        "_all": F.sum("_n").over(Window.partitionBy(key))})
    held = held.join(baselines.select(key, F.col("n").alias("_n0")), key, "left")
    held = materialise(held.select(key, "_pid", "_place", "_all", (F.coalesce("_n0", F.lit(0)) + F.col("_from")).alias("_first")), "update-pieces")

    def start(part: pd.DataFrame) -> dict:
        first = part.iloc[0]
        return {"head": part.iloc[:1][[key, "_place", "_all"]].copy(), "n": int(first["_first"]), "run": UpdateRun.empty(len(first["_x"]))}

    def walk(state: dict, part: pd.DataFrame) -> None:
        for x, learn, drift in zip(part["_x"], part["_learn"], part["_drift"]):
            if learn:
                state["run"].learn(np.asarray(x, float), learning_rate(state["n"], bool(drift), rate))
            state["n"] += 1

    def done(state: dict) -> pd.DataFrame:
        return state["head"].assign(**{k: [v] for k, v in _run_row(state["run"]).items()})

    key_type = vectors.schema[key].dataType.simpleString()
    runs = ordered_fold(rows.join(held, [key, "_pid"]), [key, "_place"], ["_o"], start, walk, f"`{key}` {key_type}, _place bigint, _all bigint, {_RUN}", done)
    most = (held.agg(F.max("_place")).first()[0] or 0) + 1
    if most > fan_in:
        runs = materialise(runs, "update-runs")

    def chain(state: dict, part: pd.DataFrame) -> None:
        state["all"] = int(part["_all"].iloc[0])
        for row in part.to_dict("records"):
            run = _run_of(row)
            if "run" in state:
                state["run"].then(run)
            else:
                state["run"] = run

    runs = merge_levels(runs, [key], "_place", most, lambda part: {}, chain, lambda s: {"_all": s["all"], **_run_row(s["run"])}, fan_in)

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for row in pdf.to_dict("records"):
                run = None if row["_b"] is None else _run_of(row)
                if row["mean"] is None:
                    mean, cov = np.zeros(len(run.b)), np.eye(len(run.b))
                else:
                    mean = np.asarray(row["mean"], float)
                    cov = np.asarray(row["cov"], float).reshape(len(mean), -1)
                mean, cov = (mean, cov) if run is None else run.apply(mean, cov)
                made.append((row["key"], int(row["n"]), mean.tolist(), cov.ravel().tolist()))
            yield pd.DataFrame(made, columns=[key, "n", "mean", "cov"])

    both = baselines.select(key, "n", "mean", "cov").join(runs, key, "full_outer")
    both = both.select(F.col(key).alias("key"), (F.coalesce("n", F.lit(0)) + F.coalesce("_all", F.lit(0))).cast("long").alias("n"), "mean", "cov", "_a", "_b", "_p", "_q", "_r")
    return both.mapInPandas(applied, f"`{key}` {key_type}, {_FIT}")


# --- Yeo-Johnson -----------------------------------------------------------------------


def yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    down = F.when(F.abs(lam - 2.0) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, up).otherwise(down)


GRID = (np.arange(81) * 5 - 200) / 100.0  # -2.00, -1.95 .. 2.00 around the centre of a search, times its scale
HALF = len(GRID) // 2
#: Grid points of ``PowerMoments`` around its centre, in units of its scale.
STEPS = np.arange(-20.0, 21.0)


def _moments(x: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of the transformed values; ``lam`` and both results as (dimension, lambda)."""
    mean, m2 = np.empty(lam.shape), np.empty(lam.shape)
    up, size = x >= 0, np.log1p(np.abs(x))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for i, v in enumerate(lam.T):
            # (|x| + 1) ** p = exp(p * log1p |x|): one logarithm serves every lambda.
            high = np.where(np.abs(v) < 1e-9, size, np.expm1(v * size) / v)
            low = np.where(np.abs(v - 2.0) < 1e-9, -size, -np.expm1((2.0 - v) * size) / (2.0 - v))
            y = np.where(up, high, low)
            mean[:, i] = y.mean(axis=0)
            m2[:, i] = ((y - mean[:, i]) ** 2).sum(axis=0)
    return mean, m2


def _split_rows(vectors: DataFrame, keys: list[str], vector: str, chunk: int) -> DataFrame:
    slim = vectors.select(*keys, F.pmod(F.xxhash64(vector), F.lit(1 << 20)).alias("_h"), F.col(vector).alias("_x"))
    counts = vectors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_parts"))
    return slim.join(counts, keys).withColumn("_part", F.col("_h") % F.col("_parts")).drop("_h", "_parts")


def _grid_pass(split: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One row per key: the most likely lambdas on the grid around ``_lam`` (null: 0), the scales of the next grids and
    whether a dimension is ``_open``: its optimum on the edge of the grid, or the step above the tolerance.

    Moments for all lambdas are accumulated in arrays over chunks of a key, then merged, so a key with many rows is spread
    over tasks and a row never becomes more than one.
    """
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.select(*keys).schema.fields)
    arrays = ["_mean", "_m2", "_jac", "_low", "_high"]

    def start(part: pd.DataFrame) -> dict:
        first = part.iloc[0]
        dim = len(first["_x"] if "_x" in part else first["_jac"])
        lam, scale = (np.full(dim, c) if first[f] is None else np.asarray(first[f], float) for f, c in (("_lam", 0.0), ("_scale", 1.0)))
        return {"head": part.iloc[:1].copy(), "n": 0, "lam": lam, "scale": scale, "grid": lam[:, None] + GRID * scale[:, None]}

    def merge(state: dict, n: int, mean: np.ndarray, m2: np.ndarray, jac: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if state["n"]:
            with np.errstate(over="ignore", invalid="ignore"):
                total, shift = state["n"] + n, mean - state["mean"]
                m2 = state["m2"] + m2 + shift * shift * (state["n"] * n / total)
                mean = state["mean"] + shift * (n / total)
            jac, low, high, n = state["jac"] + jac, np.minimum(state["low"], low), np.maximum(state["high"], high), total
        state.update(n=n, mean=mean, m2=m2, jac=jac, low=low, high=high)

    def add_rows(state: dict, part: pd.DataFrame) -> None:
        x = np.stack(part["_x"].to_numpy()).astype(float)
        merge(state, len(x), *_moments(x, state["grid"]), (np.sign(x) * np.log1p(np.abs(x))).sum(axis=0), x.min(axis=0), x.max(axis=0))

    def partial(state: dict) -> pd.DataFrame:
        return state["head"][[*keys, "_part"]].assign(
            _n=state["n"], _lam=[state["lam"].tolist()], _scale=[state["scale"].tolist()], **{a: [state[a[1:]].ravel().tolist()] for a in arrays})

    def add_partials(state: dict, part: pd.DataFrame) -> None:
        for n, *values in zip(part["_n"], *[part[a] for a in arrays]):
            mean, m2, jac, low, high = (np.asarray(v, float) for v in values)
            merge(state, int(n), mean.reshape(len(jac), -1), m2.reshape(len(jac), -1), jac, low, high)

    def fitted(state: dict) -> pd.DataFrame:
        grid, scale = state["grid"], state["scale"]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            v = state["m2"] / state["n"]
            # What is left of a variance after its values have rounded to one number says nothing.
            good = np.isfinite(v) & (v > 1e-300) & (v > 1e-22 * state["mean"] ** 2)
            fit = np.where(good, -state["n"] / 2 * np.log(v) + (grid - 1) * state["jac"][:, None], -np.inf)
        # On the first grid equal likelihoods are told apart by the smaller lambda; the rounding keeps ties stable.
        at = np.where(scale == 1.0, np.round(fit, 6).argmax(axis=1), fit.argmax(axis=1))
        same = state["high"] <= state["low"]
        edge = (at == 0) | (at == len(GRID) - 1)
        wide = scale * (GRID[1] - GRID[0]) > tolerance
        following = np.where(edge, scale * 2, np.where(wide, scale / HALF, scale))
        best = np.where(same, 1.0, grid[np.arange(len(at)), at])
        return state["head"][keys].assign(n=state["n"], _lam=[best.tolist()], _scale=[following.tolist()], _open=bool(((edge | wide) & ~same).any()))

    fields = ", ".join(f"{a} array<double>" for a in ["_lam", "_scale", *arrays])
    parts = ordered_fold(split, [*keys, "_part"], [], start, add_rows, f"{key_fields}, _part bigint, _n bigint, {fields}", partial)
    return ordered_fold(parts, keys, ["_part"], start, add_partials, f"{key_fields}, n bigint, _lam array<double>, _scale array<double>, _open boolean", fitted)


def _first_grid(split: DataFrame) -> DataFrame:
    return split.withColumns({c: F.lit(None).cast("array<double>") for c in ("_lam", "_scale")})


def _by_dimension(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, "n", F.posexplode("_lam").alias("dim", "lam")).select(*keys, "dim", "lam", "n")


def grid_lambdas(vectors: DataFrame, keys: Sequence[str], vector: str = "vector", chunk: int = 20_000) -> DataFrame:
    """Most likely lambda on the grid from -2 to 2 per key and dimension, the first pass of ``fit_lambdas``."""
    keys = list(keys)
    return _by_dimension(_grid_pass(_first_grid(_split_rows(vectors, keys, vector, chunk)), keys, np.inf), keys)


def fit_lambdas(vectors: DataFrame, keys: Sequence[str], vector: str = "vector", chunk: int = 20_000, tolerance: float = 1e-4) -> DataFrame:
    """Most likely lambda per key and dimension, without bounds; 1 for a constant dimension.

    Starts from the grid from -2 to 2. An optimum on the edge moves the grid there and doubles it, one inside narrows it
    to the neighbouring steps, until all are inside and steps are within the tolerance. Each pass reads the rows of the
    keys that are still open.
    """
    keys = list(keys)
    split = materialise(_split_rows(vectors, keys, vector, chunk), "power-rows")
    found = materialise(_grid_pass(_first_grid(split), keys, tolerance), "power-pass")
    out = found.filter("NOT _open")
    while not (left := found.filter("_open")).isEmpty():
        found = materialise(_grid_pass(split.join(left.select(*keys, "_lam", "_scale"), keys), keys, tolerance), "power-pass")
        out = out.unionByName(found.filter("NOT _open"))
    return _by_dimension(out, keys)


def transform_one(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """A vector with each entry transformed by its own lambda."""
    size, up = np.log1p(np.abs(x)), x >= 0
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        high = np.where(np.abs(lam) < 1e-9, size, np.expm1(lam * size) / np.where(lam == 0, 1.0, lam))
        low = np.where(np.abs(lam - 2.0) < 1e-9, -size, -np.expm1((2.0 - lam) * size) / np.where(lam == 2.0, 1.0, 2.0 - lam))
    return np.where(lam == 1.0, x, np.where(up, high, low))


@dataclass
class PowerMoments:
    """What a fit of the transform needs of the vectors seen so far, without keeping them.

    For each dimension the mean and the sum of squared deviations of the transformed values for every lambda of a grid, and the term of
    the likelihood that depends on the values alone. Two of one grid can be merged, so a stream may keep one in its state and a batch
    may build it in parts.
    """

    centre: np.ndarray
    scale: np.ndarray
    n: int = 0
    mean: np.ndarray | None = None
    m2: np.ndarray | None = None
    jac: np.ndarray | None = None

    @classmethod
    def empty(cls, dim: int) -> PowerMoments:
        return cls.around(np.ones(dim), np.full(dim, 0.2))

    @classmethod
    def around(cls, centre: np.ndarray, scale: np.ndarray) -> PowerMoments:
        shape = (len(centre), len(STEPS))
        return cls(centre, scale, 0, np.zeros(shape), np.zeros(shape), np.zeros(len(centre)))

    @property
    def grid(self) -> np.ndarray:
        return self.centre[:, None] + STEPS * self.scale[:, None]

    def add(self, x: np.ndarray) -> None:
        lam = self.grid
        y = transform_one(np.broadcast_to(x[:, None], lam.shape), lam)
        self.n += 1
        with np.errstate(over="ignore", invalid="ignore"):
            off = y - self.mean
            self.mean += off / self.n
            self.m2 += off * (y - self.mean)
        self.jac += np.sign(x) * np.log1p(np.abs(x))

    def merge(self, other: PowerMoments) -> None:
        if not other.n:
            return
        total = self.n + other.n
        with np.errstate(over="ignore", invalid="ignore"):
            shift = other.mean - self.mean
            self.m2 = self.m2 + other.m2 + shift * shift * (self.n * other.n / total)
            self.mean = self.mean + shift * (other.n / total)
        self.jac, self.n = self.jac + other.jac, total

    def fitted(self) -> tuple[np.ndarray, PowerMoments]:
        """The most likely lambdas, and empty moments on the grid for the vectors to come.

        Between grid points the optimum is that of a parabola through the best point and its neighbours. An optimum on the edge of the grid moves
        the grid there and doubles it, one inside narrows it around it. A constant dimension has lambda 1 and keeps its grid.
        """
        grid, rows = self.grid, np.arange(len(self.centre))
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            v = self.m2 / max(self.n, 1)
            good = np.isfinite(v) & (v > 1e-300) & (v > 1e-22 * self.mean**2)
            fit = np.where(good, -self.n / 2 * np.log(v) + (grid - 1) * self.jac[:, None], -np.inf)
            at = fit.argmax(axis=1)
            edge = (at == 0) | (at == len(STEPS) - 1)
            inner = np.clip(at, 1, len(STEPS) - 2)
            a, b, c = fit[rows, inner - 1], fit[rows, inner], fit[rows, inner + 1]
            bend = a - 2 * b + c
            move = np.where(np.isfinite(bend) & (bend < 0), 0.5 * (a - c) / bend, 0.0)
        best = grid[rows, at] + np.where(edge, 0.0, np.clip(move, -0.5, 0.5) * self.scale)
        constant = ~good.any(axis=1)
        lam = np.where(constant, 1.0, best)
        scale = np.where(constant, self.scale, np.where(edge, self.scale * 2, np.maximum(self.scale / 4, 1e-3)))
        return lam, PowerMoments.around(np.where(constant, self.centre, best), scale)


def refit_now(n_before: int, first: int = 100, every: int = 5000) -> bool:
    """Whether the transform is fitted anew after the window that makes ``n_before`` + 1; see ``refit_due``."""
    return n_before + 1 == first or (n_before > 0 and n_before % every == 0)


def refit_due(n_before: Column, first: int = 100, every: int = 5000) -> Column:
    """True on windows after which the transform is fitted anew."""
    return (n_before + 1 == first) | ((n_before > 0) & (n_before % every == 0))


def lambda_vectors(lambdas: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lambdas.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(dim, lam))), t -> t.lam)").alias("lambdas"))


def apply_power(vectors: DataFrame, lambdas: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Transforms the vector of keys with fitted lambdas; others pass unchanged."""
    joined = vectors.join(lambda_vectors(lambdas, keys), list(keys), "left")
    changed = F.zip_with(vector, "lambdas", yeo_johnson)
    return joined.withColumn(vector, F.coalesce(changed, F.col(vector))).drop("lambdas")


def learning_gate(suspicious: Column, threat: Column, severity: Column, gap_ms: Column, drift_limit: int = 5, idle_ms: int = 600_000) -> Column:
    """May this window change the baseline? Quiet ones and mild drift may, unless just back from idle."""
    mild = (threat == "USER_DRIFT") & (severity <= drift_limit)
    return (~suspicious | mild) & (F.coalesce(gap_ms, F.lit(0)) <= idle_ms)


def with_device_state(windows: DataFrame, state: DataFrame) -> DataFrame:
    """Windows with the stored state of their device, null for a new device."""
    return windows.join(state, "device_id", "left")
