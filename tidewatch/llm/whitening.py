"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no exact fixed-point value in a double.
LARGEST = float(1 << 46)
#: Rows that are multiplied at a time.
ROWS = 4096


@dataclass
class Whitening:
    """n rows were fitted, with these sums per dimension; column j of ``components`` belongs to ``values[j]``, the variance along it."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """True for a vector with entries, all of them finite and within the fixed-point range."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def fixed_point(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the usable vectors with each entry c as floor(64 * c) + 1000000.

    Dropped are null and empty vectors, those that hold null, NaN or infinite entries or one beyond 2**46, and, if lengths differ,
    all but those of the most frequent length (ties: the longest).
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    rows = materialise(rows, "vectors")
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (size[0] if size else 0))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact integer n * x - S where that fits."""
    if n < (1 << 62) // (int(np.abs(x).max(initial=1)) + 1):
        return (n * x - sums) / n
    return (x - sums // n) - (sums % n) / n


def _summed(rows: DataFrame, task: Callable[[np.ndarray], np.ndarray], d: int, length: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over blocks of centred rows of the ``length`` numbers that ``task`` gives. Tasks add up what they read; the sums of the
    tasks are added by place, so the driver gets ``length`` numbers, however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for _, x in _blocks(batches, d):
            total += task(_centred(x, n, sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["place", "value"])

    out = np.zeros(length)
    for place, value in rows.select("x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def _left(x: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows of the left vectors that belong to the centred rows ``x``: by columns of x v = u r, r upper triangular."""
    y = x @ v
    u = np.empty((len(x), r.shape[1]))
    for j in range(r.shape[1]):
        u[:, j] = (y[:, j] - u[:, :j] @ r[:j, j]) / r[j, j]
    return u


def bidiagonalise(rows: DataFrame, d: int, n: int, sums: np.ndarray, steps: int | None = None, seed: int = 11, pad: float = 1e-13):
    """(v, b): orthonormal v (d x k) and upper bidiagonal b (k x k) with X v = u b for the centred rows X and orthonormal u.

    A step takes p = X v_k - beta u_(k-1) and X^T p in one pass over the rows. u has as many rows as the table and is never
    stored: a task recomputes the entries that belong to its rows from x, v and the recurrence, with the same arithmetic each time.
    Each pass also returns u^T p, and p is freed of what it has of the earlier u, as v_(k+1) is of the earlier v: full
    reorthogonalisation on both sides. When a direction is used up (beta or alpha is below ``pad`` of the largest so far), the
    recurrence starts anew with a random vector orthogonal to v, so repeated deviations are all found. It ends when all d directions, or
    ``steps``, have been walked.
    """
    rng = np.random.default_rng(seed)
    v, r, carried = np.zeros((d, 0)), np.zeros((0, 0)), np.zeros((d, 0))
    alphas, betas = [], []

    def fresh() -> np.ndarray | None:
        for _ in range(20):
            w = rng.standard_normal(d)
            for _ in range(3):
                w -= v @ (v.T @ w)
            if np.linalg.norm(w) > 1e-8 * np.sqrt(d):
                return w / np.linalg.norm(w)
        return None

    following, beta, largest = fresh(), 0.0, 0.0
    while following is not None and v.shape[1] < min(d, steps or d):
        k = v.shape[1]
        now = following

        def task(x: np.ndarray, k=k, now=now, v=v, r=r, beta=beta) -> np.ndarray:
            u = _left(x, v, r) if k else np.zeros((len(x), 0))
            p = x @ now - (beta * u[:, -1] if k else 0.0)
            return np.concatenate([u.T @ p, [p @ p], x.T @ p])

        got = _summed(rows, task, d, k + 1 + d, n, sums)
        h, square, back = got[:k], got[k], got[k + 1 :]
        alpha = float(np.sqrt(max(0.0, square - h @ h)))
        if alpha <= pad * max(largest, np.sqrt(square)) or alpha == 0.0:
            # Nothing new is left along this vector: it has no left vector of its own.
            v, alive = np.column_stack([v, now]), False
            alphas.append(0.0)
            betas.append(beta)
            r = np.pad(r, ((0, 1), (0, 1)))
            r[k, k] = np.inf
            carried = np.column_stack([carried, np.zeros(d)])
        else:
            largest, alive = max(largest, alpha), True
            column = h.copy()
            if k:
                column[-1] += beta
            r = np.pad(r, ((0, 1), (0, 1)))
            r[:k, k], r[k, k] = column, alpha
            v = np.column_stack([v, now])
            alphas.append(alpha)
            betas.append(beta)
            carried = np.column_stack([carried, (back - carried @ h) / alpha])
        w = carried[:, -1] - alpha * now
        for _ in range(3):
            w = w - v @ (v.T @ w)
        beta = float(np.linalg.norm(w))
        if alive and beta > pad * largest:
            following = w / beta
            largest = max(largest, beta)
        else:
            following, beta = fresh(), 0.0
    return v, np.diag(alphas) + np.diag(betas[1:], 1)


def fit_whitening(rows: DataFrame, components: int = 32, steps: int | None = None, seed: int = 11) -> Whitening | None:
    """The ``components`` directions of largest variance of ``rows`` (id, x), as ``fixed_point`` gives them; None without rows.

    The singular values of the small bidiagonal matrix are sqrt(n) times the standard deviations. Sums and the total deviation are
    exact integers. Directions without variance (below rounding of the largest) are no components, so there may be fewer, or none.
    By default as many passes as dimensions are made, which is exact for any spectrum; with ``steps`` fewer, when only the
    leading, well separated ones are wanted from very long vectors.
    """
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first[0]
    parts = rows.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = np.zeros(d, dtype=np.int64)
    n = 0
    for place, s, count in parts.collect():
        sums[place], n = s, count
    v, b = bidiagonalise(rows, d, n, sums, steps, seed)
    _, sigma, right = np.linalg.svd(b)
    keep = sigma > sigma[:1].max(initial=0.0) * max(d, 8) * np.finfo(float).eps
    keep[components:] = False
    total = _summed(rows, lambda x: np.array([np.square(x).sum()]), d, 1, n, sums)[0]
    return Whitening(n, sums, (v @ right.T)[:, : len(sigma)][:, keep], np.square(sigma[keep]) / n, total / n)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact; None where that is no 64-bit integer."""
    reach = int(np.abs(x).max(initial=0)) + 1
    if n * reach * 2 < 1 << 62:
        e = n * x - sums
        if int(np.abs(e).max(initial=0)) ** 2 * e.shape[1] < 1 << 63:
            return np.square(e).sum(axis=1).tolist()
    big = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [b if b < 1 << 63 else None for b in big]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, n, deviation, whitened): each row of (id, x) centred, projected on the components and divided by their deviations.

    ``deviation`` is the row's exact squared distance from the mean, times n squared (null if that is no 64-bit integer).
    """
    d, n, sums = len(model.sums), model.n, model.sums
    turn = model.components / np.sqrt(model.values)
    width = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            w = _centred(x, n, sums) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.full(len(x), n)), pa.array(_deviations(x, n, sums), pa.int64()), lists],
                names=["id", "n", "deviation", "whitened"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity; 0 without components."""
    d, width = len(model.sums), len(model.values)
    if not width:
        return 0.0
    turn = model.components / np.sqrt(model.values)
    mean = _summed(rows, lambda x: (x @ turn).sum(axis=0), d, width, model.n, model.sums) / model.n

    def outer(x: np.ndarray) -> np.ndarray:
        w = x @ turn - mean
        return (w.T @ w).ravel()

    cov = _summed(rows, outer, d, width * width, model.n, model.sums).reshape(width, width) / model.n
    return float(np.abs(cov - np.eye(width)).max())


def whitened_components(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """One row per usable row of ``rows`` and component: id, component (from 1, by falling variance), n, deviation, whitened,
    explained (share of the total variance), identity_error (one value).

    For what is usable see ``fixed_point``. Repeated rows count each, a null id is kept, ties between variances are in an order that
    the seed decides, other columns are ignored. An empty table, or one whose rows are all equal, has no component and no row.
    """
    rows = fixed_point(rows, id_col, vector_col)
    model = fit_whitening(rows, components, **options)
    if model is None or not len(model.values):
        kind = rows.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    off = identity_error(rows, model)
    shares = F.lit([float(x) for x in model.values / model.trace])
    out = whiten(rows, model).select(F.col("id").alias(id_col), "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(off).alias("identity_error"),
    )
