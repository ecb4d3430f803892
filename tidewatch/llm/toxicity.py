"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.chargrams import presence
from tidewatch.llm.common import bounded_sample, without
from tidewatch.session import materialise


@dataclass(frozen=True)
class Settings:
    low: int = 4
    high: int = 6
    bits: int = 20
    #: Labelled rows of each class that the model is fitted on, at most. Bounds what the driver fits.
    rows_per_class: int = 4000
    #: n-grams that the model keeps, those that tell the classes apart best, and the documents each must be in (fewer if there are few toxic rows).
    features: int = 4096
    least_docs: int = 10
    ridge: float = 1e-3
    steps: int = 400
    #: Parts of the fitted rows of which each is scored by a model of the others, to place the threshold.
    folds: int = 3


@dataclass(frozen=True)
class Model:
    """``weights`` has one entry for each n-gram hash, 0 where it is no feature. A text's score is the logistic function of
    ``bias`` plus the weights of its distinct n-grams."""

    settings: Settings
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = self.settings
        z = [float(self.weights[g].sum()) for g in presence(texts, s.low, s.high, s.bits, self.weights != 0)]
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + np.array(z, dtype=float), -40, 40)))


def _presence_of(s: Settings, kept: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [g.tobytes() for g in presence(part.column("text").to_pylist(), s.low, s.high, s.bits, kept)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(found, pa.binary())], names=["label", "grams"])

    return run


def _counted(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << bits), dtype=np.int32)
        for batch in batches:
            for label, grams in zip(batch.column("label").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                table[label, np.frombuffer(grams, dtype=np.int32)] += 1
        seen = np.flatnonzero(table.any(axis=0))
        for at in range(0, len(seen), 50_000):
            g = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(table[1, g]), pa.array(table[0, g])], names=["gram", "pos", "neg"])

    return run


def _fit_logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent of the ridge logistic loss over rows of feature positions, values ``ratio``."""
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    val = ratio[col]
    n, k = len(rows), len(ratio)
    # The largest curvature, by power iteration on X'X.
    v = np.ones(k + 1)
    for _ in range(20):
        v /= np.linalg.norm(v)
        z = np.bincount(row, val * v[col], n) + v[k]
        v = np.append(np.bincount(col, val * z[row], k), z.sum())
    rate = 1.0 / (0.25 * np.linalg.norm(v) / n * 1.1 + ridge)
    w, old, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(steps):
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at = w + (before - 1) / t * (w - old)
        z = np.bincount(row, val * at[col], n) + at[k]
        miss = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(col, val * miss[row], k), miss.sum()) / n
        grad[:k] += ridge * at[:k]
        old, w = w, at - rate * grad
    return w[:k], float(w[k])


def _log_ratios(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-count ratios of n-grams in ``pos`` of n1 and ``neg`` of n0 rows, smoothed by the class shares."""
    share = n1 / (n1 + n0)
    return np.log((pos + share) / share) - np.log((neg + 1 - share) / (1 - share)) - np.log((n1 + 1) / share) + np.log((n0 + 1) / (1 - share))


def _threshold(rows: list[np.ndarray], y: np.ndarray, pos: np.ndarray, neg: np.ndarray, weight: tuple[float, float], s: Settings) -> float | None:
    """The logit that tells the classes apart best, by the F1 of rows scored by models that were fitted without them.

    A row of class 0 or 1 counts ``weight`` times, so a class of which few rows were fitted counts as much as in all labels. The middle of
    equally good cuts is taken. None with fewer than ten rows a fold of either class.
    """
    if min(y.sum(), (1 - y).sum()) < 10 * s.folds:
        return None
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % s.folds
    z = np.zeros(len(y))
    for k in range(s.folds):
        out = fold == k
        p, q = pos.copy(), neg.copy()
        for i in np.flatnonzero(out):
            (p if y[i] else q)[rows[i]] -= 1
        ratio = _log_ratios(p, q, y[~out].sum(), (1 - y[~out]).sum())
        w, bias = _fit_logistic([rows[i] for i in np.flatnonzero(~out)], y[~out], ratio, s.ridge, s.steps)
        flat = w * ratio
        for i in np.flatnonzero(out):
            z[i] = bias + flat[rows[i]].sum()
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum(y[order] * weight[1]), np.cumsum((1 - y[order]) * weight[0])
    f1 = 2 * hit / (hit + miss + y.sum() * weight[1])
    cut = z[order][:-1] > z[order][1:]  # a threshold lies between two different scores
    best = np.flatnonzero(cut & (f1[:-1] >= f1[:-1][cut].max() - 1e-12)) if cut.any() else []
    if not len(best):
        return None
    k = int(best[len(best) // 2])
    return float((z[order][k] + z[order][k + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on ``docs`` (id, text) by ``labels`` (id, label 0 or 1); other labels are left out, a null text counts as empty.

    Of each class at most ``rows_per_class`` labels are used, those whose ids hash lowest, so only their texts are read out
    of the documents; rows that repeat id, label and text count once, and of one id's different texts no more than this bound either. Document frequencies of all n-grams are counted by class in tasks and summed; features are the
    ones with the largest chi-square statistic. Feature values are log-count ratios, smoothed by the class shares, so that
    an unseen n-gram has ratio 0. Score 0.5 is where cross-validation on the fitted rows tells the classes apart best (``_threshold``), or,
    with too few rows for that, where the class shares of all labels put it. Without rows of
    both classes the model gives the share of the class. An id with several labels or texts counts with each.
    """
    s = settings or Settings()
    labels = labels.filter(F.col("label").isin(0, 1)).select("id", F.col("label").cast("int").alias("label"))
    shares = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    ones, zeros = shares.get(1, 0), shares.get(0, 0)
    flat = np.zeros(1 << s.bits, dtype=np.float32)
    only = Model(s, flat, float(np.log((ones + 0.5) / (zeros + 0.5))))
    if not ones or not zeros:
        return only
    picks = [labels.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(s.rows_per_class) for c in (0, 1)]
    sample = bounded_sample(docs, materialise(picks[0].union(picks[1]), "picks"), "label", s.rows_per_class)
    seen = materialise(sample.select("label", "text").repartition(8).mapInArrow(_presence_of(s), "label int, grams binary"), "grams")
    n1, n0 = (seen.filter(F.col("label") == c).count() for c in (1, 0))
    if not n1 or not n0:
        return only
    table = seen.coalesce(4).mapInArrow(_counted(s.bits), "gram long, pos int, neg int").groupBy("gram").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    docs, gap = F.col("pos") + F.col("neg"), F.col("pos") * float(n0) - F.col("neg") * float(n1)
    chi = gap * gap / (docs * (float(n1 + n0) - docs + 0.5))
    best = table.filter(docs >= min(s.least_docs, max(2, n1 // 20))).orderBy(chi.desc(), "gram").limit(s.features)
    best = np.array([tuple(r) for r in best.collect()], dtype=float).reshape(-1, 3)
    grams = best[:, 0].astype(np.int64)
    ratio = _log_ratios(best[:, 1], best[:, 2], n1, n0)
    kept = np.full(1 << s.bits, -1, dtype=np.int64)
    kept[grams] = np.arange(len(grams))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [kept[np.frombuffer(g, dtype=np.int32)] for g in batch.column("grams").to_pylist()]
            own = [r[r >= 0].astype(np.int32).tobytes() for r in own]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, pa.binary())], names=["label", "own"])

    fitted = seen.mapInArrow(project, "label int, own binary").collect()  # bounded by the sample
    fitted.sort()
    rows = [np.frombuffer(r.own, dtype=np.int32).astype(np.int64) for r in fitted]
    y = np.array([r.label for r in fitted], dtype=float)
    w, bias = _fit_logistic(rows, y, ratio, s.ridge, s.steps)
    flat[grams] = w * ratio
    cut = _threshold(rows, y, best[:, 1], best[:, 2], (zeros / n0, ones / n1), s)
    return Model(s, flat, bias + float(np.log(ones / zeros) - np.log(n1 / n0) if cut is None else -cut))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, score_col: str = "score") -> DataFrame:
    """``docs`` with a column score (``score_col``) in 0 .. 1; one of that name is replaced. The whole of every text is read.

    A null or empty text has the score of a text without features. An empty table gives an empty result.
    Without ``keep_text`` the text is read but not returned.
    """
    docs = without(docs, [score_col])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each hash, by the settings
    shape = docs.withColumn(score_col, F.lit(0.0))
    at = docs.columns.index(text_col)
    out = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                score = pa.array(sent.value.score(part.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in out], score], names=[*[part.schema.names[i] for i in out], score_col])

    return docs.mapInArrow(run, (shape if keep_text else shape.drop(text_col)).schema)
