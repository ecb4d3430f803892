"""Language identification in two levels: the family first, then pairwise linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.chargrams import frequencies, mean_of
from tidewatch.llm.common import bounded_sample, without
from tidewatch.session import materialise

#: Families of common languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl mk pl cs sk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt am",
}
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    low: int = 1
    high: int = 3
    bits: int = 12
    #: Rows of each language that the model is fitted on, at most. Bounds what the driver fits.
    rows_per_language: int = 400
    ridge: float = 1e-4
    steps: int = 150
    #: Frequencies are small numbers; they are scaled so that margins are near 1.
    scale: float = 30.0
    families: Mapping[str, str] = field(default_factory=lambda: dict(FAMILIES))


def _fit_svm(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM (squared hinge, ridge), by accelerated gradient descent.

    Classes weigh the same in total, however many rows each has.
    """
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)  # as x is, else every product would copy x
    v = np.ones(x.shape[1] + 1, dtype=np.float32)
    for _ in range(20):
        v /= np.linalg.norm(v)
        z = weight * (x @ v[:-1] + v[-1])
        v = np.append(x.T @ z, z.sum())
    rate = 1.0 / (2 * np.linalg.norm(v) * 1.1 + ridge)
    rate = np.float32(rate)
    w, old, t = np.zeros_like(v), np.zeros_like(v), 1.0
    for _ in range(steps if n else 0):
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at = w + np.float32((before - 1) / t) * (w - old)
        short = np.maximum(np.float32(0), 1 - y * (x @ at[:-1] + at[-1]))
        pull = -2 * weight * y * short
        grad = np.append(x.T @ pull + np.float32(ridge) * at[:-1], pull.sum())
        old, w = w, at - rate * grad
    return w


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: list[str]
    groups: list[list[str]]  # the languages of each family
    family: np.ndarray  # one column for each family, last row the bias
    pairs: list[list[tuple[int, int]]]
    within: list[np.ndarray]  # for each family one column for each pair

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        s, names, score = self.settings, [UNKNOWN] * len(texts), np.zeros(len(texts))
        open_ = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        if not open_ or not self.groups:
            return names, score
        known = [texts[i] for i in open_]
        m = mean_of(known, s.low, s.high, s.bits, self.family[:-1]) * s.scale + self.family[-1]
        best = m.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * m[np.arange(len(known)), best])) if len(self.groups) > 1 else np.ones(len(known))
        for f, group in enumerate(self.groups):
            own = np.flatnonzero(best == f)
            if not len(own):
                continue
            votes = np.zeros((len(own), len(group)))
            if self.pairs[f]:
                d = mean_of([known[i] for i in own], s.low, s.high, s.bits, self.within[f][:-1]) * s.scale + self.within[f][-1]
                for k, (a, b) in enumerate(self.pairs[f]):
                    p = 1 / (1 + np.exp(-4 * d[:, k]))
                    votes[:, a] += p
                    votes[:, b] += 1 - p
                votes /= len(group) - 1
            else:
                votes[:] = 1.0
            for i, v in zip(own, votes, strict=True):
                names[open_[i]] = group[int(v.argmax())]
                score[open_[i]] = sure[i] * v.max()
        return names, score


def train(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on ``labelled`` (id, text, lang); rows without text or language are left out.

    Of each language at most ``rows_per_language`` rows are used, those whose ids hash lowest; whole texts are read, rows
    that repeat id, language and text count once. The
    features are frequencies of hashed character n-grams. One machine per family tells it from the others, one per pair
    of its languages tells these apart. Without rows every text is predicted as unknown.
    """
    s = settings or Settings()
    labelled = labelled.filter("text is not null and lang is not null").select("id", "text", "lang")
    ids = labelled.select("id", "lang")
    languages = sorted(r[0] for r in ids.select("lang").distinct().collect())
    family_of = {code: name for name, codes in s.families.items() for code in codes.split()}
    by_family: dict[str, list[str]] = {}
    for lang in languages:
        by_family.setdefault(family_of.get(lang, f"only {lang}"), []).append(lang)
    groups = [by_family[k] for k in sorted(by_family)]
    width = 1 << s.bits
    if not languages:
        return Model(s, [], [], np.zeros((width + 1, 0)), [], [])
    picks = [ids.filter(F.col("lang") == c).orderBy(F.xxhash64("id"), "id").limit(s.rows_per_language) for c in languages]
    chosen = picks[0]
    for p in picks[1:]:
        chosen = chosen.union(p)
    sample = bounded_sample(labelled, materialise(chosen.distinct(), "picks"), "lang", s.rows_per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in frequencies(batch.column("text").to_pylist(), s.low, s.high, s.bits)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])

    found = materialise(sample.select("lang", "text").repartition(8).mapInArrow(features, "lang string, x binary"), "frequencies")
    x = np.zeros((found.count(), width), dtype=np.float32)  # bounded by the sample
    langs = []
    for i, r in enumerate(found.orderBy("lang", F.xxhash64("x")).toLocalIterator()):
        x[i] = np.frombuffer(r.x, dtype=np.float32)
        langs.append(r.lang)
    x *= s.scale
    y = np.array(langs)

    def machine(rows: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return _fit_svm(x[rows], np.where(positive, 1.0, -1.0), s.ridge, s.steps)

    every = np.arange(len(y))
    family = [machine(every, np.isin(y, g)) for g in groups] if len(groups) > 1 else [np.zeros(width + 1) for _ in groups]
    pairs = [list(combinations(range(len(g)), 2)) for g in groups]
    within = []
    for g, ps in zip(groups, pairs, strict=True):
        cols = []
        for a, b in ps:
            own = np.flatnonzero((y == g[a]) | (y == g[b]))
            cols.append(machine(own, y[own] == g[a]))
        within.append(np.stack(cols, axis=1).astype(np.float32) if cols else np.zeros((width + 1, 0), np.float32))
    return Model(s, languages, groups, np.stack(family, axis=1).astype(np.float32), pairs, within)


def identify_language(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or "und" without any letter) and score (0 .. 1).

    Columns of these names are replaced. Only the text is an input; the whole of it is read. A null, empty or letterless
    text is "und" with score 0. An empty table gives an empty result.
    Without ``keep_text`` the text is read but not returned.
    """
    docs = without(docs, ["lang_pred", "score"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size follows from the settings and the languages
    shape = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    at = docs.columns.index(text_col)
    out = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                names, score = sent.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in out], pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=[*[part.schema.names[i] for i in out], "lang_pred", "score"],
                )

    return docs.mapInArrow(run, (shape if keep_text else shape.drop(text_col)).schema)
