"""Approximate nearest neighbours by cosine: probed lists, in which partial distances abandon candidates early."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_side
from tidewatch.session import materialise

#: Dimensions of a column block; rows and queries of a cell; rows that are scanned between two looks at the thresholds.
COLUMNS, ROWS, QUERIES, CHUNK = 16, 8192, 2048, 512
FOUND = "query long, vec_id long, score double"


@dataclass
class Lists:
    """The fitted index: a rotation of d dimensions, one centre per list (rotated, of length 1) and how many lists a query probes."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int = 0
    recall: float = 1.0


def _usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda c: c != 0), F.lit(False))


def _grid(column: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of doubles, each scaled by a power of two so that its squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    top = np.abs(x).max(axis=1, initial=0.0)
    return np.ldexp(x, -np.frexp(top)[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and the same for the same two vectors wherever they stand."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _centres(sample: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of a bounded sample; one centre of zeros without any."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 8192] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def adaptive_scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, safety: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the k nearest, and the squared distances of the rotated unit vectors.

    Distances are summed up by blocks of ``COLUMNS`` rotated columns. After t of d columns the partial distance, times d / t, estimates
    the whole one; if it exceeds the query's threshold by more than a factor (1 + safety / sqrt(t)) ** 2, the hypothesis
    that the row is nearer than the threshold is rejected and the row is abandoned. The threshold is the k-th smallest distance seen so
    far (at the start ``bound``), renewed after every ``CHUNK`` rows.
    """
    d = x.shape[1]
    best = np.full((len(q), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        limit = np.minimum(bound, best[:, -1])
        first = min(COLUMNS, d)
        # All rows start: the first block is one product of matrices.
        a, b = q[:, :first], part[:, :first]
        partial = np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))
        t = first
        i, j = np.nonzero(partial <= (limit * ((1 + safety / math.sqrt(t)) ** 2 * t / d if t < d else 1.0) + 1e-12)[:, None])
        partial = partial[i, j]
        while t < d and len(i):
            end = min(d, t + COLUMNS)
            partial = partial + np.square(q[i, t:end] - part[j, t:end]).sum(axis=1)
            t = end
            stay = partial <= limit[i] * ((1 + safety / math.sqrt(t)) ** 2 * t / d if t < d else 1.0) + 1e-12
            i, j, partial = i[stay], j[stay], partial[stay]
        if not len(i):
            continue
        order = np.lexsort((partial, i))
        i, j, partial = i[order], j[order], partial[order]
        heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(i)]])))
        near = rank < k
        more = np.full((len(q), k), np.inf)
        more[i[near], rank[near]] = partial[near]
        best = np.sort(np.concatenate([best, more], axis=1), axis=1)[:, :k]
        near = partial <= best[i, -1] + 1e-12
        found.append((i[near], j[near] + at, partial[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, far = (np.concatenate(z) for z in zip(*found, strict=True))
    stay = far <= np.minimum(bound, best[:, -1])[i] + 1e-12
    return i[stay], j[stay], far[stay]


def _top(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best scores, ties to the smaller id."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(q)]])))
    return order[rank < k]


def _assigned(rows: DataFrame, lists: Lists, d: int, probes: int) -> DataFrame:
    """``rows`` (key, v, ...) with the ``probes`` nearest lists of each (array of ints, nearest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = _units(_grid(part.column("v"), d)) @ lists.rotation @ lists.centres.T
                if probes == 1:
                    order = near.argmax(axis=1)[:, None]
                else:
                    order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                offsets = pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32())
                lists_of = pa.ListArray.from_arrays(offsets, pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("v"), lists_of], names=["key", "v", "lists"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("key", "v").mapInArrow(run, f"key long, v {kind}, lists array<int>")


def _cells(d: int, k: int, lists: Lists, safety: float):
    """Rows of both sides, sorted by cell, to each query's k best of the cell."""

    def scan(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        if asks.all() or not asks.any():
            return
        keys = t.column("key").to_numpy()
        grid = _grid(t.column("v").combine_chunks(), d)
        turned = _units(grid) @ lists.rotation
        bound = t.column("bound").to_numpy()[asks]
        i, j, _ = adaptive_scan(turned[~asks], turned[asks], bound, k, safety)
        if not len(i):
            return
        query, ident, score = keys[asks][i], keys[~asks][j], np.empty(len(i))
        for at in range(0, len(i), 65536):
            s = slice(at, at + 65536)
            score[s] = _cosines(grid[asks][i[s]], grid[~asks][j[s]])
        keep = _top(query, ident, score, k)
        yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(ident[keep]), pa.array(score[keep])], names=["query", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy() for c in ("list", "block", "qblock")]
            edges = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = tuple(m[a] for m in marks)
                if held and here != cell:
                    yield from scan(pa.Table.from_batches(held))
                    held = []
                cell = here
                held.append(batch.slice(a, b - a))
        if held:
            yield from scan(pa.Table.from_batches(held))

    return run


def _search(rows: DataFrame, asks: DataFrame, lists: Lists, d: int, k: int, safety: float, rows_per_cell: int, queries_per_cell: int) -> DataFrame:
    """(query, vec_id, score): for each (key, v, list, bound) of ``asks`` the k best of that list among ``rows`` (key, v, list).

    A list of many rows or queries is cut in blocks by hash; every block of rows meets every block of queries of its list in a cell of
    its own, so no task grows with a hot list.
    """
    n = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(asks.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list")
    shape = materialise(
        n.select("list", F.ceil(F.col("n") / rows_per_cell).cast("int").alias("blocks"), F.ceil(F.col("m") / queries_per_cell).cast("int").alias("qblocks")),
        "cells",
    )
    shape = small_side(shape)

    def side(df: DataFrame, own: str, other: str, flag: bool, bound: Column) -> DataFrame:
        first, second = ("block", "qblock") if not flag else ("qblock", "block")
        df = df.join(shape, "list").withColumn(first, F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        df = df.withColumn(second, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.select("list", "block", "qblock", F.lit(flag).alias("asks"), "key", "v", bound.alias("bound"))

    both = side(rows, "blocks", "qblocks", False, F.lit(0.0)).unionByName(side(asks, "qblocks", "blocks", True, F.col("bound")))
    both = both.repartition("list", "block", "qblock").sortWithinPartitions("list", "block", "qblock")
    return both.mapInArrow(_cells(d, k, lists, safety), FOUND)


def _exact(rows: DataFrame, keys: np.ndarray, queries: np.ndarray, d: int, k: int) -> dict[int, np.ndarray]:
    """For a few queries the keys of their k nearest of all ``rows``; every task sends on at most k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(queries)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = units @ _units(_grid(part.column("v"), d)).T
                take = min(k, near.shape[1])
                cols = np.argpartition(-near, take - 1, axis=1)[:, :take]
                score = np.take_along_axis(near, cols, 1).ravel()
                ident = part.column("key").to_numpy()[cols].ravel()
                query = np.repeat(keys, take)
                all_ = [np.concatenate(z) for z in zip(best, (query, ident, score), strict=True)]
                keep = _top(*all_, k)
                best = [z[keep] for z in all_]
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in best], names=["query", "vec_id", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = rows.select("key", "v").mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out: dict[int, list[int]] = {}
    for query, ident in found.select("query", "vec_id").collect():
        out.setdefault(query, []).append(ident)
    return {q: np.array(v) for q, v in out.items()}


def fit_lists(rows: DataFrame, asks: DataFrame, d: int, k: int, sample: int = 65_536, rows_per_list: int = 64, most_lists: int = 2048, trials: int = 256, goal: float = 0.96, seed: int = 12) -> Lists:
    """Rotation, centres and number of probed lists for ``rows`` (key, v) and queries ``asks`` (key, v).

    The centres are fitted on at most ``sample`` rows (and 64 MB), those of smallest hash; there are about as many lists as ``rows`` / ``rows_per_list``,
    ``most_lists`` at most. How many lists must be probed is measured: for the ``trials`` queries of smallest hash the k nearest of all rows are
    found by brute force, and the number of lists is the smallest with which a share ``goal`` of them is reached. ``recall`` is that share.
    """
    n = rows.count()
    rotation = _rotation(d, seed)
    sample = max(1, min(sample, (64 << 20) // (8 * d)))
    rate = min(1.0, 1.2 * sample / max(n, 1))
    picked = rows.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    picked = picked.select("v", F.xxhash64("key", F.lit(seed)).alias("h"), "key").orderBy("h", "key").limit(sample).select("v").toArrow()
    points = _units(_grid(picked.column("v").combine_chunks(), d)) @ rotation
    lists = Lists(rotation, _centres(points, int(min(most_lists, max(1, n // rows_per_list))), seed))
    tried = asks.select("key", "v", F.xxhash64("key", F.lit(seed)).alias("h")).orderBy("h", "key").limit(trials).select("key", "v").toArrow()
    if not tried.num_rows:
        lists.probes = 1
        return lists
    keys = tried.column("key").to_numpy()
    queries = _grid(tried.column("v").combine_chunks(), d)
    truth = _exact(rows, keys, queries, d, k)
    wanted = sorted({int(x) for v in truth.values() for x in v})
    spark = rows.sparkSession
    those = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in wanted], "key long")), "key", "left_semi")
    home = {r[0]: r[1][0] for r in _assigned(those, lists, d, 1).select("key", "lists").collect()}
    order = np.argsort(-(_units(queries) @ rotation @ lists.centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    ranks = np.sort(np.array([place[i, home[int(x)]] for i, q in enumerate(keys) for x in truth.get(int(q), ())]))
    lists.probes = int(ranks[min(len(ranks) - 1, math.ceil(goal * len(ranks)) - 1)]) + 1
    lists.recall = float((ranks < lists.probes).mean())
    return lists


def nearest(
    rows: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", safety: float = 2.1,
    rows_per_cell: int = ROWS, queries_per_cell: int = QUERIES, **fit,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``rows`` for which ``asked`` (a condition on its columns) holds the k nearest other rows.

    Nearness is the cosine in double precision, larger first, ties to the smaller id; with fewer other rows, all of them. Vectors that are
    null, empty, zero or hold null, NaN or infinite entries take no part, nor do rows without id and, if lengths differ, those not of the
    most frequent length (ties: the longest). A row is known by its id: repeated rows are one, and of rows that share an id with different vectors the
    one with the smallest hash stays. Other columns are ignored; an empty table or no query gives an empty result.

    Equal vectors are one candidate under their smallest id and one query; of an id's equals only the k + 1 smallest ids can be among the
    answers, so these stand for all, exactly. Every distinct vector is put in the list of its nearest centre (``fit_lists``). A query first
    scans its nearest list; its k-th distance there is the threshold with which it goes through the others it probes (``adaptive_scan``).
    Recall is not 1: of the lists only some are probed, and an abandoned row may, rarely, have been near.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    base = materialise(base.filter(F.col("id").isNotNull() & _usable(F.col("v"))), "vectors")
    size = base.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = size[0] if size else 1
    entry = F.transform("v", lambda c: c.cast("double") + F.lit(0.0))
    base = base.filter(F.size("v") == d).withColumns({"one": F.xxhash64(entry), "two": F.xxhash64(F.lit(1), entry)})
    several = base.groupBy("id").agg(F.min(F.struct("one", "two")).alias("low"), F.max(F.struct("one", "two")).alias("high"))
    several = materialise(several.filter("low <> high").select(F.col("id").alias("again"), "low"), "several")
    base = base.join(small_side(several), F.col("id") == F.col("again"), "left").filter("again is null or (one = low.one and two = low.two)").drop("again", "low")
    same = Window.partitionBy("one", "two").orderBy("id")
    kept = base.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    kept = materialise(kept.select("id", "v", "one", "two", "place"), "distinct")
    copies = materialise(kept.filter("place > 1").select("one", "two", "id"), "copies")
    reps = kept.filter("place = 1")
    points = reps.select(F.col("id").alias("key"), "v")
    wanted = base.filter("asked").select("id", "one", "two").distinct()
    wanted = materialise(wanted.join(reps.select("one", "two", F.col("id").alias("key")), ["one", "two"]).select("id", "key"), "queries")
    asks = materialise(points.join(small_side(wanted.select("key").distinct()), "key", "left_semi"), "asked")
    lists = fit_lists(points, asks, d, k + 1, **fit)

    homes = materialise(_assigned(points, lists, d, 1).select("key", "v", F.element_at("lists", 1).alias("list")), "lists")
    probes = _assigned(asks, lists, d, lists.probes).select("key", "v", F.posexplode("lists").alias("nth", "list"))
    cells = (lists, d, k + 1, safety, rows_per_cell, queries_per_cell)
    first = materialise(_search(homes, probes.filter("nth = 0").withColumn("bound", F.lit(float("inf"))), *cells), "first")
    held = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    far = F.when(F.col("n") > k, F.greatest(2 - 2 * F.col("worst"), F.lit(0.0)) + 1e-9).otherwise(F.lit(float("inf")))
    held = held.select(F.col("query").alias("key"), far.alias("far"))
    later = probes.filter("nth > 0").join(held, "key", "left").withColumn("bound", F.coalesce("far", F.lit(float("inf")))).drop("far")
    found = first.unionByName(_search(homes, later, *cells))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank"), "found")

    # Equal vectors stand for each other, with the same score; then each query leaves out its own id.
    ids = kept.filter("place = 1").select(F.col("id").alias("vec_id"), "one", "two")
    again = found.join(ids.join(copies.select("one", "two", F.col("id").alias("copy")), ["one", "two"]), "vec_id")
    found = found.unionByName(again.select("query", F.col("copy").alias("vec_id"), "score")).withColumnRenamed("query", "key")
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    out = wanted.join(found, "key").filter("id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")))
    return out.filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("vec_id").alias("vec_id"), "score")
