"""Order-dependent operators that survive one key holding a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here every key is cut
into time buckets; the buckets are summarised by a partially aggregated ``groupBy``, the
summaries (one row per key and bucket, so bounded by the time span and not by the volume)
are accumulated with a window, and the result is joined back on (key, bucket), which is
the partitioning the row-level window already has. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.session import materialise

BUCKET_MS = 6 * 3_600_000
ID_BUCKET = 65_536


def order_bucket(ts_ms: str, tie: str, bucket_ms: int = BUCKET_MS) -> Column:
    """A bucket number that is monotone in (ts_ms, tie).

    Rows without a time carry 0 and may be many, so these are cut by their id instead.
    """
    ts = F.col(ts_ms)
    return (
        F.when(ts > 0, F.expr(f"`{ts_ms}` div {bucket_ms}"))
        .when(ts == 0, F.expr(f"`{tie}` div {ID_BUCKET}") - F.lit(1 << 50))
        .otherwise(F.floor(ts / bucket_ms) - F.lit(1 << 60))
        .cast("long")
    )


def _bucketed(df: DataFrame, ts_ms: str, tie: str, bucket_ms: int) -> DataFrame:
    return df.withColumn("_b", order_bucket(ts_ms, tie, bucket_ms))


def number_rows(
    df: DataFrame, keys: Sequence[str], ts_ms: str = "ts_ms", tie: str = "event_id",
    target: str = "seq", total: str | None = None, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Dense 0-based position of each row inside its key (and the size of the key)."""
    rows = _bucketed(df, ts_ms, tie, bucket_ms)
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    base = (
        rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    )
    if total:
        base = base.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_b").orderBy(ts_ms, tie)
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(base.drop("_n"), [*keys, "_b"])
        .withColumn(target, F.col("_base") + F.col("_r") - 1)
        .drop("_b", "_r", "_base")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts_ms: str = "ts_ms", tie: str = "event_id",
    target: str = "prev", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Adds a struct with ``columns`` of the previous row of the key (null on the first)."""
    rows = _bucketed(df, ts_ms, tie, bucket_ms)
    kept = F.struct(*columns)
    carry = (
        rows.groupBy(*keys, "_b").agg(F.max_by(kept, F.struct(ts_ms, tie)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(ts_ms, tie)
    return (
        rows.withColumn("_lag", F.lag(kept).over(inside))
        .join(carry, [*keys, "_b"])
        .withColumn(target, F.coalesce("_lag", "_carry"))
        .drop("_b", "_lag", "_carry")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], value: str, target: str, ts_ms: str = "ts_ms", tie: str = "event_id",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Latest non-null ``value`` of the key up to and including each row."""
    rows = _bucketed(df, ts_ms, tie, bucket_ms)
    at = F.when(F.col(value).isNotNull(), F.struct(ts_ms, tie))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_b").agg(F.max_by(value, at).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(ts_ms, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_run", F.last(value, ignorenulls=True).over(inside))
        .join(carry, [*keys, "_b"])
        .withColumn(target, F.coalesce("_run", "_carry"))
        .drop("_b", "_run", "_carry")
    )


def running(
    df: DataFrame, keys: Sequence[str], seq: str, columns: dict[str, tuple[str, Column]], chunk: int = 50_000,
) -> DataFrame:
    """Running sums or minima in ``seq`` order, cut into chunks of consecutive rows.

    ``columns`` maps each new column to ("sum" or "min", value); all share the same pass.
    """
    ops = {"sum": F.sum, "min": F.min}
    rows = df.withColumn("_c", F.floor(F.col(seq) / chunk)).select(
        "*", *[value.alias(f"_v_{n}") for n, (_, value) in columns.items()])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_c").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    carry = rows.groupBy(*keys, "_c").agg(*[ops[how](f"_v_{n}").alias(f"_t_{n}") for n, (how, _) in columns.items()]).select(
        *keys, "_c", *[ops[how](f"_t_{n}").over(before).alias(f"_carry_{n}") for n, (how, _) in columns.items()])
    joined = rows.select("*", *[ops[how](f"_v_{n}").over(inside).alias(f"_run_{n}") for n, (how, _) in columns.items()]).join(
        carry, [*keys, "_c"])

    def total(name: str, how: str) -> Column:
        run, brought = F.col(f"_run_{name}"), F.col(f"_carry_{name}")
        return run + F.coalesce(brought, F.lit(0.0)) if how == "sum" else F.least(run, brought)

    return joined.select(*df.columns, *[total(n, how).alias(n) for n, (how, _) in columns.items()])


def framed(
    df: DataFrame, keys: Sequence[str], seq: str, reach: int,
    build: Callable[[Callable[[int], Window]], dict[str, Column]], chunk: int = 50_000,
) -> DataFrame:
    """Window expressions that look back at most ``reach`` rows.

    ``build(frame)`` returns the columns, ``frame(n)`` is the window of the last n rows.
    A key is cut into chunks; the last ``reach`` rows of a chunk are repeated in the next.
    """
    chunk = max(chunk, reach + 1)
    here = F.floor(F.col(seq) / chunk)
    homes = F.when(
        F.col(seq) % chunk >= chunk - reach,
        F.array(F.struct(here.alias("c"), F.lit(True).alias("own")), F.struct((here + 1).alias("c"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(here.alias("c"), F.lit(True).alias("own"))))
    rows = df.withColumn("_h", F.explode(homes))
    rows = rows.select(*df.columns, F.col("_h.c").alias("_c"), F.col("_h.own").alias("_own"))
    base = Window.partitionBy(*keys, "_c").orderBy(seq)

    def frame(n: int):
        return base.rowsBetween(-(n - 1), 0)

    for name, column in build(frame).items():
        rows = rows.withColumn(name, column)
    return rows.filter("_own").drop("_c", "_own")


def _slices(pdf: pd.DataFrame, names: list[str]) -> list[tuple[tuple, int, int]]:
    """(key, begin, end) of each run of equal keys in a sorted batch."""
    columns = [pdf[n].to_numpy() for n in names]
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(changed).tolist()
    ends = [*begins[1:], len(pdf)]
    return [(tuple(c[b] for c in columns), b, e) for b, e in zip(begins, ends)]


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    start: Callable[[pd.DataFrame], object], step: Callable[[object, pd.DataFrame], pd.DataFrame | list[dict] | None],
    schema: str | T.StructType, finish: Callable[[object], pd.DataFrame | None] | None = None,
) -> DataFrame:
    """A recurrence per key whose next state depends on the last one.

    Rows are shuffled by key, sorted, and streamed through Arrow batches; a task holds one
    batch and one state, never a whole key. ``step`` sees consecutive slices of one key; it may return a list of rows
    (dicts) instead of a frame, which is cheaper where slices are short.
    """
    names = list(keys)

    def joined(made: list) -> Iterator[pd.DataFrame]:
        made = [m for m in made if m is not None and len(m)]
        if made and isinstance(made[0], list):
            yield pd.DataFrame([row for m in made for row in m])
        elif made:
            yield pd.concat(made, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            made = []
            for key, begin, end in _slices(pdf, names):
                part = pdf.iloc[begin:end]
                if key != current:
                    if current is not None and finish is not None:
                        made.append(finish(state))
                    current, state = key, start(part)
                made.append(step(state, part))
                if len(made) >= 128:  # of many keys with large results only a few are held
                    yield from joined(made)
                    made = []
            yield from joined(made)
        if current is not None and finish is not None:
            last = finish(state)
            if last is not None and len(last):
                yield last

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str],
    start: Callable[[dict[str, np.ndarray]], object], step: Callable[[object, dict[str, np.ndarray]], dict[str, np.ndarray]],
    outputs: dict[str, T.DataType], drop: Sequence[str] = (),
) -> DataFrame:
    """Like ``ordered_fold`` with one output row per input row, on bare arrays.

    ``step`` gets the input columns of a slice and returns the new columns; all other
    columns pass through untouched.
    """
    names, needed = list(keys), list(inputs)
    passed = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*passed, *[T.StructField(n, t) for n, t in outputs.items()]])
    kept = [f.name for f in passed]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            arrays = {c: pdf[c].to_numpy() for c in needed}
            parts: dict[str, list] = {n: [] for n in outputs}
            for key, begin, end in _slices(pdf, names):
                piece = {c: a[begin:end] for c, a in arrays.items()}
                if key != current:
                    current, state = key, start(piece)
                for name, values in step(state, piece).items():
                    parts[name].append(values)
            yield pdf[kept].assign(**{n: np.concatenate(v) for n, v in parts.items()})

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def merge_levels(
    parts: DataFrame, keys: Sequence[str], place: str, most: int,
    start: Callable[[pd.DataFrame], object], add: Callable[[object, pd.DataFrame], None], whole: Callable[[object], dict[str, object]],
    fan_in: int = 64,
) -> DataFrame:
    """One row per key from partial results that can be merged with their neighbours.

    ``parts`` holds a row for each key and ``place`` (0 .. ``most`` - 1, gaps allowed), all other columns are the summary. In each level
    every ``fan_in`` neighbours are merged by one fold, in order, so no task holds more than that of a key, however many there are.
    ``whole(state)`` gives the summary columns of a fold.
    """
    keys = list(keys)
    schema = T.StructType(parts.schema.fields)
    names = [f.name for f in schema]

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(place)
        state = start(part)
        add(state, part)
        out = part.iloc[:1][[*keys, "_level"]].rename(columns={"_level": place})
        return out.assign(**{k: [v] for k, v in whole(state).items()})[names]

    while True:
        level = parts.withColumn("_level", F.floor(F.col(place) / fan_in).cast("long"))
        # A group is one batch of at most ``fan_in`` rows; batches of 10,000 summaries would not fit a worker.
        parts = level.groupBy(*keys, "_level").applyInPandas(merged, schema)
        most = -(-most // fan_in)
        if most <= 1:
            return parts
        parts = materialise(parts, "merge-level")


def linear_recurrence(
    df: DataFrame, keys: Sequence[str], seq: str, a: Column, b: Column, start: float,
    target: str, before: str | None = None, chunk: int = 4096,
) -> DataFrame:
    """y = a * y_previous + b in ``seq`` order, in parallel over chunks of one key.

    A chunk as a whole is again y_out = A * y_in + B, so the chunks are chained first (one
    row per chunk) and then every chunk is walked on its own with its true start value.
    """
    rows = df.withColumn("_c", F.floor(F.col(seq) / chunk)).withColumn("_a", a).withColumn("_bb", b)
    rows = materialise(rows, "recurrence")  # read twice below: reduced to chunks, then walked
    inner = [*keys, "_c"]
    # A chunk holds at most ``chunk`` rows, so it is reduced to A and B as one small array.
    chunks = rows.groupBy(*inner).agg(F.array_sort(F.collect_list(F.struct(seq, "_a", "_bb"))).alias("_rows")).withColumn(
        "_t", F.expr("aggregate(_rows, struct(1D AS A, 0D AS B), (t, r) -> struct(r._a * t.A AS A, r._a * t.B + r._bb AS B))"))

    def chain(state: list[float], piece: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        entry = []
        for x, y in zip(piece["_A"].tolist(), piece["_B"].tolist()):
            entry.append(state[0])
            state[0] = x * state[0] + y
        return {"_entry": np.asarray(entry)}

    entries = ordered_scan(
        chunks.select(*inner, F.col("_t.A").alias("_A"), F.col("_t.B").alias("_B")), keys, ["_c"], ["_A", "_B"],
        lambda piece: [start], chain, {"_entry": T.DoubleType()}, drop=["_A", "_B"])
    before = before or "_before"

    def enter(piece: dict[str, np.ndarray]) -> list[float]:
        return [float(piece["_entry"][0])]

    def walk(state: list[float], piece: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        y = state[0]
        ys = [y]
        for p, q in zip(piece["_a"].tolist(), piece["_bb"].tolist()):
            y = p * y + q
            ys.append(y)
        state[0] = y
        return {before: np.asarray(ys[:-1]), target: np.asarray(ys[1:])}

    walked = ordered_scan(
        rows.join(entries, inner), inner, [seq], ["_a", "_bb", "_entry"], enter, walk,
        {before: T.DoubleType(), target: T.DoubleType()}, drop=["_c", "_a", "_bb", "_entry"])
    return walked if before != "_before" else walked.drop("_before")
