"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

#: Java and Python alike: one run of the white space that separates words, and one word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of 8-byte keys that is sent to every executor (32 MB).
BROADCAST_KEYS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns whose name (in any case) an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def private(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """The id, or for a row without one a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def rank_in(cuts: list[int], value: Column) -> Column:
    """Number of ``cuts`` (sorted) below ``value``, by binary search in a constant array."""
    depth = max(1, len(cuts).bit_length())
    padded = [*cuts, *[(1 << 63) - 1] * ((1 << depth) - 1 - len(cuts))]
    padded = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")  # folded into one constant
    steps = F.lit([1 << k for k in reversed(range(depth))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(padded, at + s) < value, at + s).otherwise(at))


def share_of_id(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


def bounded_sample(docs: DataFrame, picks: DataFrame, label: str, rows: int) -> DataFrame:
    """(id, ``label``, text) of the rows of ``docs`` (id, text, maybe ``label``) that ``picks`` (id, ``label``; at most ``rows`` for each label) name.

    Equal rows are one, and of each label no more than ``rows`` are returned, those of lowest hash, however often ids are repeated.
    """
    own = [c for c in ("id", label) if c in docs.columns]
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.select(*own, "text", h.alias("h"))
    there = docs.select(*own, "h").join(F.broadcast(picks), own).select("id", label, "h").distinct()
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("id"), "id", "h"))
    there = there.withColumn("place", place).filter(F.col("place") <= rows).drop("place")
    there = materialise(there, "sample")
    found = docs.join(F.broadcast(there), [*own, "h"])
    return found.groupBy("id", label, "h").agg(F.first("text").alias("text")).select("id", label, "text")


def small_side(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` marked for broadcast if it has been counted and is below the limit, else as it is."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def sized(df: DataFrame, rows: int, per_task: int = 250_000) -> DataFrame:
    """``df``, which has about ``rows`` small rows, in no more partitions than these need (8 at least)."""
    return df.coalesce(max(8, rows // per_task))


def few(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """``df``, a table of at most ``rows`` rows of a few numbers, marked for broadcast if that is below the limit."""
    return F.broadcast(df) if rows <= limit else df
