"""Exact duplicates: frequent digests are taken out map-side, the others meet in an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, without
from tidewatch.session import materialise


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the digest (SHA-256) stands for the text. Of each group the row
    with the smallest id stays. A null id comes after all others. Among repeated rows (same id, same text) one stays.
    A null text counts as the empty text, an empty table gives an empty result, other columns are ignored.

    1. Only (id, digest, row number) leave the first pass, written once to the shared folder.
    2. ``freqItems`` is the counter scheme of Misra and Gries: at most 1 / support counters a task, and no digest above
       that share of the rows can be missed. Its candidates are counted exactly, and those that hold the share win.
    3. Winners (at most 1 / support rows) are broadcast: their rows are answered where they are read.
    4. No other digest has more than that share of rows, so a window over the digest is safe.
    """
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.sha2(normalised(F.col(text_col)), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    found = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    least = support * rows.count()
    winners = (
        rows.join(F.broadcast(found), "digest", "left_semi")
        .groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= least)
    )
    winners = materialise(winners, "frequent")
    heavy = rows.join(F.broadcast(winners), "digest")
    whole = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", "row", first.over(whole).alias("first"), F.count(F.lit(1)).over(whole).alias("group_size")
    )
    both = heavy.select(*light.columns).unionByName(light)
    return both.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows (same id and text) one."""
    marks = mark_copies(docs, id_col, text_col, support).filter("kept")
    marks = marks.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__digest"))
    keyed = docs.withColumn("__key", F.sha2(normalised(F.col(text_col)), 256))
    kept = keyed.join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest")), "left_semi")
    return without(kept.dropDuplicates([id_col, "__key"]), ["__key"])
