"""Shards of near equal bytes by sampled splitters over a hashed text key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import rank_in, without
from tidewatch.session import materialise

SIZE, KEY = "bytes", "key"
FULL = 2.0  # a range is overfull from this many times the aimed size


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, bytes, key, and all columns as one, so that none of theirs meets one of ours."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias(SIZE), F.xxhash64(text).alias(KEY), row.alias("row"))


def splitters(rows: DataFrame, total: int, ranges: int, samples: int, seed: int) -> list[int]:
    """At most ``ranges`` - 1 keys that cut the rows into ranges of about equal bytes.

    Each row is drawn with probability samples * bytes / total, by a hash of its key and id, so reruns draw the same.
    A drawn row weighs total / samples, or its own bytes if it is larger. The sample is bounded by twice ``samples``.
    """
    step = total / samples
    draw = (F.xxhash64(F.lit(seed), KEY, "id").bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    sample = rows.filter(draw * step < F.col(SIZE)).groupBy(KEY).agg(F.sum(F.greatest(F.col(SIZE), F.lit(step))).alias("w"))
    whole = Window.partitionBy()
    upto = whole.orderBy(KEY).rowsBetween(Window.unboundedPreceding, 0)
    cum = sample.select(KEY, "w", F.sum("w").over(upto).alias("cum"), F.sum("w").over(whole).alias("all"))
    cell = lambda x: F.floor(x * ranges / F.col("all"))
    cuts = cum.filter(cell(F.col("cum")) > cell(F.col("cum") - F.col("w"))).select(KEY).collect()
    return sorted(r[0] for r in cuts)[: ranges - 1]


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = 64 << 20,
    per_shard: int = 64,
    samples_per_range: int = 32,
    max_ranges: int = 65_536,
    seed: int = 20,
) -> DataFrame:
    """``docs`` with two more columns: shard (0 .. shards - 1) and slot (0, 1, ... without gaps in each shard).

    Shards have near equal bytes (UTF-8 bytes of the text plus 1; a null text has none). Rows are ordered by a hash of
    the text, then id, so equal texts stay together except where their group alone is overfull. The key space is cut
    into small ranges at quantiles of a size-weighted sample; the exact bytes of each range are then counted. A text that
    overfills its range by itself is dealt out by id, any other overfull range is cut at evenly spaced keys. The pieces,
    in key order, are packed into shards by their exact bytes: a shard is off by at most about one piece.

    Nulls in any column are kept. Repeated rows get slots of their own. An empty table gives an empty result. Columns
    named shard or slot are replaced. On the driver: one number or two for each range and piece, bounded by
    ``max_ranges``. Rows move once, to their piece; no task holds more than a piece.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    docs = without(docs, ["shard", "slot"])
    slim = materialise(_sized(docs, id_col, text_col).select("id", KEY, SIZE), "sizes")
    total = slim.agg(F.sum(SIZE)).first()[0] or 0
    if not total:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = min(max_ranges, max(per_shard * shards, math.ceil(total / range_bytes)))
    aim = total / ranges
    cuts = splitters(slim, total, ranges, ranges * samples_per_range, seed)
    of_range = rank_in(cuts, F.col(KEY))

    stats = {r[0]: r[1] for r in slim.groupBy(of_range.alias("r")).agg(F.sum(SIZE)).collect()}
    over = [r for r, b in stats.items() if b > FULL * aim]
    hot: dict[int, int] = {}
    if over:
        by_text = slim.withColumn("__r", of_range).filter(F.col("__r").isin(over)).groupBy("__r", KEY).agg(F.sum(SIZE).alias("b"))
        for r, key, b in by_text.filter(F.col("b") > aim).collect():  # at most one for each aimed size
            hot[key] = math.ceil(b / aim)
            stats[r] -= b
    edges = [-(1 << 63), *cuts, (1 << 63) - 1]
    wide = {r: math.ceil(stats[r] / aim) for r in over if stats[r] > FULL * aim}

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumns({"__r": of_range, "__piece": F.lit(0)})
        if wide:
            rows = [(r, float(edges[r]), float(edges[r + 1]) - float(edges[r]), k) for r, k in wide.items()]
            df = df.join(F.broadcast(spark.createDataFrame(rows, "__r int, __lo double, __width double, __k int")), "__r", "left")
            cell = F.floor((F.col(KEY).cast("double") - F.col("__lo")) / F.col("__width") * F.col("__k"))
            cell = F.greatest(F.lit(0), F.least(cell, F.col("__k") - 1))
            df = without(df.withColumn("__piece", F.coalesce(cell.cast("int"), F.lit(0))), ["__lo", "__width", "__k"])
        if hot:
            df = df.join(F.broadcast(spark.createDataFrame(list(hot.items()), f"{KEY} long, __n int")), KEY, "left")
            dealt = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("__n")).cast("int")
            piece = F.when(F.col("__n").isNull(), F.col("__piece")).otherwise(
                F.pmod(F.xxhash64(KEY), F.lit(1 << 20)).cast("int") * 1024 + (1 << 20) + dealt
            )
            df = without(df.withColumn("__piece", piece), ["__n"])
        return df

    pieces = placed(slim).groupBy("__r", "__piece").agg(F.sum(SIZE), F.count(F.lit(1))).collect()
    plan, before, filled = [], 0, [0] * shards
    for r, piece, b, n in sorted(map(tuple, pieces)):
        shard = min(shards - 1, int((before + b / 2) * shards / total))
        plan.append((r, piece, shard, filled[shard]))
        before, filled[shard] = before + b, filled[shard] + n
    targets = spark.createDataFrame(plan, "__r int, __piece int, shard int, __from long")
    inside = Window.partitionBy("__r", "__piece").orderBy(KEY, F.col("id").asc_nulls_last())
    out = placed(_sized(docs, id_col, text_col)).withColumn("__n", F.row_number().over(inside))
    out = out.join(F.broadcast(targets), ["__r", "__piece"]).withColumn("slot", F.col("__from") + F.col("__n") - 1)
    return out.select("row.*", "shard", "slot")
