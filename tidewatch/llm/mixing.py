"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, rank_in, small_side
from tidewatch.session import materialise

#: Rows that a cell of the line has, about.
ROWS_PER_CELL = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(seed: int) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight; no
    target is above ``most`` times its source's size, the excess is shared again by weight. In order of size per weight
    the sources at their limit come first, so the common level of the others is a closed form over running sums.
    The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (place % len(weights)) + 1))
    per = per.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    everyone = Window.partitionBy()
    by_ratio = everyone.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(everyone) - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0)))
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))),
    )
    free = F.col("bound") >= F.col("level") * F.col("weight")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    per = per.withColumn("common", level)
    target = F.when(F.col("common").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("common") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _line(rows: DataFrame, rows_per_cell: int) -> DataFrame:
    """``rows`` (id, h, source, size, ...) with the cell of each: a number that rises along the line by id (null last), then h.

    Ids are cut at quantiles, so a cell has about ``rows_per_cell`` rows of all sources and sizes; an id that is a quantile itself, and
    the rows without id, get cells of their own, which are cut by h. Of equal id and h, more rows than that are dealt over
    several cells; which of these rows comes first makes no difference. Cells only spread the work, the line is the same without.
    """
    cells = 1 + rows.count() // rows_per_cell
    if cells == 1:
        return rows.withColumns({"cell": F.lit(0), "sub": F.lit(0), "dup": F.lit(0)})
    cuts = rows.filter("id is not null").approxQuantile("id", [k / cells for k in range(1, cells)], 0.25 / cells)
    cuts = sorted({int(c) for c in cuts})
    place = F.when(F.col("id").isNull(), 2 * len(cuts) + 1)
    same = F.col("id").isNull()
    if cuts:
        below = rank_in(cuts, F.col("id"))
        held = F.element_at(F.array(*[F.lit(c).cast("long") for c in cuts]), F.least(below + 1, F.lit(len(cuts)))) == F.col("id")
        place = place.otherwise(2 * below + F.coalesce(held, F.lit(False)).cast("int"))
        same = same | held
    else:
        place = place.otherwise(F.lit(0))
    # The leading bits of h keep its order.
    sub = F.when(same, F.shiftright("h", 40).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumns({"cell": place.cast("int"), "sub": sub})
    hot = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > rows_per_cell)
    hot = hot.select(F.col("id").alias("hot_id"), F.col("h").alias("hot_h"), F.ceil(F.col("held") / rows_per_cell).cast("int").alias("parts"))
    rows = rows.join(small_side(materialise(hot, "hot")), F.col("id").eqNullSafe(F.col("hot_id")) & (F.col("h") == F.col("hot_h")), "left")
    dup = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("number"), F.col("parts")).cast("int"))
    return rows.withColumn("dup", dup).drop("hot_id", "hot_h", "parts")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    seed: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, copies.

    Size is the number of words (null text: 0). Each document of a source expects target / source_size copies. Documents
    of a source stand in a line by size, then id (null ids last), then a hash of the text; running sums of the expected copies plus one random
    offset are taken, and a document gets a copy for each integer that its step crosses. As neighbours are of
    similar size, the words taken differ from the target by about one large document. No document is taken more
    than ``most`` times (rounded up). Ties and repeated rows stand next to each other and are counted each.
    A source without any word has target 0 and gives no copies. An empty table gives an empty result.

    A place in the line is: rows of smaller size in the source + rows of earlier cells of the same size + place in
    the cell (see ``_line``), so that a third of all rows may have one source and size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    return _planned(rows, weights, most, seed, rows_per_cell).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies"
    )


def _planned(rows: DataFrame, weights: Sequence[float], most: float, seed: int, rows_per_cell: int) -> DataFrame:
    kept = [c for c in rows.columns if c != "text"]
    rows = materialise(rows.select(*kept, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), words(F.col("text")).alias("size")), "lengths")
    rows = _line(rows, rows_per_cell)
    spot = ["cell", "sub", "dup"]
    cells = rows.groupBy("source", "size", *spot).agg(F.count(F.lit(1)).alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy(*spot).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("smaller", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    totals = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    totals = totals.withColumnRenamed("source", "t")
    sizes = sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), "smaller")
    sizes = sizes.join(totals, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    starts = cells.join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(
        "s", "z", F.col("cell").alias("c"), F.col("sub").alias("b"), F.col("dup").alias("k"),
        (F.col("before") + F.col("smaller")).alias("start"), "source_size", "target",
    )
    line = Window.partitionBy("source", "size", *spot).orderBy(F.col("id").asc_nulls_last(), "h")
    rows = rows.withColumn("place", F.row_number().over(line))
    rows = rows.join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("b")) & (F.col("dup") == F.col("k"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("start") + F.col("place")
    u = F.lit(offset(seed))
    copies = F.floor(at * rate + u) - F.floor((at - 1) * rate + u)
    return rows.select(*kept, "size", "source_size", "target", F.least(copies, F.ceil(F.lit(float(most)))).alias("copies"))


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 4, rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it was drawn (not at all, once, or several times); see ``plan_mix``.

    Rows are numbered once, in a written table, and the draw is carried by that number: rows without an id, or that share one, are drawn
    each for themselves. All columns are kept as they are.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = materialise(docs.select(whole.alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    slim = rows.select("number", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.col(f"row.`{source_col}`").alias("source"), F.col(f"row.`{text_col}`").alias("text"))
    plan = _planned(slim, weights, most, seed, rows_per_cell).filter("copies > 0").select("number", F.col("copies").cast("int").alias("copies"))
    plan = materialise(plan, "drawn")
    out = rows.join(small_side(plan), "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")
