"""Connected components of a table of links, by repeated contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import few, sized
from tidewatch.session import Workspace, materialise


def components(links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b: long) the smallest node it is connected with.

    In turn, every node ties its larger neighbours, then its smaller ones, to the smallest of its neighbourhood, until
    nothing changes. That takes a number of rounds logarithmic in the nodes; the table never has more rows
    than nodes and links. Minima are combined before the shuffle, joins with them need no shuffle while they are counted to be few, and joins on a hub are split by the optimiser, and each
    round is written to the workspace, in a number of parts that follows its rows, and removed after the next. Links of a node
    with itself and repeated links are allowed.
    """
    if work is None:
        with Workspace(links.sparkSession, "components") as own:
            return materialise(components(links, own), "components")
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = work.write(edges, "links")
    rows, mark = edges.count(), None
    while rows:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(few(low, 2 * rows), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = work.write(sized(large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))), rows), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(low, 2 * rows), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, work.write(sized(small, rows), "small")
        work.drop(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        rows, mark = now[0], now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = work.write(sized(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()), rows), "stars")
    work.drop(edges)
    return out
