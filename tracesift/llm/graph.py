"""Connected components by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.blocks import spread_join
from tracesift.llm.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two integer columns ``a`` and ``b``, in any order, repeats and loops allowed.

    Returns ``id, component`` for each id with an edge to another id; component is the smallest id reachable. Edges
    with a null end are ignored, and an empty table gives no rows. Each step is a minimum by node (combined before the shuffle) and an
    equi-join that broadcasts the minima of hubs, so a hub's neighbours are never gathered, whatever the table's size.
    Both are stored before they meet: a join plans its sides several times, and steps within steps would multiply."""
    now = cut(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b AND a IS NOT NULL AND b IS NOT NULL").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(spread_join(both, low, ["u"], "n", 2 * mark[0]).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        low = cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low, ["b"], "n", 2 * mark[0]).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = cut(small.union(low.select(F.col("m").alias("a"), "b")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
