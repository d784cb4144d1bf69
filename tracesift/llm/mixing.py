"""Mixing sources to target weights, wholly in DataFrame functions.

Every document gets a hash-random key. Within a source the key order is cut into ranges by the key's first digits, as many
digits as keep ranges at about RANGE_ROWS rows, so the prefix sum of sizes is two small steps: a running sum over ranges
and a running sum inside one range. A source that holds most rows is thereby spread over many groups.
The mix takes each source's documents in key order up to its exact budget, starting again for a second epoch where
the budget exceeds the source. Sources themselves may be many (hosts, say): their ranks and levels are found without
gathering them in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.scratch import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point order of ``source``, null last: sorted by range, then counted range by range."""
    part = F.spark_partition_id().alias("part")
    rows = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("*", part))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("start"))
    return rows.withColumn("rank", within).join(F.broadcast(starts), "part").withColumn("rank", F.col("rank") + F.col("start")).drop("part", "start")


def allocate(sources: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (columns ``source``, ``source_size``).

    Weights go to sources in code point order, null last, repeating. Together they get ``share`` times the sum of all
    sizes; none gets more than ``most`` times its size, the excess being reshared by weight: the common level (target a weight)
    rises round by round until no further source reaches its cap. A round is one sum over the sources."""
    rows = ranked(sources).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = cut(rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    total, level, full = (rows.agg(F.sum("source_size")).first()[0] or 0) * share, float("-inf"), -1
    while True:
        below = F.col("cap") / F.col("w") <= F.lit(level)
        x = rows.agg(F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)).alias("cap"), F.sum(F.when(~below, F.col("w"))).alias("w"), F.count_if(below).alias("n")).first()
        if x["n"] == full or not x["w"]:
            break
        full, level = x["n"], (total - x["cap"]) / x["w"]
    return rows.select("source", "source_size", F.when(F.col("cap") / F.col("w") <= F.lit(level), F.col("cap")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def take(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """``docs`` needs doc_id, text, source. Returns a row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Null or empty texts have size 0 and take 0; a null source is a source of its own; an empty table gives no rows;
    equal rows are told apart only by the order in which the cut meets them; other columns are not read."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))))
    digits = max(1, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16)) + 1)
    sized = cut(sized.withColumn("part", F.substring("key", 1, digits)))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = allocate(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.source", "part", "part_start", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = sized.alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source AND d.part = p.part"))
    out = out.select("doc_id", "d.source", "size", "source_size", "target", (F.col("part_start") + F.col("before")).alias("before"), F.round("target").cast("long").alias("budget"))
    epochs = F.expr("CASE WHEN source_size > 0 THEN budget DIV source_size ELSE 0 END")
    rest = F.expr("CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def materialise(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``, whatever their names.

    A document that the cut splits comes once more if at least half of it is taken, so that texts stay whole.
    Rows without words are kept once: they cost nothing of any budget. Equal rows share what they take evenly. An empty table
    stays empty."""
    names = docs.columns
    mark, n, size, of, at, again = fresh(docs, "_mark", "_n", "_size", "_of", "_at", "_again")
    taken = take(docs, **how)
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)))
    key = lambda words: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), words)
    taken = taken.select(key("size").alias(mark), whole.cast("long").alias(n)).groupBy(mark).agg(F.sum(n).alias(n))
    marked = docs.withColumn(size, word_count(F.col("text"))).withColumn(mark, key(size))
    place = Window.partitionBy(mark).orderBy(F.xxhash64("text"))
    marked = marked.withColumn(of, F.count("*").over(Window.partitionBy(mark))).withColumn(at, F.row_number().over(place))
    copies = F.expr(f"CAST({n} DIV {of} + IF({at} <= {n} % {of}, 1, 0) AS INT)")
    out = marked.join(taken, mark).withColumn(again, copies).where(f"{again} > 0")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(again)))).select(*[F.col(f"`{c}`") for c in names])
