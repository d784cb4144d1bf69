"""Where records go: shards, workers, batches; and small table operations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.functions.hashing import bits32

PARTITIONS = 50


def shard(trace_id: Column, peers: list[str]) -> Column:
    """The peer that owns a trace: of all peers' partitions, the one with the highest hash with the trace id.

    The partitions are constants of the plan, at least PARTITIONS of them, so this is an expression and no join."""
    ordered = sorted(peers)
    each = PARTITIONS // len(ordered) + 1
    scores = [F.struct(bits32(F.concat(trace_id, F.lit(f"/{p}/{i}"))).alias("h"), F.lit(p).alias("p")) for p in ordered for i in range(each)]
    return F.greatest(*scores)["p"]


def worker(trace_id: Column, workers: int) -> Column:
    return (bits32(trace_id) % workers).cast("int")


def batches(events: DataFrame, most: int, timeout_s: int) -> DataFrame:
    """Adds ``slot`` and ``batch``: events of one destination that arrive within one timeout, cut at ``most`` events.

    Events have destination, ts and arrival. Slots of time keep a busy destination's groups small."""
    slotted = events.withColumn("slot", F.floor(F.unix_timestamp("ts") / timeout_s).cast("long"))
    order = Window.partitionBy("destination", "slot").orderBy("arrival")
    return slotted.withColumn("batch", F.floor((F.row_number().over(order) - 1) / most).cast("long"))


def size_limited(batched: DataFrame, max_event: int = 1_000_000, max_batch: int = 5_000_000, header: int = 5) -> DataFrame:
    """Adds ``part`` (null: the event is too large and is left out): batches cut where their bytes exceed ``max_batch``.

    One fold a batch, whose length the batching bounds. Rows need destination, slot, batch, arrival and size."""
    rows = F.array_sort(F.collect_list(F.struct("arrival", "size", "id")))
    start = F.struct(F.lit(header).cast("long").alias("bytes"), F.lit(0).alias("part"), F.array().cast("array<struct<id:bigint,part:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        skip = x["size"] > max_event
        new = (acc["bytes"] + x["size"] > max_batch) & ~skip
        part = acc["part"] + F.when(new, 1).otherwise(0)
        total = F.when(skip, acc["bytes"]).when(new, F.lit(header) + x["size"]).otherwise(acc["bytes"] + x["size"])
        return F.struct(total.cast("long").alias("bytes"), part.alias("part"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), F.when(~skip, part).alias("part")))).alias("out"))

    folded = batched.groupBy("destination", "slot", "batch").agg(rows.alias("_rows"))
    return folded.select("destination", "slot", "batch", F.explode(F.aggregate("_rows", start, step, lambda a: a["out"])).alias("x")).select("destination", "slot", "batch", "x.id", "x.part")


def usage_deltas(snapshots: DataFrame) -> DataFrame:
    """signal, at, delta: what each cumulative snapshot (signal, at, total) adds; zero totals are no data."""
    order = Window.partitionBy("signal").orderBy("at")
    rows = snapshots.where("total <> 0")
    return rows.select("signal", "at", (F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(0))).cast("long").alias("delta"))


def set_operation(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Union, intersection or difference of distinct rows."""
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "difference": lambda: a.subtract(b)}[kind]()


def parallel_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: Callable[[pd.DataFrame], pd.Series] | None = None, cleanup: Callable[[], None] | None = None) -> DataFrame:
    """``f`` on batches of rows in parallel, then an optional row predicate; ``cleanup`` runs once a task ends."""

    def run(batches_):
        try:
            for pdf in batches_:
                out = f(pdf)
                yield out if keep is None else out[keep(out)]
        finally:
            if cleanup is not None:
                cleanup()

    return df.mapInPandas(run, schema)


def response_accounting(events: DataFrame, responses: DataFrame) -> DataFrame:
    """Each sent event's status: its own response's if the batch got a 200, else the batch's; a missing one is 500.

    ``events``: batch, position, and the batch's ``status``; ``responses``: batch, position, status."""
    own = responses.select("batch", "position", F.col("status").alias("_own"))
    return events.join(own, ["batch", "position"], "left").withColumn("status", F.when(F.col("status") == 200, F.coalesce("_own", F.lit(500))).otherwise(F.col("status"))).drop("_own")
