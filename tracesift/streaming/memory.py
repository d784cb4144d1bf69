"""What a live job remembers between micro-batches, in tables below its output folder, bounded in time.

Decisions lie in folders by the period in which their traces were due, so a late record's lookup reads the few folders of its own
trace's time. Counts of the dynamic samplers are one snapshot a batch: the one before plus the batch's own, without intervals
that have passed out of memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.operators import samplers as S


def children(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder of any file system that Spark can reach; none where it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: So many intervals of a sampler are remembered at least, however long they are.
LEAST_INTERVALS = 64


class Counts:
    """Snapshots of the dynamic samplers' counts, by batch. A repeated batch reads what it read the first time.

    Intervals are forgotten after ``memory_s``, but for the last LEAST_INTERVALS: a moving average has long aged by then."""

    def __init__(self, spark: SparkSession, at: str, memory_s: int):
        self.spark, self.at, self.memory_s = spark, at, memory_s

    def _epochs(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in children(self.spark, self.at) if n.startswith("epoch="))

    def before(self, epoch: int) -> DataFrame:
        last = max((e for e in self._epochs() if e < epoch), default=None)
        if last is None:
            return self.spark.createDataFrame([], S.COUNTS)
        return self.spark.read.schema(S.COUNTS).parquet(f"{self.at}/epoch={last}")

    def add(self, epoch: int, new: DataFrame) -> None:
        """``new``: the batch's own counts. Snapshots older than the one before are deleted."""
        names = ["state", "key", "interval"]
        every = self.before(epoch).unionByName(new).groupBy(*names).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("period").alias("period"))
        newest = every.groupBy("state").agg(F.max("interval").alias("_last"))
        age = F.col("_last") - F.col("interval")
        kept = every.join(newest, "state").where((age * F.col("period") <= self.memory_s) | (age < LEAST_INTERVALS)).drop("_last")
        kept.write.mode("overwrite").parquet(f"{self.at}/epoch={epoch}")
        for old in [e for e in self._epochs() if e < epoch][:-1]:
            delete(self.spark, f"{self.at}/epoch={old}")


class Decisions:
    """Decided traces: trace_id, rate, keep, reason and others, by the period of their due time (``send_by_ms``) and batch."""

    def __init__(self, spark: SparkSession, at: str, period_ms: int):
        self.spark, self.at, self.period_ms = spark, at, period_ms

    def period(self):
        return F.floor(F.col("send_by_ms") / self.period_ms).cast("long")

    def add(self, epoch: int, rows: DataFrame) -> None:
        """A repeated batch overwrites its own files."""
        out = rows.withColumn("due", self.period()).withColumn("epoch", F.lit(epoch))
        out.repartition("due").write.partitionBy("due", "epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.at)

    def of(self, late: DataFrame) -> DataFrame | None:
        """Decisions of the periods in which the late records' traces were due; None where there are none."""
        asked = {r["due"] for r in late.select(self.period().alias("due")).distinct().collect()}  # a few: memory is bounded in time
        there = [d for d in children(self.spark, self.at) if d.startswith("due=") and int(d.split("=")[1]) in asked]
        return self.spark.read.option("basePath", self.at).parquet(*[f"{self.at}/{d}" for d in there]).drop("due", "epoch") if there else None
