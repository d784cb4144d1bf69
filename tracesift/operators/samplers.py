"""Samplers: how many traces of a kind stand for one that is kept.

The dynamic samplers work on a table of traces (sampler state, key, interval, n_descendants). Counts are numbers of records,
not of traces. A key's rate in an interval comes from the counts of what came before; a key not seen there has rate 1.
The allocation formula follows the documented behaviour: each key is kept at least once, and busy keys share the
goal by the logarithm of their counts (average-rate samplers) or evenly (throughput samplers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.functions.hashing import keep_one_in


@dataclass(frozen=True)
class Deterministic:
    """One in ``rate`` by the trace id alone."""

    rate: int = 1
    fields: tuple[str, ...] = ()
    name: str = "deterministic"

    def decide(self, trace_id: Column) -> tuple[Column, Column, Column]:
        """rate, keep, reason"""
        return F.lit(max(self.rate, 1)).cast("long"), keep_one_in(trace_id, self.rate), F.lit("deterministic/always" if self.rate <= 1 else "deterministic/chance")


@dataclass(frozen=True)
class Dynamic:
    """Average sample rate by key over tumbling intervals."""

    goal: int
    fields: tuple[str, ...] = ()
    interval_s: int = 30
    max_keys: int = 500
    length: bool = False
    name: str = "dynamic"


@dataclass(frozen=True)
class EmaDynamic:
    """Average sample rate by key from a moving average of counts."""

    goal: int
    fields: tuple[str, ...] = ()
    interval_s: int = 15
    weight: float = 0.5
    age_out: float | None = None
    burst_multiple: float = 2.0
    burst_delay: int = 3
    max_keys: int = 500
    length: bool = False
    name: str = "emadynamic"


@dataclass(frozen=True)
class EmaThroughput:
    """Records a second as the goal, from a moving average; ``initial`` is the rate before there are counts."""

    goal_per_s: int
    fields: tuple[str, ...] = ()
    interval_s: int = 15
    weight: float = 0.5
    age_out: float | None = None
    initial: int = 10
    max_keys: int = 500
    peers: int = 1
    length: bool = False
    name: str = "emathroughput"


@dataclass(frozen=True)
class WindowedThroughput:
    """Records a second as the goal, from a look-back window that moves by ``update_s``."""

    goal_per_s: int
    fields: tuple[str, ...] = ()
    update_s: int = 1
    lookback_s: int | None = None
    max_keys: int = 500
    peers: int = 1
    length: bool = False
    name: str = "windowedthroughput"

    @property
    def steps(self) -> int:
        """Look-back in updates; a whole number of them, by default 30."""
        return max(1, (self.lookback_s or 30 * self.update_s) // self.update_s)


@dataclass(frozen=True)
class TotalThroughput:
    """Records a second as the goal, from the interval before."""

    goal_per_s: int
    fields: tuple[str, ...] = ()
    interval_s: int = 30
    max_keys: int = 500
    peers: int = 1
    length: bool = False
    name: str = "totalthroughput"


def cluster_goal(goal: int, peers: int) -> int:
    """A goal shared by the cluster's peers, at least 1 each."""
    return max(goal // max(peers, 1), 1)


def state_key(prefix: str, sampler) -> str:
    """Samplers of one prefix, kind, goal and sorted fields share their state."""
    goal = getattr(sampler, "goal", None) or getattr(sampler, "goal_per_s", None) or sampler.rate
    return ":".join([prefix, sampler.name, str(goal), *sorted(sampler.fields)])


def interval_of(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds).cast("long")


def admitted(counts: DataFrame, max_keys: int) -> DataFrame:
    """The first ``max_keys`` keys of a state and interval by first arrival (column ``first``); later ones aren't tracked."""
    order = Window.partitionBy("state", "interval").orderBy("first", "key")
    return counts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_keys).drop("_n")


COUNTS = "state string, key string, interval long, n long, first timestamp, period int"


def own_counts(traces: DataFrame, seconds: int) -> DataFrame:
    """COUNTS of traces (state, key, ts, n_descendants): records by key and interval, and the first arrival."""
    return traces.groupBy("state", "key", interval_of(F.col("ts"), seconds).alias("interval")).agg(F.sum("n_descendants").alias("n"), F.min("ts").alias("first"))


def key_counts(traces: DataFrame, seconds: int, max_keys: int, history: DataFrame | None = None) -> DataFrame:
    """COUNTS for traces, with those of earlier ones (``history``), of the keys that are tracked."""
    counts = own_counts(traces, seconds)
    if history is not None:
        counts = counts.unionByName(history.select(counts.columns)).groupBy("state", "key", "interval").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return admitted(counts, max_keys)


def period_of(s) -> int:
    """Seconds by which a dynamic sampler counts."""
    return s.update_s if isinstance(s, WindowedThroughput) else s.interval_s


def allocate(counts: DataFrame, total_goal: Column, by_log: bool) -> DataFrame:
    """Adds ``rate``: the count over the key's share of ``total_goal`` (an expression over n_total), rounded up, at least 1."""
    group = Window.partitionBy("state", "interval")
    c = counts.withColumn("n_total", F.sum("n").over(group))
    if by_log:
        weight = F.log10(F.greatest(F.col("n").cast("double"), F.lit(1.0)) + 1e-9)
        c = c.withColumn("_w", F.greatest(weight, F.lit(0.0)))
        share = F.when(F.sum("_w").over(group) > 0, F.col("_w") / F.sum("_w").over(group)).otherwise(0.0)
    else:
        share = F.lit(1.0) / F.count("*").over(group)
    mine = F.greatest(F.lit(1.0), share * total_goal)
    return c.withColumn("rate", F.greatest(F.lit(1), F.ceil(F.round(F.col("n") / mine, 9))).cast("long")).drop("_w")


def tumbling_rates(traces: DataFrame, s: Dynamic | TotalThroughput, history: DataFrame | None = None) -> DataFrame:
    """state, key, interval (in which the rate applies), rate: from the counts of the interval before."""
    counts = key_counts(traces, s.interval_s, s.max_keys, history)
    if isinstance(s, Dynamic):
        rated = allocate(counts, F.col("n_total") / F.lit(float(s.goal)), True)
    else:
        rated = allocate(counts, F.lit(float(cluster_goal(s.goal_per_s, s.peers) * s.interval_s)), False)
    return rated.select("state", "key", (F.col("interval") + 1).alias("interval"), "rate")


def windowed_rates(traces: DataFrame, s: WindowedThroughput, history: DataFrame | None = None) -> DataFrame:
    """As ``tumbling_rates``, from the sum over the look-back's updates before. Of a look-back's keys the first to arrive are tracked.

    A count is in the sums of the ``steps`` updates after it. Those sums change only where a count enters or leaves, so
    they are running sums of such changes, and each holds for the updates until the next change."""
    counts = key_counts(traces, s.update_s, 1 << 31, history)
    moves = counts.select("state", "key", "first", F.explode(F.array(F.struct((F.col("interval") + 1).alias("interval"), F.col("n").alias("d")), F.struct((F.col("interval") + 1 + s.steps).alias("interval"), (-F.col("n")).alias("d")))).alias("m"))
    moves = moves.groupBy("state", "key", "m.interval").agg(F.sum("m.d").alias("d"), F.min(F.when(F.col("m.d") > 0, F.col("first"))).alias("first"))
    by_time = Window.partitionBy("state", "key").orderBy("interval")
    back = by_time.rangeBetween(-s.steps + 1, Window.currentRow)
    sums = moves.withColumn("n", F.sum("d").over(by_time)).withColumn("until", F.lead("interval").over(by_time)).withColumn("first", F.min("first").over(back)).where("n > 0")
    sums = sums.select("state", "key", F.explode(F.sequence("interval", F.col("until") - 1)).alias("interval"), "n", "first")
    return allocate(admitted(sums, s.max_keys), F.lit(float(cluster_goal(s.goal_per_s, s.peers) * s.steps * s.update_s)), False).select("state", "key", "interval", "rate")


def moving_averages(counts: DataFrame, weight: float, age_out: float | None) -> DataFrame:
    """state, key, interval, ema: after each interval in which the key is still tracked.

    Counts of intervals between a key's first and the state's last are filled with zeros, so each key decays until it falls
    below ``age_out`` (by default the weight) and is forgotten; a later count starts it anew. One fold a key."""
    age = weight if age_out is None else age_out
    last = counts.groupBy("state").agg(F.max("interval").alias("last"))
    keyed = counts.groupBy("state", "key").agg(F.array_sort(F.collect_list(F.struct("interval", F.col("n").cast("double").alias("n")))).alias("c")).join(last, "state")
    start = F.struct(F.lit(0.0).alias("ema"), F.lit(None).cast("long").alias("at"), F.array().cast("array<struct<interval:long,ema:double>>").alias("out"))
    # intervals that a value above ``age`` can still fill: it shrinks by 1 - weight each
    def idle(ema: Column) -> Column:
        return F.when(ema < age, 0).otherwise(F.floor(F.log(F.lit(age) / ema) / F.log(F.lit(1 - weight)) + 1e-12))

    def decay(acc: Column, until: Column) -> Column:
        n = F.least(until - acc["at"] - 1, idle(acc["ema"]))
        return F.when(acc["at"].isNull() | (n < 1), F.array().cast("array<struct<interval:long,ema:double>>")).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), lambda i: F.struct((acc["at"] + i).alias("interval"), (acc["ema"] * F.pow(F.lit(1 - weight), i.cast("double"))).alias("ema"))))

    def step(acc: Column, x: Column) -> Column:
        gap = x["interval"] - acc["at"]
        was = F.when(acc["at"].isNull() | (gap - 1 > idle(acc["ema"])), 0.0).otherwise(acc["ema"] * F.pow(F.lit(1 - weight), (gap - 1).cast("double")))
        now = weight * x["n"] + (1 - weight) * was
        kept = F.when(now >= age, F.array(F.struct(x["interval"].alias("interval"), now.alias("ema")))).otherwise(F.array().cast("array<struct<interval:long,ema:double>>"))
        return F.struct(now.alias("ema"), x["interval"].alias("at"), F.concat(acc["out"], decay(acc, x["interval"]), kept).alias("out"))

    def finish(acc: Column) -> Column:
        return acc

    folded = keyed.withColumn("f", F.aggregate("c", start, step, finish))
    rows = folded.select("state", "key", F.explode(F.concat(F.col("f.out"), decay(F.col("f"), F.col("last") + 1))).alias("x"))
    return rows.select("state", "key", "x.interval", "x.ema")


def ema_rates(traces: DataFrame, s: EmaDynamic | EmaThroughput, history: DataFrame | None = None) -> DataFrame:
    """As ``tumbling_rates``, from the moving averages after the interval before."""
    averages = moving_averages(key_counts(traces, s.interval_s, s.max_keys, history), s.weight, s.age_out).withColumnRenamed("ema", "n")
    goal = F.col("n_total") / F.lit(float(s.goal)) if isinstance(s, EmaDynamic) else F.lit(float(cluster_goal(s.goal_per_s, s.peers) * s.interval_s))
    return allocate(averages, goal, True).select("state", "key", (F.col("interval") + 1).alias("interval"), "rate")


def bursts(traces: DataFrame, s: EmaDynamic) -> DataFrame:
    """state, interval, n, ema, burst: whether an interval's records exceed ``burst_multiple`` times the sum of averages so
    far, after ``burst_delay`` intervals; a negative multiple switches it off."""
    counts = key_counts(traces, s.interval_s, s.max_keys)
    sums = moving_averages(counts, s.weight, s.age_out).groupBy("state", (F.col("interval") + 1).alias("interval")).agg(F.sum("ema").alias("ema"))
    now = counts.groupBy("state", "interval").agg(F.sum("n").alias("n"))
    age = F.col("interval") - F.min("interval").over(Window.partitionBy("state"))
    joined = now.join(sums, ["state", "interval"], "left").withColumn("ema", F.coalesce("ema", F.lit(0.0)))
    hot = (age >= s.burst_delay) & (F.col("n") > F.col("ema") * F.lit(float(s.burst_multiple))) & F.lit(s.burst_multiple >= 0)
    return joined.withColumn("burst", hot)


def rates(traces: DataFrame, s, history: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The rate table of any dynamic sampler, its interval's seconds, and the rate of keys that aren't in it."""
    if isinstance(s, (Dynamic, TotalThroughput)):
        return tumbling_rates(traces, s, history), s.interval_s, 1
    if isinstance(s, WindowedThroughput):
        return windowed_rates(traces, s, history), s.update_s, 1
    return ema_rates(traces, s, history), s.interval_s, 1


def decide(traces: DataFrame, s, salt: str = "dynamic", history: DataFrame | None = None) -> DataFrame:
    """``traces`` (trace_id, state, key, ts, n_descendants and others) plus rate, keep and the sampler's reason.

    ``history``: COUNTS of traces that were decided before, whose intervals and keys go on here. The draw is a salted hash of the
    trace id, so that reruns agree."""
    if history is not None:  # traces' own states only
        history = history.join(traces.select("state").distinct(), "state", "left_semi")
    table, seconds, unseen = rates(traces.select("state", "key", "ts", "n_descendants"), s, history)
    at = traces.withColumn("interval", interval_of(F.col("ts"), seconds))
    out = at.join(table, ["state", "key", "interval"], "left")
    rate = F.coalesce("rate", F.lit(unseen))
    if isinstance(s, EmaThroughput):
        # a row a state, joined instead of a window over all of a state's traces
        known = at.select("state", "interval") if history is None else at.select("state", "interval").union(history.select("state", "interval"))
        out = out.join(known.groupBy("state").agg(F.min("interval").alias("_start")), "state")
        rate = F.when(F.col("interval") == F.col("_start"), F.lit(s.initial)).otherwise(rate)
    out = out.withColumn("rate", rate.cast("long")).drop("interval", "_start")
    return out.withColumn("keep", keep_one_in(F.col("trace_id"), F.col("rate"), salt)).withColumn("sampler_reason", F.lit(s.name))


def stress_keep(trace_id: Column, rate: int) -> Column:
    """Keep under stress: the same choice on every node, independent of the other samplers."""
    return keep_one_in(trace_id, rate, "34527861234")


#: Named samplers; own ones can be added.
REGISTRY = {"deterministic": Deterministic, "dynamic": Dynamic, "emadynamic": EmaDynamic, "emathroughput": EmaThroughput, "windowedthroughput": WindowedThroughput, "totalthroughput": TotalThroughput}

