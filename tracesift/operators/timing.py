"""When traces are decided, and why: a replay over arrival times.

A trace is sent at the earliest of: first arrival plus the timeout, first root's arrival plus the delay, and the arrival of the
record after the limit. Records that arrive later are late and follow the decision made then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.sources.spans import Spans

GOT_ROOT, LIMIT, EXPIRED, EJECTED, LATE = "trace_send_got_root", "trace_send_span_limit", "trace_send_expired", "trace_send_ejected_memsize", "trace_send_late_span"
LATE_REASON = "late arriving span"


@dataclass(frozen=True)
class Timing:
    """Seconds, and a number of records (0: no limit). Zero times mean the defaults."""

    timeout_s: int = 60
    delay_s: int = 2
    limit: int = 32000

    def timeout(self) -> int:
        return self.timeout_s or 60

    def delay(self) -> int:
        return self.delay_s or 2


def _after(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL {seconds} SECOND")


def timed(spans: Spans, t: Timing) -> DataFrame:
    """All spans (column ``ts``: arrival) with send_by and ``late``. One exchange by trace id."""
    trace = Window.partitionBy("trace_id")
    parts = [_after(F.min("ts").over(trace), t.timeout()), _after(F.min(F.when(F.col("is_root"), F.col("ts"))).over(trace), t.delay())]
    df = spans.df
    if t.limit:
        df = df.withColumn("_n", F.row_number().over(trace.orderBy("arrival")))
        parts.append(F.min(F.when(F.col("_n") == t.limit + 1, F.col("ts"))).over(trace))
    df = df.withColumn("send_by", F.least(*parts))
    return df.drop("_n").withColumn("late", F.col("ts") > F.col("send_by"))


def sent(spans: Spans, t: Timing) -> DataFrame:
    """One row a trace: trace_id, send_by, n_on_time, n_late, has_root (on time), send_reason."""
    on_time = ~F.col("late")
    rows = timed(spans, t).groupBy("trace_id").agg(F.min("send_by").alias("send_by"), F.count_if(on_time).alias("n_on_time"), F.count_if("late").alias("n_late"), F.bool_or(F.col("is_root") & on_time).alias("has_root"))
    return rows.withColumn("send_reason", send_reason(t))


def send_reason(t: Timing) -> Column:
    """A root comes first, even where the limit was exceeded."""
    return F.when(F.col("has_root"), GOT_ROOT).when(F.lit(bool(t.limit)) & (F.col("n_on_time") > t.limit), LIMIT).otherwise(EXPIRED)


def expired(traces: DataFrame, now: Column, most: int) -> DataFrame:
    """Traces due at ``now``, the earliest first, at most ``most`` of them in one scan."""
    return traces.where(F.col("send_by") <= now).orderBy("send_by", "trace_id").limit(most)


def late_spans(spans: Spans, t: Timing, decide) -> DataFrame:
    """Late records with the decision of their trace: late records of dropped traces have keep false.

    ``decide``: from the on-time spans to decisions (trace_id, rate, keep, reason). Roots carry running counts of their trace
    at their arrival; so do other late records, in the same columns."""
    rows = timed(spans, t)
    decisions = decide(Spans(rows.where("NOT late").drop("send_by", "late"))).select("trace_id", "rate", "keep", "reason")
    upto = Window.partitionBy("trace_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumns({"n_seen": F.count("*").over(upto), "n_seen_events": F.count_if(F.col("annotation") == "span_event").over(upto), "n_seen_links": F.count_if(F.col("annotation") == "link").over(upto)})
    out = counted.where("late").join(decisions, "trace_id")
    reason = F.when(F.col("reason") != "", F.concat("reason", F.lit(f" - {LATE_REASON}"))).otherwise(LATE_REASON)
    return out.withColumn("reason", reason).withColumn("send_reason", F.lit(LATE))


def as_of_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records (trace_id, ts) with the latest decision (trace_id, ts, keep) at or before them: an as-of join by union and carry."""
    both = records.select("trace_id", "ts", F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("keep"), F.struct(*records.columns).alias("_row"))
    known = decisions.select("trace_id", "ts", F.lit(0).alias("_side"), "keep", F.lit(None).cast(both.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("trace_id").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.union(known).withColumn("keep", F.last("keep", True).over(w)).where("_side = 1").select("_row.*", "keep")


def impacts(spans: Spans, size: Column, now: Column, timeout_s: int) -> DataFrame:
    """trace_id, bytes, impact: each record weighs its size times one plus four times its age in timeouts, cut to an integer."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts"))).cast("long")
    weight = F.expr("CAST(1 AS BIGINT)") + F.floor(age * 4 / F.lit(timeout_s * 1_000_000)).cast("long")
    rows = spans.df.where(F.col("ts") <= now).withColumn("_size", size)
    return rows.groupBy("trace_id").agg(F.sum("_size").alias("bytes"), F.sum(weight * F.col("_size")).alias("impact"))


def evicted(traces: DataFrame, target: int, buckets: int = 64) -> DataFrame:
    """Heaviest traces first until more than ``target`` bytes are sent: trace_id, bytes, impact, before.

    The prefix sum runs in two steps, over ranges of impact and within one. Ranges lie between quantiles, so they hold about
    as many traces each, however the impacts are spread; only traces of one and the same impact can't be parted."""
    steps = traces.agg(F.percentile_approx("impact", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(steps))]).cast("array<long>")
    ranged = traces.withColumn("_b", F.size(F.filter(edges, lambda x: x <= F.col("impact"))))
    sums = ranged.groupBy("_b").agg(F.sum("bytes").alias("_s"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_b").orderBy(F.desc("impact"), "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("before", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(sums, "_b").withColumn("before", F.col("before") + F.col("_start"))
    return out.where(F.col("before") <= target).drop("_b", "_start")


def ratio(n: Column, d: Column) -> Column:
    """Between 0 and 1; 0 where either is missing or the denominator is 0."""
    return F.coalesce(F.when(d != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / d))), F.lit(0.0))


#: Fixed value: the curve's scale.
SIGMOID_SCALE = 0.400305589


def stress(algorithm: str, n: Column, d: Column) -> Column:
    """A level between 0 and 100."""
    r = ratio(n, d)
    f = {"linear": r, "sqrt": F.sqrt(r), "square": r * r, "sigmoid": F.lit(SIGMOID_SCALE) * F.atan(F.lit(6.0) * (r - 0.5)) + 0.5}[algorithm]
    return f * 100


def stress_level(queue: Column, peer_queue: Column, capacity: Column, memory: Column, most_memory: Column) -> Column:
    """The highest of the queues' and the memory's levels, cut to an integer."""
    return F.floor(F.greatest(stress("sqrt", peer_queue, capacity), stress("sqrt", queue, capacity), stress("sigmoid", memory, most_memory))).cast("long")


def cluster_level(level: Column) -> Column:
    """Aggregate over peers: root mean square of the non-zero levels, cut to an integer; 0 without any."""
    live = F.when(level > 0, level)
    return F.coalesce(F.floor(F.sqrt(F.sum(live * live) / F.count(live))), F.lit(0)).cast("long")


def stress_states(samples: DataFrame, on: int = 90, off: int = 75, least_s: int = 10, mode: str = "monitor") -> DataFrame:
    """node, at, level, stressed: the activation state after each sample (node, at, level), in time order by node.

    On at ``on`` or above; off below ``off``, once ``least_s`` seconds have passed since the level last was ``off`` or above."""
    if mode != "monitor":
        return samples.select("node", "at", "level", F.lit(mode == "always").alias("stressed"))
    start = F.struct(F.lit(False).alias("on"), F.lit(None).cast("double").alias("until"), F.array().cast("array<struct<at:timestamp,level:long,stressed:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = F.unix_micros(x["at"]) / 1e6
        active = acc["on"] | (x["level"] >= on)
        until = F.when(active & (x["level"] >= off), now + least_s).otherwise(acc["until"])
        stays = active & ~((x["level"] < off) & (now > F.coalesce(until, F.lit(float("-inf")))))
        return F.struct(stays.alias("on"), until.cast("double").alias("until"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), x["level"].alias("level"), stays.alias("stressed")))).alias("out"))

    folded = samples.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", F.col("level").cast("long").alias("level")))).alias("s"))
    return folded.select("node", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("x")).select("node", "x.*")
