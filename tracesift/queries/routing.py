"""Shards, batches, usage, sets, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.operators import routing as R
from tracesift.sources.spans import EVENTS, LINES, event_spans, line_spans

PEERS = ["http://node-a:8081", "http://node-b:8081", "http://node-c:8081"]


def _events(spark, sf_dir):
    s = event_spans(spark, sf_dir).df
    return s.select("event_id", F.col("type").alias("destination"), "ts", "arrival", (F.octet_length("props") * 1000).cast("long").alias("size"), F.col("event_id").alias("id"))


def _users(spark, sf_dir, kind):
    return event_spans(spark, sf_dir).df.where(F.col("type") == kind).select("user")


def _set(kind):
    return lambda spark, sf_dir: R.set_operation(_users(spark, sf_dir, "purchase"), _users(spark, sf_dir, "error"), kind)


def _usage(spark, sf_dir):
    daily = event_spans(spark, sf_dir).df.groupBy(F.col("type").alias("signal"), F.date_format("ts", "yyyy-MM-dd").alias("at")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    totals = daily.withColumn("total", F.sum("n").over(Window.partitionBy("signal").orderBy("at")))
    return R.usage_deltas(totals.select("signal", "at", "total"))


def _parallel(spark, sf_dir):
    s = event_spans(spark, sf_dir).df.select("event_id", "value")
    return R.parallel_map(s, lambda pdf: pdf.assign(half=pdf["value"] / 2), T.StructType([*s.schema.fields, T.StructField("half", T.DoubleType())]), lambda out: out["half"] > 10)


def _responses(spark, sf_dir):
    b = R.batches(_events(spark, sf_dir), 5, 86400).select("event_id", F.concat_ws("/", "destination", "slot", "batch").alias("batch"), (F.col("event_id") % 5).alias("position"))
    sent = b.withColumn("status", F.when(F.substring(F.md5("batch"), 1, 1) == "0", 503).otherwise(200))
    own = b.where("event_id % 7 <> 0").select("batch", "position", F.when(F.col("event_id") % 11 == 0, 400).otherwise(202).alias("status")).groupBy("batch", "position").agg(F.max("status").alias("status"))
    return R.response_accounting(sent, own).select("event_id", "status")


_SLOT = f"WITH {EVENTS}, b AS (SELECT event_id, type AS destination, CAST(floor(epoch(ts) / {{0}}) AS BIGINT) AS slot, CAST((row_number() OVER (PARTITION BY type, floor(epoch(ts) / {{0}}) ORDER BY arrival) - 1) // {{1}} AS BIGINT) AS batch, arrival, strlen(props) * 1000 AS size FROM e)"
_EACH = 50 // len(PEERS) + 1
_U = f"WITH {EVENTS}, p AS (SELECT DISTINCT \"user\" FROM e WHERE type = 'purchase'), q AS (SELECT DISTINCT \"user\" FROM e WHERE type = 'error') SELECT \"user\" FROM p {{}} SELECT \"user\" FROM q"

QUERIES = {
    "shard_rendezvous": (
        lambda spark, sf_dir: line_spans(spark, sf_dir).df.select("trace_id").distinct().select("trace_id", R.shard(F.col("trace_id"), PEERS).alias("peer")),
        f"WITH {LINES}, k AS (SELECT p || '/' || i AS k, p FROM (SELECT unnest({PEERS!r}) AS p), range({_EACH}) r(i)), t AS (SELECT DISTINCT trace_id FROM l) SELECT trace_id, arg_max(p, [CAST('0x' || substr(sha1(trace_id || '/' || k), 1, 8) AS BIGINT)]) AS peer FROM t, k GROUP BY trace_id",
    ),
    "worker_hash": (
        lambda spark, sf_dir: line_spans(spark, sf_dir).df.select("trace_id").distinct().groupBy(R.worker(F.col("trace_id"), 16).alias("worker")).agg(F.count("*").alias("n")),
        f"WITH {LINES} SELECT CAST(CAST('0x' || substr(sha1(trace_id), 1, 8) AS BIGINT) % 16 AS INTEGER) AS worker, count(*) AS n FROM (SELECT DISTINCT trace_id FROM l) GROUP BY ALL",
    ),
    "batch_pack": (lambda spark, sf_dir: R.batches(_events(spark, sf_dir), 20, 86400).select("event_id", "destination", "slot", "batch"), _SLOT.format(86400, 20) + " SELECT event_id, destination, slot, batch FROM b"),
    "batch_size_limit": (
        lambda spark, sf_dir: R.size_limited(R.batches(_events(spark, sf_dir), 50, 864000), 10_500, 100_000).select("id", "batch", "part"),
        "WITH RECURSIVE " + _SLOT.format(864000, 50).removeprefix("WITH ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY destination, slot, batch ORDER BY arrival) AS i FROM b),
f(destination, slot, batch, i, event_id, total, part, skip) AS (
  SELECT destination, slot, batch, i, event_id, CASE WHEN size > 10500 THEN 5 ELSE 5 + size END, 0, size > 10500 FROM o WHERE i = 1
  UNION ALL SELECT o.destination, o.slot, o.batch, o.i, o.event_id, CASE WHEN size > 10500 THEN total WHEN total + size > 100000 THEN 5 + size ELSE total + size END,
    CASE WHEN size <= 10500 AND total + size > 100000 THEN part + 1 ELSE part END, size > 10500 FROM f JOIN o ON o.destination = f.destination AND o.slot = f.slot AND o.batch = f.batch AND o.i = f.i + 1)
SELECT event_id AS id, batch, CASE WHEN NOT skip THEN part END AS part FROM f""",
    ),
    "usage_delta": (_usage, f"WITH {EVENTS} SELECT type AS signal, strftime(ts, '%Y-%m-%d') AS at, count(*) AS delta FROM e GROUP BY ALL"),
    "set_union": (_set("union"), _U.format("UNION")),
    "set_intersect": (_set("intersect"), _U.format("INTERSECT")),
    "set_difference": (_set("difference"), _U.format("EXCEPT")),
    "parallel_map": (_parallel, f"WITH {EVENTS} SELECT event_id, value, value / 2 AS half FROM e WHERE value / 2 > 10"),
    "response_accounting": (
        _responses,
        _SLOT.format(86400, 5) + """, p AS (SELECT event_id, destination || '/' || slot || '/' || batch AS batch, event_id % 5 AS position FROM b),
o AS (SELECT batch, position, max(CASE WHEN event_id % 11 = 0 THEN 400 ELSE 202 END) AS s FROM p WHERE event_id % 7 <> 0 GROUP BY ALL)
SELECT event_id, CASE WHEN substr(md5(batch), 1, 1) = '0' THEN 503 ELSE coalesce(s, 500) END AS status FROM p LEFT JOIN o USING (batch, position)""",
    ),
    "dedup_send_once": (lambda spark, sf_dir: line_spans(spark, sf_dir).df.select("trace_id").dropDuplicates(["trace_id"]), f"WITH {LINES} SELECT DISTINCT trace_id FROM l"),
    "metric_counters": (
        lambda spark, sf_dir: event_spans(spark, sf_dir).df.groupBy("trace_id").agg(F.count("*").alias("n"), F.bool_or("is_root").alias("has_root")).groupBy("has_root").agg(F.count("*").alias("n_traces"), F.sum("n").alias("n_events")),
        f"WITH {EVENTS} SELECT has_root, count(*) AS n_traces, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT trace_id, count(*) AS n, bool_or(is_root) AS has_root FROM e GROUP BY ALL) GROUP BY ALL",
    ),
    "metric_histograms": (
        lambda spark, sf_dir: line_spans(spark, sf_dir).df.groupBy("trace_id").agg(F.count("*").alias("n")).groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("bucket")).agg(F.count("*").alias("n_traces"), F.expr("percentile(n, 0.5)").alias("median"), F.max("n").alias("most")),
        f"WITH {LINES} SELECT CAST(floor(log2(n)) AS INTEGER) AS bucket, count(*) AS n_traces, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, max(n) AS most FROM (SELECT trace_id, count(*) AS n FROM l GROUP BY ALL) GROUP BY ALL",
    ),
}
