"""Streaming jobs over the events table, run to its end, against the batch replay of the same records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracesift.plans import decide as D
from tracesift.queries import timing as Q
from tracesift.queries import samplers as P
from tracesift.sources.spans import event_spans
from tracesift.operators import timing as T
from tracesift.streaming import assembly, rates


def _folder(spark) -> str:
    """The cluster's shared folder, or a local one where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="tracesift-stream-")
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _records(spark, sf_dir):
    """The events table as a stream; a file source needs a folder, so one file is picked by name."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.concat_ws("-", "user_id", F.date_format(ts, "yyyy-MM-dd")).alias("trace_id"), (F.col("event_type") == "signup").alias("is_root"), F.unix_millis(ts).alias("at_ms"), ts.alias("ts"),
        F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "error", "span_event").when(F.col("event_type") == "view", "link").otherwise("").alias("annotation"),
    )


def _run(spark, sf_dir, decide=lambda s: D.decide(s, Q.RULES)):
    at = _folder(spark)
    query = assembly.run(_records(spark, sf_dir), Q.HOURS, decide, at, f"{at}/checkpoint", replay="0 seconds", trigger={"availableNow": True})
    query.awaitTermination()
    return assembly.kept(spark, at)


def _tail(spark, sf_dir):
    return _run(spark, sf_dir).where("NOT late").select("event_id", "trace_id", F.col("rate").cast("long").alias("rate"), "reason", "send_reason")


def _late(spark, sf_dir):
    return _run(spark, sf_dir).where("late").select("event_id", "trace_id", F.col("rate").cast("long").alias("rate"), "reason", "send_reason")


def _ema(spark, sf_dir):
    """Live traces by a moving-average sampler, whose counts outlast the micro-batches."""
    rows = _run(spark, sf_dir, lambda s, counts: D.decide(s, P.EMA, history=counts)).where("NOT late")
    return rows.select("event_id", "trace_id", F.col("rate").cast("long").alias("rate"), "reason")


def _stress(spark, sf_dir):
    """Under stress records are kept or dropped at once, by their trace id: a stateless filter."""
    from tracesift.operators.samplers import stress_keep

    at = _folder(spark)
    out = _records(spark, sf_dir).where(stress_keep(F.col("trace_id"), 10)).select("event_id", "trace_id", F.lit(True).alias("stressed"))
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, trace_id string, stressed boolean").parquet(f"{at}/out")


def _counts(spark, sf_dir):
    """Counts by key and hour over a watermark, as the dynamic samplers need them; the last open hour is left out."""
    at = _folder(spark)
    rates.key_counts(_records(spark, sf_dir), "type", 3600, "10 minutes").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, interval long, n long").parquet(f"{at}/out")


_KEPT = """SELECT event_id, trace_id, CAST(rate AS BIGINT) AS rate, {0} AS reason, {1} AS send_reason FROM t JOIN d USING (trace_id) {2}"""
_BY_HOUR = "SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS interval, count(*) AS n FROM events GROUP BY ALL HAVING floor(epoch(ts) / 3600) < (SELECT floor(epoch(max(ts) - INTERVAL 10 MINUTE) / 3600) FROM events)"

# traces that a late record closes are decided with the records' own batch, the others once the watermark has passed
_ON_TIME = f"""WITH RECURSIVE o AS ({Q._TIMED} SELECT event_id, trace_id, ts, type, n_late > 0 AS early FROM t JOIN g USING (trace_id) WHERE NOT late AND t.send_by <= (SELECT max(ts) FROM e)),
every AS (SELECT trace_id, early, count(*) AS n, min(ts) AS ts, array_to_string(list_sort(list(DISTINCT type)), '•') || '•,' AS key FROM o GROUP BY ALL)"""
_EMA_RATES = "(WITH RECURSIVE t AS (SELECT * FROM every WHERE {}), " + f"{P._counts(P.DAY)}, {P._EMA}, {P._rate(True, 'total / 10.0::DOUBLE', 'a')} SELECT key, i + 1 AS i, rate FROM z)"
_LIVE_EMA = f"""{_ON_TIME}, r AS (SELECT true AS early, * FROM {_EMA_RATES.format("early")} UNION ALL SELECT false, * FROM {_EMA_RATES.format("true")}),
p AS (SELECT every.trace_id, coalesce(rate, 1) AS rate FROM every LEFT JOIN r ON r.key = every.key AND r.early = every.early AND r.i = CAST(floor(epoch(ts) / {P.DAY}) AS BIGINT))
SELECT event_id, trace_id, rate, 'emadynamic' AS reason FROM p JOIN o USING (trace_id) WHERE rate <= 1 OR {P._DRAW}"""

QUERIES = {
    "stream_tail_sample": (_tail, Q._TIMED + f", {Q._DECIDED} " + _KEPT.format(f"replace(reason, ' - {T.LATE_REASON}', '')", "send_reason", "JOIN r USING (trace_id) WHERE keep AND NOT late AND r.send_by <= (SELECT max(ts) FROM e)")),
    "stream_late": (_late, Q._TIMED + f", {Q._DECIDED} " + _KEPT.format("reason", f"'{T.LATE}'", "WHERE keep AND late")),
    "stream_ema": (_ema, _LIVE_EMA),
    "stream_stress": (_stress, f"WITH {Q.EVENTS} SELECT event_id, trace_id, true AS stressed FROM e WHERE {Q.draw(10, '34527861234')}"),
    "stream_counts": (_counts, "SELECT key, interval, n FROM (" + _BY_HOUR.replace("GROUP BY ALL HAVING", "GROUP BY 1, 2, floor(epoch(ts) / 3600) HAVING") + ")"),
}
