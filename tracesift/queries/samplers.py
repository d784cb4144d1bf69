"""Samplers over users' days: which rates keys get, and which traces are kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.operators import samplers as S
from tracesift.operators.tracekey import TraceKey
from tracesift.plans import decide as D
from tracesift.queries.decisions import SALT, draw
from tracesift.sources.spans import EVENTS, LINES, event_spans, line_spans

DAY = 86400
KEY = TraceKey(("type",))


def _traces(spark, sf_dir):
    """state, key, ts, n_descendants, trace_id"""
    s = event_spans(spark, sf_dir)
    t = s.df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), F.min("ts").alias("ts"), *KEY.aggregates(s, "k_"))
    return t.select("trace_id", F.lit("s").alias("state"), KEY.key(s, "k_")[0].alias("key"), "ts", "n_descendants")


_TRACES = f"""WITH RECURSIVE {EVENTS}, t AS (SELECT trace_id, count(*) AS n, min(ts) AS ts, array_to_string(list_sort(list(DISTINCT type)), '•') || '•,' AS key FROM e GROUP BY trace_id)"""


def _counts(seconds: int) -> str:
    return f"c AS (SELECT key, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS i, sum(n) AS n, min(ts) AS first FROM t GROUP BY ALL)"


def _rate(by_log: bool, goal: str, source: str) -> str:
    """CTE z (key, i, rate) over ``source`` (key, i, n); ``goal``: an expression over ``total``."""
    weight = "greatest(log10(greatest(CAST(n AS DOUBLE), 1.0::DOUBLE) + 1e-9), 0.0::DOUBLE)" if by_log else "1.0::DOUBLE"
    return f"""w AS (SELECT *, {weight} AS w, sum(n) OVER (PARTITION BY i) AS total FROM {source}),
z AS (SELECT key, i, total, greatest(1, CAST(ceil(round(n / greatest(1.0::DOUBLE, CASE WHEN sum(w) OVER (PARTITION BY i) > 0 THEN w / sum(w) OVER (PARTITION BY i) ELSE 0 END * {goal}), 9)) AS BIGINT)) AS rate FROM w)"""


def _rates(sampler):
    return lambda spark, sf_dir: S.rates(_traces(spark, sf_dir), sampler)[0].select("key", "interval", "rate")


def _decided(sampler):
    return lambda spark, sf_dir: S.decide(_traces(spark, sf_dir), sampler).select("trace_id", "rate", "keep")


_EMA = """x AS (SELECT min(i) AS lo, max(i) AS hi FROM c), y AS (SELECT DISTINCT key, unnest(range(lo, hi + 1)) AS i FROM c, x),
g AS (SELECT y.key, y.i, CAST(coalesce(c.n, 0) AS DOUBLE) AS n, row_number() OVER (PARTITION BY y.key ORDER BY y.i) AS r FROM y LEFT JOIN c USING (key, i)),
m(key, i, r, ema) AS (SELECT key, i, r, CASE WHEN 0.5 * n >= 0.5 THEN 0.5::DOUBLE * n ELSE 0 END FROM g WHERE r = 1
  UNION ALL SELECT g.key, g.i, g.r, CASE WHEN 0.5::DOUBLE * g.n + 0.5::DOUBLE * m.ema >= 0.5 THEN 0.5::DOUBLE * g.n + 0.5::DOUBLE * m.ema ELSE 0 END FROM m JOIN g ON g.key = m.key AND g.r = m.r + 1),
a AS (SELECT key, i, ema AS n FROM m WHERE ema > 0)"""
_DRAW = draw("greatest(rate, 1)", "dynamic")
_PICK = """SELECT trace_id, rate, rate <= 1 OR {0} AS keep FROM (SELECT trace_id, {1} AS rate FROM t LEFT JOIN (SELECT key, i + 1 AS i, rate FROM z) z ON z.key = t.key AND z.i = CAST(floor(epoch(ts) / {2}) AS BIGINT))"""

DYNAMIC, EMA = S.Dynamic(10, ("type",), DAY), S.EmaDynamic(10, ("type",), DAY)
THROUGHPUT, WINDOWED = S.TotalThroughput(1, ("type",), 600), S.WindowedThroughput(1, ("type",), 3600, 6 * 3600)
EMA_THROUGHPUT = S.EmaThroughput(1, ("type",), 300, initial=7)
CAPPED = S.Dynamic(10, ("type",), DAY, max_keys=5)

_DYN = f"{_TRACES}, {_counts(DAY)}, {_rate(True, 'total / 10.0::DOUBLE', 'c')} "
_EMAS = f"{_TRACES}, {_counts(DAY)}, {_EMA}, {_rate(True, 'total / 10.0::DOUBLE', 'a')} "
_TOTAL = f"{_TRACES}, {_counts(600)}, {_rate(False, '600.0::DOUBLE', 'c')} "
_EMA_T = f"{_TRACES}, {_counts(300)}, {_EMA}, {_rate(True, '300.0::DOUBLE', 'a')} "
_NEXT = "SELECT key, i + 1 AS interval, rate FROM z"
_SPREAD = "h AS (SELECT key, unnest(range(i + 1, i + 7)) AS i, n FROM c), v AS (SELECT key, i, sum(n) AS n FROM h GROUP BY ALL)"


def _bursts(spark, sf_dir):
    return S.bursts(_traces(spark, sf_dir), S.EmaDynamic(10, ("type",), 3600, burst_multiple=1.5)).select("interval", "n", "burst")


def _clusters(spark, sf_dir):
    n = line_spans(spark, sf_dir).df.select("part").distinct()
    goal = F.greatest(F.floor(F.col("part") / 3), F.lit(1)).cast("long")
    return n.select("part", goal.alias("goal"))


QUERIES = {
    "det_rate10": (lambda spark, sf_dir: D.decide(line_spans(spark, sf_dir), S.Deterministic(10)).select("trace_id", "rate", "keep", "reason"), f"WITH {LINES} SELECT DISTINCT trace_id, CAST(10 AS BIGINT) AS rate, {draw(10, SALT)} AS keep, 'deterministic/chance' AS reason FROM l"),
    "det_always": (lambda spark, sf_dir: D.decide(line_spans(spark, sf_dir), S.Deterministic(1)).select("trace_id", "rate", "keep", "reason"), f"WITH {LINES} SELECT DISTINCT trace_id, CAST(1 AS BIGINT) AS rate, true AS keep, 'deterministic/always' AS reason FROM l"),
    "stress_sampler": (lambda spark, sf_dir: line_spans(spark, sf_dir).df.select("trace_id").distinct().select("trace_id", S.stress_keep(F.col("trace_id"), 100).alias("keep")), f"WITH {LINES} SELECT DISTINCT trace_id, {draw(100, '34527861234')} AS keep FROM l"),
    "dyn_avg_rates": (_rates(DYNAMIC), _DYN + _NEXT),
    "dyn_avg_decisions": (_decided(DYNAMIC), _DYN + _PICK.format(_DRAW, "coalesce(rate, 1)", DAY)),
    "dyn_max_keys": (_rates(CAPPED), f"{_TRACES}, {_counts(DAY)}, k AS (SELECT key, i, n FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY first, key) AS r FROM c) WHERE r <= 5), {_rate(True, 'total / 10.0::DOUBLE', 'k')} " + _NEXT),
    "ema_averages": (lambda spark, sf_dir: S.moving_averages(S.key_counts(_traces(spark, sf_dir), DAY, 500), 0.5, None).select("key", "interval", F.round("ema", 9).alias("ema")), f"{_TRACES}, {_counts(DAY)}, {_EMA} SELECT key, i AS interval, round(n, 9) AS ema FROM a"),
    "ema_rates": (_rates(EMA), _EMAS + _NEXT),
    "ema_decisions": (_decided(EMA), _EMAS + _PICK.format(_DRAW, "coalesce(rate, 1)", DAY)),
    "ema_throughput_rates": (_rates(EMA_THROUGHPUT), _EMA_T + _NEXT),
    "ema_throughput_decisions": (_decided(EMA_THROUGHPUT), _EMA_T + _PICK.format(_DRAW, "CASE WHEN CAST(floor(epoch(ts) / 300) AS BIGINT) = (SELECT min(i) FROM c) THEN 7 ELSE coalesce(rate, 1) END", 300)),
    "ema_bursts": (
        _bursts,
        f"{_TRACES}, {_counts(3600)}, {_EMA}, p AS (SELECT i + 1 AS i, sum(n) AS e FROM a GROUP BY i), q AS (SELECT i, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY i) SELECT i AS interval, n, i - (SELECT min(i) FROM c) >= 3 AND n > coalesce(e, 0) * 1.5::DOUBLE AS burst FROM q LEFT JOIN p USING (i)",
    ),
    "windowed_throughput_rates": (_rates(WINDOWED), f"{_TRACES}, {_counts(3600)}, {_SPREAD}, {_rate(False, '21600.0::DOUBLE', 'v')} SELECT key, i AS interval, rate FROM z"),
    "total_throughput_rates": (_rates(THROUGHPUT), _TOTAL + _NEXT),
    "total_throughput_decisions": (_decided(THROUGHPUT), _TOTAL + _PICK.format(_DRAW, "coalesce(rate, 1)", 600)),
    "cluster_goal": (_clusters, f"WITH {LINES} SELECT DISTINCT part, greatest(part // 3, 1) AS goal FROM l"),
    "decide_dynamic_rule": (
        lambda spark, sf_dir: D.decide(event_spans(spark, sf_dir), DYNAMIC).select("trace_id", "rate", "keep", "reason", "sample_key"),
        _DYN + "SELECT p.*, 'dynamic' AS reason, t.key AS sample_key FROM (" + _PICK.format(_DRAW, "coalesce(rate, 1)", DAY) + ") p JOIN t USING (trace_id)",
    ),
}
