"""Sending times, late records, eviction and stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.operators import samplers as S
from tracesift.operators import timing as T
from tracesift.operators.conditions import Condition
from tracesift.operators.rules import Rule, RuleSet
from tracesift.plans import decide as D
from tracesift.queries.decisions import SALT, draw
from tracesift.sources.spans import EVENTS, event_spans

HOURS = T.Timing(timeout_s=6 * 3600, delay_s=600, limit=4)
_DAY = "yyyy-MM-dd HH:mm:ss"
_TIMED = f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY arrival) AS n FROM e),
s AS (SELECT trace_id, least(min(ts) + INTERVAL 6 HOUR, min(ts) FILTER (is_root) + INTERVAL 10 MINUTE, min(ts) FILTER (n = 5)) AS send_by FROM n GROUP BY trace_id),
t AS (SELECT n.*, send_by, ts > send_by AS late FROM n JOIN s USING (trace_id)),
g AS (SELECT trace_id, send_by, count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late, bool_or(is_root AND NOT late) AS has_root FROM t GROUP BY ALL),
r AS (SELECT *, CASE WHEN has_root THEN '{T.GOT_ROOT}' WHEN n_on_time > 4 THEN '{T.LIMIT}' ELSE '{T.EXPIRED}' END AS send_reason FROM g)
"""


def _sent(spark, sf_dir):
    return T.sent(event_spans(spark, sf_dir), HOURS)


def _text(c: str = "send_by"):
    return F.date_format(c, _DAY).alias(c)


RULES = RuleSet((Rule("purchases", (Condition.of("type", "=", "purchase"),), 2), Rule("rest", None, sampler=S.Deterministic(4))))


def _late(spark, sf_dir):
    out = T.late_spans(event_spans(spark, sf_dir), HOURS, lambda s: D.decide(s, RULES))
    return out.where("keep").select("event_id", "trace_id", "rate", "reason", "send_reason")


def _late_roots(spark, sf_dir):
    out = T.late_spans(event_spans(spark, sf_dir), HOURS, lambda s: D.decide(s, RULES))
    return out.where("keep AND is_root").select("event_id", "trace_id", "n_seen", "n_seen_events", "n_seen_links")


_DECIDED = f"""d AS (SELECT trace_id, CASE WHEN p THEN 2 ELSE 4 END AS rate, CASE WHEN p THEN {draw(2)} ELSE {draw(4, SALT)} END AS keep,
  CASE WHEN p THEN 'rules/trace/purchases' ELSE 'rules/trace/rest:deterministic/chance' END || ' - late arriving span' AS reason
  FROM (SELECT trace_id, bool_or(type = 'purchase') AS p FROM t WHERE NOT late GROUP BY trace_id))"""


def _as_of(spark, sf_dir):
    s = event_spans(spark, sf_dir).df
    by_user = s.select(F.col("user").cast("string").alias("trace_id"), "ts", "event_id", "type")
    known = by_user.where("type = 'signup'").select("trace_id", "ts", (F.col("event_id") % 2 == 0).alias("keep"))
    return T.as_of_decisions(by_user.where("type <> 'signup'"), known).select("event_id", "keep")


NOW = "2024-01-15 12:00:00"


def _impacts(spark, sf_dir):
    s = event_spans(spark, sf_dir)
    size = F.octet_length("type") + F.octet_length("props") + 8
    return T.impacts(s, size, F.lit(NOW).cast("timestamp"), 86400)


_IMPACTS = f"""WITH {EVENTS}, i AS (SELECT trace_id, CAST(sum(z) AS BIGINT) AS bytes, CAST(sum((1 + CAST(floor(age * 4 / CAST(86400000000 AS DOUBLE)) AS BIGINT)) * z) AS BIGINT) AS impact
  FROM (SELECT trace_id, strlen(type) + strlen(props) + 8 AS z, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS age FROM e WHERE ts <= TIMESTAMP '{NOW}') GROUP BY trace_id)
"""


def _samples(spark, sf_dir):
    """Hourly readings of five nodes."""
    s = event_spans(spark, sf_dir).df
    node = (F.col("user") % 5).alias("node")
    return s.groupBy(node, F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("queue"), F.count_if(F.col("type") == "view").alias("peer"), F.sum("k").alias("memory"))


_SAMPLES = f"""WITH {EVENTS}, m AS (SELECT "user" % 5 AS node, date_trunc('hour', ts) AS at_, count(*) AS queue, count(*) FILTER (type = 'view') AS peer, sum(k) AS memory FROM e GROUP BY ALL),
r AS (SELECT *, least(1.0::DOUBLE, queue / 12::DOUBLE) AS a, least(1.0::DOUBLE, peer / 12::DOUBLE) AS b, least(1.0::DOUBLE, memory / 1500::DOUBLE) AS c FROM m),
v AS (SELECT node, at_, CAST(floor(greatest(sqrt(b) * 100, sqrt(a) * 100, ({T.SIGMOID_SCALE}::DOUBLE * atan(6.0::DOUBLE * (c - 0.5::DOUBLE)) + 0.5::DOUBLE) * 100)) AS BIGINT) AS level FROM r)
"""


def _levels(spark, sf_dir):
    cap, most = F.lit(12.0), F.lit(1500.0)
    m = _samples(spark, sf_dir)
    return m.select("node", "at", T.stress_level(F.col("queue"), F.col("peer"), cap, F.col("memory"), most).alias("level"))


QUERIES = {
    "send_by": (lambda spark, sf_dir: _sent(spark, sf_dir).select("trace_id", _text(), "n_on_time", "n_late"), _TIMED + "SELECT trace_id, strftime(send_by, '%Y-%m-%d %H:%M:%S') AS send_by, n_on_time, n_late FROM r"),
    "send_reason": (lambda spark, sf_dir: _sent(spark, sf_dir).select("trace_id", "has_root", "send_reason"), _TIMED + "SELECT trace_id, has_root, send_reason FROM r"),
    "send_reason_counts": (lambda spark, sf_dir: _sent(spark, sf_dir).groupBy("send_reason", "has_root").agg(F.count("*").alias("n"), F.sum("n_on_time").alias("n_records")), _TIMED + "SELECT send_reason, has_root, count(*) AS n, CAST(sum(n_on_time) AS BIGINT) AS n_records FROM r GROUP BY ALL"),
    "expire_topk": (lambda spark, sf_dir: T.expired(_sent(spark, sf_dir), F.lit(NOW).cast("timestamp"), 100).select("trace_id", _text()), _TIMED + f"SELECT trace_id, strftime(send_by, '%Y-%m-%d %H:%M:%S') AS send_by FROM (SELECT * FROM r WHERE send_by <= TIMESTAMP '{NOW}' ORDER BY send_by, trace_id LIMIT 100)"),
    "span_limit": (lambda spark, sf_dir: T.timed(event_spans(spark, sf_dir), T.Timing(86400, 86400, 3)).where("late").select("event_id", "trace_id"), f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY arrival) AS n FROM e) SELECT event_id, trace_id FROM n JOIN (SELECT trace_id, least(min(ts) + INTERVAL 1 DAY, min(ts) FILTER (n = 4)) AS by_ FROM n GROUP BY trace_id) USING (trace_id) WHERE ts > by_"),
    "late_spans": (_late, _TIMED + f", {_DECIDED} SELECT event_id, trace_id, CAST(rate AS BIGINT) AS rate, reason, '{T.LATE}' AS send_reason FROM t JOIN d USING (trace_id) WHERE late AND keep"),
    "late_root_counts": (
        _late_roots,
        _TIMED + f", {_DECIDED}, c AS (SELECT *, count(*) OVER w AS n_seen, count(*) FILTER (annotation = 'span_event') OVER w AS n_seen_events, count(*) FILTER (annotation = 'link') OVER w AS n_seen_links FROM t WINDOW w AS (PARTITION BY trace_id ORDER BY n ROWS UNBOUNDED PRECEDING)) SELECT event_id, trace_id, n_seen, n_seen_events, n_seen_links FROM c JOIN d USING (trace_id) WHERE late AND keep AND is_root",
    ),
    "as_of_decisions": (_as_of, """WITH s AS (SELECT user_id, ts, event_id % 2 = 0 AS keep FROM events WHERE event_type = 'signup') SELECT event_id, s.keep FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE event_type <> 'signup'"""),
    "cache_impact": (lambda spark, sf_dir: _impacts(spark, sf_dir), _IMPACTS + "SELECT * FROM i"),
    "evict_impact": (lambda spark, sf_dir: T.evicted(_impacts(spark, sf_dir), 20_000), _IMPACTS + "SELECT * FROM (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY impact DESC, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM i) WHERE before <= 20000"),
    "stress_level": (lambda spark, sf_dir: _levels(spark, sf_dir).select("node", F.date_format("at", _DAY).alias("at"), "level"), _SAMPLES + "SELECT node, strftime(at_, '%Y-%m-%d %H:%M:%S') AS at, level FROM v"),
    "cluster_stress": (lambda spark, sf_dir: _levels(spark, sf_dir).groupBy(F.date_format("at", _DAY).alias("at")).agg(T.cluster_level(F.col("level")).alias("level")), _SAMPLES + "SELECT strftime(at_, '%Y-%m-%d %H:%M:%S') AS at, CAST(coalesce(floor(sqrt(sum(level * level) FILTER (level > 0) / (count(*) FILTER (level > 0))::DOUBLE)), 0) AS BIGINT) AS level FROM v GROUP BY at_"),
    "stress_fsm": (
        lambda spark, sf_dir: T.stress_states(_levels(spark, sf_dir), 80, 65, 7200).select("node", F.date_format("at", _DAY).alias("at"), "level", "stressed"),
        "WITH RECURSIVE " + _SAMPLES.removeprefix("WITH ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY at_) AS i FROM v),
f(node, at_, level, i, stressed, until) AS (
  SELECT node, at_, level, i, level >= 80, CASE WHEN level >= 80 THEN epoch(at_) + 7200 END FROM o WHERE i = 1
  UNION ALL
  SELECT node, at_, level, i, act AND NOT (level < 65 AND epoch(at_) > coalesce(u, -1e300)), u FROM (
    SELECT *, CASE WHEN act AND level >= 65 THEN epoch(at_) + 7200 ELSE was_until END AS u FROM (
      SELECT o.*, f.stressed OR o.level >= 80 AS act, f.until AS was_until FROM f JOIN o ON o.node = f.node AND o.i = f.i + 1)))
SELECT node, strftime(at_, '%Y-%m-%d %H:%M:%S') AS at, level, stressed FROM f""",
    ),
}
