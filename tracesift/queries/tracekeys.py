"""Trace keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.operators.tracekey import TraceKey
from tracesift.sources.spans import LINES, line_spans
from tracesift.queries.conditions import text


def _keys(key: TraceKey):
    def run(spark, sf_dir):
        s = line_spans(spark, sf_dir)
        t = s.df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), *key.aggregates(s, "k_"))
        k, n = key.key(s, "k_")
        return t.select("trace_id", k.alias("key"), n.alias("n_values"))

    return run


def _user_keys(spark, sf_dir):
    """Users as traces of very many values: the cap ends the collection."""
    from tracesift.sources.spans import Spans, event_spans

    s = event_spans(spark, sf_dir)
    s = Spans(s.df.withColumn("trace_id", F.col("user").cast("string")).select("trace_id", "is_root", "arrival", "k", "type"))
    key = TraceKey(("k", "type"), by_arrival=True)
    t = s.df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), *key.aggregates(s, "k_"))
    k, n = key.key(s, "k_")
    return t.select("trace_id", k.alias("key"), n.alias("n_values"))


_V = "SELECT trace_id, count(*) AS n, list_sort(list(DISTINCT flag)) AS f, list_sort(list(DISTINCT {})) AS q, list_sort(list(DISTINCT CAST(line AS VARCHAR))) AS i, list_sort(list(DISTINCT depot) FILTER (depot IS NOT NULL)) AS d, arg_max(status, arrival) FILTER (is_root) AS rs, arg_max(discount, arrival) FILTER (is_root) AS rd FROM l GROUP BY trace_id".format(text("quantity"))
_J = "coalesce(array_to_string({0}, '•') || '•,', '')"

QUERIES = {
    "trace_key": (
        _keys(TraceKey(("quantity", "flag", "nowhere"))),
        f"WITH {LINES}, v AS ({_V}) SELECT trace_id, {_J.format('f')} || {_J.format('q')} AS key, len(f) + len(q) AS n_values FROM v",
    ),
    "trace_key_missing": (
        _keys(TraceKey(("depot",))),
        f"WITH {LINES}, v AS ({_V}) SELECT trace_id, CASE WHEN d IS NULL THEN '' ELSE {_J.format('d')} END AS key, coalesce(len(d), 0) AS n_values FROM v",
    ),
    "trace_key_root": (
        _keys(TraceKey(("flag", "root.status", "root.discount"))),
        f"WITH {LINES}, v AS ({_V}) SELECT trace_id, {_J.format('f')} || coalesce({text('rd')} || ',', '') || coalesce(rs || ',', '') AS key, len(f) + (rd IS NOT NULL)::INT + (rs IS NOT NULL)::INT AS n_values FROM v",
    ),
    "trace_key_length": (
        _keys(TraceKey(("line",), True)),
        f"WITH {LINES}, v AS ({_V}) SELECT trace_id, {_J.format('i')} || n AS key, len(i) + 1 AS n_values FROM v",
    ),
    "trace_key_cap": (
        _user_keys,
        """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, json_extract_string(props, '$.k') AS v, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT trace_id, v, row_number() OVER (PARTITION BY trace_id ORDER BY min(i)) AS p FROM a WHERE v IS NOT NULL GROUP BY trace_id, v),
m AS (SELECT trace_id, list_sort(list(v) FILTER (p <= 99)) AS ks, least(count(*), 99) AS n FROM k GROUP BY trace_id),
y AS (SELECT trace_id, t, row_number() OVER (PARTITION BY trace_id ORDER BY min(i)) AS p FROM a GROUP BY trace_id, t),
z AS (SELECT trace_id, list_sort(list(t) FILTER (p <= 99 - n)) AS ts, count(*) FILTER (p <= 99 - n) AS nt FROM y JOIN m USING (trace_id) GROUP BY trace_id)
SELECT trace_id, array_to_string(ks, '•') || '•,' || CASE WHEN nt > 0 THEN array_to_string(ts, '•') || '•,' ELSE '' END AS key, CAST(n + nt AS BIGINT) AS n_values FROM m JOIN z USING (trace_id)""",
    ),
}
