"""Envelope extraction, keys, lookups and routing of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.functions import fields as X
from tracesift.functions.values import kind_of
from tracesift.sources import bodies
from tracesift.sources.spans import EVENTS, LINES, event_spans, line_spans, table

#: Keys of customers: legacy, ingest and environment keys, some listed and some missing.
_KEYED = """k AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN md5(CAST(c_custkey AS VARCHAR)) WHEN 1 THEN 'hcaic_' || substr(md5(CAST(c_custkey AS VARCHAR)) || md5('x'), 1, 58)
  WHEN 2 THEN 'env-' || c_nationkey WHEN 3 THEN '' ELSE upper(md5(CAST(c_custkey AS VARCHAR))) END AS api_key, c_mktsegment AS dataset, 'nation-' || c_nationkey AS environment FROM customer)"""


def _keyed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    m = F.md5(F.col("c_custkey").cast("string"))
    kind = F.col("c_custkey") % 5
    key = F.when(kind == 0, m).when(kind == 1, F.concat(F.lit("hcaic_"), F.substring(F.concat(m, F.md5(F.lit("x"))), 1, 58))).when(kind == 2, F.concat(F.lit("env-"), F.col("c_nationkey").cast("string"))).when(kind == 3, "").otherwise(F.upper(m))
    return c.select("c_custkey", key.alias("api_key"), F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("environment"))


LISTED = ["env-1", "env-2", "env-3"]
_IN = "api_key IN ('env-1', 'env-2', 'env-3')"
MODES = {
    "none": "api_key",
    "all": "'sendkey'",
    "nonblank": "CASE WHEN api_key <> '' THEN 'sendkey' ELSE api_key END",
    "listedonly": f"CASE WHEN {_IN} THEN 'sendkey' ELSE api_key END",
    "missingonly": "CASE WHEN api_key = '' THEN 'sendkey' ELSE api_key END",
    "unlisted": f"CASE WHEN api_key <> '' AND NOT {_IN} THEN 'sendkey' ELSE api_key END",
}


def _modes(spark, sf_dir):
    return _keyed(spark, sf_dir).select("c_custkey", *[X.replace_key(F.col("api_key"), m, "sendkey", LISTED).alias(m) for m in MODES])


def _ids(spark, sf_dir):
    e = event_spans(spark, sf_dir).df
    meta = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))).otherwise("")
    named = [F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("trace_id")), F.when(F.col("event_id") % 3 == 0, F.col("type"))]
    parents = [F.when(F.col("event_id") % 2 == 0, F.col("k").cast("string")), F.lit("")]
    signal = F.when(F.col("type") == "view", "log").otherwise("trace")
    return e.select("event_id", X.trace_id(meta, named).alias("trace"), X.is_root(parents, signal).alias("root"))


_IDS = f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'm' || event_id WHEN event_id % 4 <> 0 THEN trace_id WHEN event_id % 3 = 0 THEN type END AS trace,
  NOT (event_id % 2 = 0 AND k IS NOT NULL) AND type <> 'view' AS root FROM e"""


def _times(spark, sf_dir):
    e = event_spans(spark, sf_dir).df
    us = F.unix_micros("ts")
    n = F.col("event_id") % 6
    text = F.when(n == 0, (F.floor(us / 1000000)).cast("string")).when(n == 1, F.floor(us / 1000).cast("string")).when(n == 2, us.cast("string")).when(n == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(n == 4, "yesterday").otherwise(F.concat(F.floor(us / 1000000).cast("string"), F.lit(".5")))
    return e.select("event_id", F.unix_millis(X.event_time(text)).alias("ms"))


_TIMES = f"""WITH {EVENTS} SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts) // 1000 // 1000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts) // 1000 WHEN 3 THEN epoch_us(ts) // 1000 WHEN 5 THEN epoch_us(ts) // 1000 // 1000 * 1000 + 500 END AS ms FROM e"""


def _sizes(spark, sf_dir):
    s = line_spans(spark, sf_dir)
    names = ["quantity", "flag", "part", "depot", "bulky"]
    return s.df.groupBy("trace_id").agg(F.sum(X.payload_size({n: (kind_of(s.df.schema[n].dataType), F.col(n)) for n in names})).alias("bytes"))


def _environments(spark, sf_dir):
    """Keys to environments; the dimension is small, and joined by key whatever its size."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("env-"), F.col("n_nationkey").cast("string")).alias("api_key"), F.col("n_name").alias("env_name"))
    return _keyed(spark, sf_dir).join(n, "api_key", "left").select("c_custkey", F.coalesce("env_name", F.lit("")).alias("env_name"))


def _lookup(spark, sf_dir):
    """A sampler by exact name, else the default."""
    names = {"BUILDING": "dynamic", "nation-3": "rules", "AUTOMOBILE": "deterministic"}
    key = X.sampler_key(F.col("api_key"), F.col("dataset"), F.col("environment"))
    sampler = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("selector")]
    return _keyed(spark, sf_dir).select("c_custkey", key.alias("selector")).withColumn("sampler", F.coalesce(sampler, F.lit("default")))


_SELECT = "CASE WHEN regexp_full_match(api_key, '[0-9a-f]{32}') OR regexp_full_match(api_key, 'hc[a-z]ic_[0-9a-z]{58}') THEN dataset ELSE environment END"

_PREFIXED = _SELECT.replace("THEN dataset", "THEN 'pre.' || dataset")


def _batch_bodies(spark, sf_dir):
    e = event_spans(spark, sf_dir).df
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), F.when(F.col("sample_rate") > 0, F.col("sample_rate")).alias("samplerate"), F.struct(F.col("event_id"), F.col("type"), F.col("k")).alias("data"))
    body = e.groupBy((F.col("event_id") % 200).alias("request")).agg(F.to_json(F.collect_list(item)).alias("body"))
    out = bodies.batch(body, "body")
    return out.select(F.try_variant_get("data", "$.event_id", "long").alias("event_id"), F.try_variant_get("data", "$.type", "string").alias("type"), "sample_rate", F.unix_millis("ts").alias("ms"))


#: A request holds at most so many records, however large the table is.
REQUEST = 500


def _numbered(records):
    """Records with their ``request``: consecutive ones of a partition, so that more records are more requests, not larger ones."""
    return records.withColumn("request", F.expr(f"monotonically_increasing_id() div {REQUEST}"))


def _otlp(spark, sf_dir):
    l = line_spans(spark, sf_dir).df
    attr = lambda k, kind, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.concat_ws("-", "part", "supplier", "line").alias("spanId"), F.when(~F.col("is_root"), F.lit("p")).otherwise("").alias("parentSpanId"), F.col("status").alias("name"), F.lit("1704067200000000000").alias("startTimeUnixNano"), F.lit("1704067201500000000").alias("endTimeUnixNano"), F.array(F.struct(F.lit("flag").alias("key"), F.struct(F.col("flag").alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.collect_list(span).alias("spans"))
    resource = F.array(attr("service.name", "stringValue", F.first("flag")))
    body = _numbered(l).groupBy("request").agg(F.to_json(F.struct(F.array(F.struct(F.struct(resource.alias("attributes")).alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("body"))
    out = bodies.otlp_traces(body, "body")
    return out.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if("is_root").alias("n_roots"), F.sum("duration_ms").alias("ms"), F.count_if(F.col("attributes")["flag"] == "R").alias("n_returned"))


def _scope_body(items: str, records, resource):
    """One request body of a resource with one scope."""
    kinds = {"spans": ("resourceSpans", "scopeSpans"), "logRecords": ("resourceLogs", "scopeLogs")}[items]
    scope = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), records.alias(items))
    return F.to_json(F.struct(F.array(F.struct(F.struct(resource.alias("attributes")).alias("resource"), F.array(scope).alias(kinds[1]))).alias(kinds[0])))


def _attribute(key: str, kind: str, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


_NANOS = 1704067200000000000


def _otlp_events(spark, sf_dir):
    """Spans with events and links, each counted by trace and kind; attributes keep their types."""
    l = line_spans(spark, sf_dir).df
    attributes = lambda kind, value: F.array(F.struct(F.lit("n").alias("key"), F.struct(value.cast("string").alias(kind)).alias("value")), F.struct(F.lit("n").alias("key"), F.struct((value + 1).cast("string").alias(kind)).alias("value")))
    event = F.struct((F.lit(_NANOS) + F.col("line") * 1_000_000).cast("string").alias("timeUnixNano"), F.col("flag").alias("name"), attributes("intValue", F.col("line")).alias("attributes"))
    link = F.struct(F.col("supplier").cast("string").alias("traceId"), F.lit("s").alias("spanId"), attributes("doubleValue", F.col("line")).alias("attributes"))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("line").cast("string").alias("spanId"), F.when(~F.col("is_root"), F.lit("p")).alias("parentSpanId"), F.lit(str(_NANOS)).alias("startTimeUnixNano"), F.lit("soon").alias("endTimeUnixNano"), attributes("intValue", F.col("line")).alias("attributes"), F.array_repeat(event, F.pmod("line", F.lit(3)).cast("int")).alias("events"), F.when(F.col("flag") == "R", F.array(link)).alias("links"))
    body = _numbered(l).groupBy("request").agg(_scope_body("spans", F.collect_list(span), F.array(_attribute("n", "intValue", F.lit("1000")))).alias("body"))
    out = bodies.otlp_traces(body, "body")
    number = F.try_variant_get("payload", "$.n", "long")
    return out.groupBy("trace_id", "annotation").agg(F.count("*").alias("n"), F.count_if("is_root").alias("n_roots"), F.sum(number).alias("total"), F.sum(F.unix_millis("ts") - F.lit(_NANOS // 1_000_000)).alias("ms"), F.count("duration_ms").alias("n_timed"), F.count("link_trace_id").alias("n_linked"))


def _otlp_logs(spark, sf_dir):
    """Log records of users' days, by severity; some have no time but that of their observation, some a body that is a number."""
    e = event_spans(spark, sf_dir).df
    nanos = (F.unix_micros("ts") * 1000).cast("string")
    log = F.struct(F.when(F.col("event_id") % 2 == 0, nanos).alias("timeUnixNano"), nanos.alias("observedTimeUnixNano"), F.col("trace_id").alias("traceId"), F.col("type").alias("severityText"), F.struct(F.when(F.col("event_id") % 3 > 0, F.col("type")).alias("stringValue"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("intValue")).alias("body"), F.array(F.struct(F.lit("k").alias("key"), F.struct(F.col("k").cast("string").alias("intValue")).alias("value"))).alias("attributes"))
    body = e.groupBy((F.col("event_id") % 50).alias("request")).agg(_scope_body("logRecords", F.collect_list(log), F.array(_attribute("host", "stringValue", F.first("type")))).alias("body"))
    out = bodies.otlp_logs(body, "body")
    return out.groupBy("trace_id", "severity").agg(F.count("*").alias("n"), F.sum(F.unix_millis("ts")).alias("ms"), F.sum(F.try_variant_get("payload", "$.k", "long")).alias("k"), F.sum(F.col("body").try_cast("long")).alias("numbers"), F.count_if("is_root").alias("n_roots"))


QUERIES = {
    "extract_ids": (lambda spark, sf_dir: _ids(spark, sf_dir).select("event_id", "trace"), f"SELECT event_id, trace FROM ({_IDS})"),
    "root_flag": (lambda spark, sf_dir: _ids(spark, sf_dir).select("event_id", "root"), f"SELECT event_id, root FROM ({_IDS})"),
    "nonspan_split": (lambda spark, sf_dir: _ids(spark, sf_dir).where("trace IS NULL").select("event_id"), f"SELECT event_id FROM ({_IDS}) WHERE trace IS NULL"),
    "probe_drop": (lambda spark, sf_dir: event_spans(spark, sf_dir).df.where("NOT coalesce(k % 9 = 0, false)").select("event_id"), f"WITH {EVENTS} SELECT event_id FROM e WHERE k % 9 <> 0 OR k IS NULL"),
    "annotation_counts": (
        lambda spark, sf_dir: event_spans(spark, sf_dir).df.groupBy("trace_id", X.annotation(F.col("annotation")).alias("kind")).agg(F.count("*").alias("n")),
        f"WITH {EVENTS} SELECT trace_id, CASE annotation WHEN 'span_event' THEN 'event' WHEN 'link' THEN 'link' ELSE 'span' END AS kind, count(*) AS n FROM e GROUP BY ALL",
    ),
    "event_time_parse": (_times, _TIMES),
    "payload_size": (_sizes, f"WITH {LINES} SELECT trace_id, CAST(sum(16 + 4 + strlen(flag) + 12 + CASE WHEN depot IS NULL THEN 0 ELSE 5 + strlen(depot) END + 6) AS BIGINT) AS bytes FROM l GROUP BY trace_id"),
    "legacy_key": (lambda spark, sf_dir: _keyed(spark, sf_dir).select("c_custkey", X.is_legacy_key(F.col("api_key")).alias("legacy")), f"WITH {_KEYED} SELECT c_custkey, {_SELECT} = dataset AS legacy FROM k"),
    "sampler_key_select": (lambda spark, sf_dir: _keyed(spark, sf_dir).select("c_custkey", X.sampler_key(F.col("api_key"), F.col("dataset"), F.col("environment"), "pre").alias("selector")), f"WITH {_KEYED} SELECT c_custkey, {_PREFIXED} AS selector FROM k"),
    "sampler_lookup_default": (_lookup, f"WITH {_KEYED} SELECT c_custkey, selector, CASE selector WHEN 'BUILDING' THEN 'dynamic' WHEN 'nation-3' THEN 'rules' WHEN 'AUTOMOBILE' THEN 'deterministic' ELSE 'default' END AS sampler FROM (SELECT c_custkey, {_SELECT} AS selector FROM k)"),
    "env_lookup_join": (_environments, f"WITH {_KEYED} SELECT c_custkey, coalesce(n_name, '') AS env_name FROM k LEFT JOIN nation ON api_key = 'env-' || n_nationkey"),
    "key_accept_semi": (lambda spark, sf_dir: _keyed(spark, sf_dir).where(X.accepted(F.col("api_key"), True, LISTED)).select("c_custkey"), f"WITH {_KEYED} SELECT c_custkey FROM k WHERE {_IN}"),
    "key_replace_modes": (_modes, f"WITH {_KEYED} SELECT c_custkey, " + ", ".join(f"nullif({sql}, '') AS \"{m}\"" for m, sql in MODES.items()) + " FROM k"),
    "user_agent_stamp": (lambda spark, sf_dir: event_spans(spark, sf_dir).df.select("event_id", F.coalesce(F.when(F.col("k") % 2 == 0, F.col("type")), F.lit("agent/1.0")).alias("agent")), f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 2 = 0 THEN type ELSE 'agent/1.0' END AS agent FROM e"),
    "dataset_unescape": (lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", bodies.dataset_of(F.concat(F.lit("/1/batch/"), F.regexp_replace("n_name", " ", "%20"))).alias("dataset")), "SELECT n_nationkey, n_name AS dataset FROM nation"),
    "batch_bodies": (_batch_bodies, f"WITH {EVENTS} SELECT event_id, type, CASE WHEN sample_rate > 0 THEN sample_rate ELSE 1 END AS sample_rate, epoch_us(ts) // 1000 AS ms FROM e"),
    "otlp_traces": (_otlp, f"WITH {LINES} SELECT trace_id, count(*) AS n, count(*) FILTER (is_root) AS n_roots, 1500.0::DOUBLE * count(*) AS ms, count(*) FILTER (flag = 'R') AS n_returned FROM l GROUP BY trace_id"),
    "otlp_events": (
        _otlp_events,
        f"""WITH {LINES}, x AS (SELECT trace_id, '' AS annotation, line, is_root, 0 AS ms, 0 AS linked FROM l UNION ALL SELECT trace_id, 'span_event', line, false, line, 0 FROM (SELECT *, unnest(range(line % 3)) FROM l)
UNION ALL SELECT trace_id, 'link', line, false, 0, 1 FROM l WHERE flag = 'R')
SELECT trace_id, annotation, count(*) AS n, count(*) FILTER (is_root) AS n_roots, CAST(sum(line + 1) AS BIGINT) AS total, CAST(sum(ms) AS BIGINT) AS ms, CAST(0 AS BIGINT) AS n_timed, CAST(sum(linked) AS BIGINT) AS n_linked FROM x GROUP BY ALL""",
    ),
    "otlp_logs": (
        _otlp_logs,
        f"WITH {EVENTS} SELECT trace_id, type AS severity, count(*) AS n, CAST(sum(epoch_us(ts) // 1000) AS BIGINT) AS ms, CAST(sum(k) AS BIGINT) AS k, CAST(sum(event_id) FILTER (event_id % 3 = 0) AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS n_roots FROM e GROUP BY ALL",
    ),
    "unknown_traces": (
        lambda spark, sf_dir: table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("trace_id")).join(line_spans(spark, sf_dir).df, "trace_id", "left_anti"),
        f"WITH {LINES} SELECT CAST(o_orderkey AS VARCHAR) AS trace_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT trace_id FROM l)",
    ),
}
