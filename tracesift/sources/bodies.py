"""Bodies of requests as rows: single events, batches, and traces and logs in the OTLP JSON form.

Bodies come as a string column of any source (files, Kafka). Numbers of event data are floats; file sources decompress gzip and zstd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions.fields import event_time

_SCALAR = "stringValue: STRING, intValue: STRING, doubleValue: STRING, boolValue: BOOLEAN, bytesValue: STRING"
_ITEM = f"STRUCT<{_SCALAR}>"
_VALUE = f"STRUCT<{_SCALAR}, arrayValue: STRUCT<values: ARRAY<{_ITEM}>>, kvlistValue: STRUCT<values: ARRAY<STRUCT<key: STRING, value: {_ITEM}>>>>"
_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {_VALUE}>>"
_EVENT = f"STRUCT<timeUnixNano: STRING, name: STRING, attributes: {_ATTRIBUTES}>"
_LINK = f"STRUCT<traceId: STRING, spanId: STRING, attributes: {_ATTRIBUTES}>"
_SPAN = f"STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: STRING, status: STRUCT<code: STRING, message: STRING>, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTRIBUTES}, events: ARRAY<{_EVENT}>, links: ARRAY<{_LINK}>>"
TRACES = f"STRUCT<resourceSpans: ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTRIBUTES}>, scopeSpans: ARRAY<STRUCT<scope: STRUCT<name: STRING>, spans: ARRAY<{_SPAN}>>>>>>"
_LOG = f"STRUCT<timeUnixNano: STRING, observedTimeUnixNano: STRING, traceId: STRING, spanId: STRING, severityText: STRING, body: {_VALUE}, attributes: {_ATTRIBUTES}>"
LOGS = f"STRUCT<resourceLogs: ARRAY<STRUCT<resource: STRUCT<attributes: {_ATTRIBUTES}>, scopeLogs: ARRAY<STRUCT<scope: STRUCT<name: STRING>, logRecords: ARRAY<{_LOG}>>>>>>"


def dataset_of(path: Column) -> Column:
    """The dataset of a request path, unescaped; null where it's missing."""
    last = F.regexp_extract(path, r"^/1/(?:events|batch)/([^/]+)$", 1)
    return F.when(last != "", F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))


def rate_of(c: Column) -> Column:
    """A sample rate; missing, unreadable and 0 mean 1."""
    n = c.cast("string").try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(1).cast("long"))


def single(requests: DataFrame, body: str, time: str | None = None, rate: str | None = None) -> DataFrame:
    """One event a request: its other columns, data (variant), ts, sample_rate. Empty or unreadable bodies give no row."""
    rest = [c for c in requests.columns if c != body]
    out = requests.select(*rest, F.try_parse_json(body).alias("data")).where(F.col("data").isNotNull() & (F.to_json("data") != "{}"))
    return out.withColumn("ts", event_time(F.col(time)) if time else F.lit(None).cast("timestamp")).withColumn("sample_rate", rate_of(F.col(rate)) if rate else F.lit(1).cast("long"))


def batch(requests: DataFrame, body: str) -> DataFrame:
    """A row for each element of each body: the other columns, position, data (variant), ts, sample_rate."""
    rest = [c for c in requests.columns if c != body]
    items = requests.select(*rest, F.posexplode(F.from_json(body, "ARRAY<STRUCT<time: STRING, samplerate: STRING, data: VARIANT>>")).alias("position", "item"))
    return items.where("item.data IS NOT NULL").select(*rest, "position", "item.data", event_time(F.col("item.time")).alias("ts"), rate_of(F.col("item.samplerate")).alias("sample_rate"))


def statuses(requests: DataFrame, body: str, refused: Column) -> DataFrame:
    """A response for each element: 202, 400 without data, 429 where ``refused`` (over position)."""
    rest = [c for c in requests.columns if c != body]
    items = requests.select(*rest, F.posexplode(F.from_json(body, "ARRAY<STRUCT<time: STRING, samplerate: STRING, data: VARIANT>>")).alias("position", "item"))
    return items.select(*rest, "position", F.when(F.col("item.data").isNull(), 400).when(refused, 429).otherwise(202).alias("status"))


def _item(v: Column) -> Column:
    """A scalar as a variant of its own type; null where it has none, or isn't what it says."""
    typed = (v["stringValue"], v["intValue"].try_cast("long"), v["doubleValue"].try_cast("double"), v["boolValue"], v["bytesValue"])
    return F.coalesce(*[c.cast("variant") for c in typed])


def _once(c: Column, use) -> Column:
    """``use`` of a column that is worked out once, not for each element of the lambdas in it."""
    return F.transform(F.array(c), use)[0]


def _entries(attributes: Column, value) -> Column:
    """Key and value of each attribute; of a key that comes more than once the last, and none without key or value."""
    known = F.filter(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: a["key"].isNotNull() & a["value"].isNotNull())
    last = _once(known, lambda k: _once(F.transform(k, lambda a: a["key"]), lambda keys: F.filter(k, lambda a, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), a["key"]))))
    return F.filter(F.transform(last, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value"))), lambda e: e["value"].isNotNull())


def _value(v: Column) -> Column:
    inner = v["kvlistValue"]["values"]
    pairs = F.filter(inner, lambda a, i: a["key"].isNotNull() & ~F.exists(F.slice(inner, i + 2, F.size(inner)), lambda b: b["key"] == a["key"]))
    object_ = F.to_variant_object(F.map_from_entries(F.transform(pairs, lambda a: F.struct(a["key"].alias("key"), _item(a["value"]).alias("value")))))
    return F.coalesce(_item(v), F.transform(v["arrayValue"]["values"], _item).cast("variant"), object_)


def _text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].try_cast("double").cast("string"), v["boolValue"].cast("string"), v["bytesValue"], F.to_json(_value(v)))


def _texts(attributes: Column) -> Column:
    """Attributes as a map of texts."""
    return F.map_from_entries(_entries(attributes, _text))


def _payload(*attributes: Column) -> Column:
    """Attributes with their types as one variant object; where lists share a key, the later one's counts."""
    joined = attributes[0]
    for more in attributes[1:]:
        joined = F.concat(F.coalesce(joined, F.array().cast(_ATTRIBUTES)), F.coalesce(more, F.array().cast(_ATTRIBUTES)))
    return F.to_variant_object(F.map_from_entries(_entries(joined, _value)))


def _nanos(c: Column) -> Column:
    """A time in nanoseconds; null where it is missing, unreadable or 0."""
    n = c.try_cast("long")
    return F.when(n != 0, F.timestamp_micros(F.call_function("div", n, F.lit(1000).cast("long"))))


def otlp_traces(requests: DataFrame, body: str) -> DataFrame:
    """A row for each span, and for each of its events and links (``annotation``: empty, ``span_event`` or ``link``).

    resource and attributes (maps of texts), payload (the resource's, then the record's own attributes with their types, as a variant),
    library, trace_id, span_id, parent_id, name, kind, status_code, status_message, ts, duration_ms, link_trace_id, link_span_id,
    is_root, signal. Events and links belong to their span (parent_id) and are never roots; a link takes its span's
    time. Unreadable times are null, of repeated attribute keys the last one counts, and unreadable bodies give no row."""
    r = requests.select(F.from_json(body, TRACES).alias("b")).select(F.explode("b.resourceSpans").alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("s")).select("ra", F.col("s.scope.name").alias("library"), F.explode("s.spans").alias("x"))
    none = F.lit(None).cast("string")

    def record(annotation: str, **own: Column) -> Column:
        fields = {"annotation": F.lit(annotation), "span_id": none, "parent_id": none, "name": none, "kind": none, "status_code": none, "status_message": none, "at": none, "end": none, "link_trace_id": none, "link_span_id": none, "attributes": F.array().cast(_ATTRIBUTES)}
        return F.struct(*[c.alias(n) for n, c in (fields | own).items()])

    x = lambda n: F.col(f"x.{n}")
    span = record("", span_id=x("spanId"), parent_id=x("parentSpanId"), name=x("name"), kind=x("kind"), status_code=x("status.code"), status_message=x("status.message"), at=x("startTimeUnixNano"), end=x("endTimeUnixNano"), attributes=x("attributes"))
    events = F.transform(x("events"), lambda e: record("span_event", parent_id=x("spanId"), name=e["name"], at=e["timeUnixNano"], attributes=e["attributes"]))
    links = F.transform(x("links"), lambda k: record("link", parent_id=x("spanId"), at=x("startTimeUnixNano"), link_trace_id=k["traceId"], link_span_id=k["spanId"], attributes=k["attributes"]))
    empty = F.array().cast("array<" + s.select(span.alias("y")).schema["y"].dataType.simpleString() + ">")
    s = s.select("ra", "library", x("traceId").alias("trace_id"), F.explode(F.concat(F.array(span), F.coalesce(events, empty), F.coalesce(links, empty))).alias("y"))
    y = lambda n: F.col(f"y.{n}")
    return s.select(
        _texts(F.col("ra")).alias("resource"), "library", "trace_id", y("span_id").alias("span_id"), y("parent_id").alias("parent_id"), y("name").alias("name"), y("kind").alias("kind"), y("status_code").alias("status_code"), y("status_message").alias("status_message"),
        _nanos(y("at")).alias("ts"), ((y("end").try_cast("long") - y("at").try_cast("long")) / 1e6).alias("duration_ms"), _texts(y("attributes")).alias("attributes"), _payload(F.col("ra"), y("attributes")).alias("payload"),
        y("annotation").alias("annotation"), y("link_trace_id").alias("link_trace_id"), y("link_span_id").alias("link_span_id"),
        ((y("annotation") == "") & (F.coalesce(y("parent_id"), F.lit("")) == "")).alias("is_root"), F.lit("trace").alias("signal"),
    )


def otlp_logs(requests: DataFrame, body: str) -> DataFrame:
    """A row for each log record: resource, library, trace_id, parent_id, severity, body (text), ts, attributes, payload, is_root, signal.

    Logs are never roots. A record without a time has the time at which it was observed."""
    r = requests.select(F.from_json(body, LOGS).alias("b")).select(F.explode("b.resourceLogs").alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s")).select("ra", F.col("s.scope.name").alias("library"), F.explode("s.logRecords").alias("x"))
    return s.select(
        _texts(F.col("ra")).alias("resource"), "library", F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("parent_id"), F.col("x.severityText").alias("severity"), _text(F.col("x.body")).alias("body"),
        F.coalesce(_nanos(F.col("x.timeUnixNano")), _nanos(F.col("x.observedTimeUnixNano"))).alias("ts"), _texts(F.col("x.attributes")).alias("attributes"), _payload(F.col("ra"), F.col("x.attributes")).alias("payload"),
        F.lit(False).alias("is_root"), F.lit("log").alias("signal"),
    )
