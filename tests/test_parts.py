"""Rules files, keys, times, sizes, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tracesift.functions import fields as X
from tracesift.operators import samplers as S
from tracesift.operators.routing import size_limited
from tracesift.sources import bodies, rulesfile

RULES = """
RulesVersion: 2
Samplers:
  __default__: {DeterministicSampler: {SampleRate: 4}}
  production:
    RulesBasedSampler:
      CheckNestedFields: true
      Rules:
        - {Name: drop, Drop: true, Conditions: [{Field: status, Operator: "=", Value: 200, Datatype: int}]}
        - {Name: rest, Sampler: {EMADynamicSampler: {GoalSampleRate: 5, FieldList: [a, b], AdjustmentInterval: 1m30s}}}
  other: {TotalThroughputSampler: {GoalThroughputPerSec: 100, FieldList: [x], UseClusterSize: true}}
"""


def test_rules_file(tmp_path, monkeypatch):
    known = rulesfile.samplers(rulesfile.parse(RULES), peers=4)
    assert rulesfile.lookup(known, "nowhere") == S.Deterministic(4)
    rules = rulesfile.lookup(known, "production")
    assert rules.nested and rules.rules[0].drop and rules.rules[1].sampler == S.EmaDynamic(5, ("a", "b"), 90)
    assert known["other"].peers == 4 and S.cluster_goal(10, 2) == 5 and S.cluster_goal(1, 3) == 1
    bad = rulesfile.parse(RULES.replace("Operator: \"=\"", "Operator: \"==\"").replace("GoalSampleRate: 5, ", "").replace("DeterministicSampler", "DeterministicSampeler"))
    messages = " ".join(rulesfile.validate(bad))
    assert "'=='" in messages and "GoalSampleRate is needed" in messages and "did you mean DeterministicSampler" in messages
    assert rulesfile.validate({}) == ["RulesVersion must be 2", "Samplers needs __default__"]
    a, b = tmp_path / "a.yaml", tmp_path / "b.json"
    a.write_text(RULES)
    b.write_text(json.dumps({"Samplers": {"__default__": {"DeterministicSampler": {"SampleRate": 9}}, "${WHERE}": {"DeterministicSampler": {"SampleRate": 2}}}}))
    following = rulesfile.Reloading([str(a), str(b)])
    first = following.now()
    assert first["__default__"] == S.Deterministic(9) and following.now() is first
    b.write_text("{}")
    assert following.now()["__default__"] == S.Deterministic(4)
    monkeypatch.setenv("WHERE", "x")
    assert rulesfile.expand(["${WHERE}", "${NOT_THERE_AT_ALL}"]) == ["x", "${NOT_THERE_AT_ALL}"]
    assert rulesfile.size("2GiB") == 2 << 30 and rulesfile.size("1.5kb") == 1500 and rulesfile.seconds("250ms") == 0.25


def test_version_1():
    old = {"Sampler": "DeterministicSampler", "SampleRate": 3, "web": {"Sampler": "DynamicSampler", "SampleRate": 2, "FieldList": ["a"], "ClearFrequencySec": 60}, "api": {"Sampler": "RulesBasedSampler", "rule": [{"name": "r", "SampleRate": 2, "condition": [{"field": "a", "operator": "=", "value": 1}]}]}}
    known = rulesfile.samplers(rulesfile.from_version_1(old))
    assert known["__default__"] == S.Deterministic(3) and known["web"] == S.Dynamic(2, ("a",), 60)
    assert known["api"].rules[0].conditions[0].fields == ("a",)


def test_keys(spark):
    """Every mode with a blank, a listed and a foreign key, known by itself or by its id."""
    keys = {"": True, "listed-one": True, "foreign": False}
    rows = [(k, i, k in ("listed-one",) or i == "id-listed") for k in keys for i in ("", "id-listed", "id-foreign")]
    swapped = {"none": lambda k, known: False, "all": lambda k, known: True, "nonblank": lambda k, known: k != "", "listedonly": lambda k, known: known, "missingonly": lambda k, known: k == "", "unlisted": lambda k, known: k != "" and not known}
    df = spark.createDataFrame(rows, "k string, i string, known boolean")
    for mode, swap in swapped.items():
        got = df.select("k", "i", "known", X.replace_key(F.col("k"), mode, "ours", ["listed-one"], F.col("i"), ["id-listed"]).alias("g")).collect()
        assert [r.g for r in got] == [("ours" if swap(r.k, r.known) else r.k) or None for r in got], mode
    legacy = spark.createDataFrame([("0f" * 16,), ("hcaic_" + "z9" * 29,), ("0f" * 16 + "0",), ("",), (None,)], "k string")
    assert [r[0] for r in legacy.select(X.is_legacy_key(F.col("k"))).collect()] == [True, True, False, False, False]


def test_times(spark):
    texts = ["1700000000", "1700000000123", "1700000000.5", "2023-11-14T22:13:20.250Z", "2023-11-14T23:13:20+01:00", "soon", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_millis(X.event_time(F.col("t"))).alias("ms")).collect()
    assert [r.ms for r in got] == [1700000000000, 1700000000123, 1700000000500, 1700000000250, 1700000000000, None, None, None]


def test_bodies(spark):
    df = spark.createDataFrame([(1, '[{"time":"1700000000","samplerate":3,"data":{"a":1}},{"data":{"b":{"c":"x"}}},{"samplerate":0}]'), (2, "no json"), (3, None)], "id int, body string")
    rows = bodies.batch(df, "body").orderBy("position").collect()
    assert [(r.id, r.position, r.sample_rate) for r in rows] == [(1, 0, 3), (1, 1, 1)]
    assert [r.status for r in bodies.statuses(df, "body", F.col("position") == 1).where("id = 1").orderBy("position").collect()] == [202, 429, 400]
    one = spark.createDataFrame([("{}", "5"), ('{"a":1}', "x"), ("", "1")], "body string, rate string")
    assert [r.sample_rate for r in bodies.single(one, "body", rate="rate").collect()] == [1]


def test_otlp(spark):
    """Attributes keep their types; repeated keys, unreadable times, lists and missing parts spoil nothing."""
    value = lambda **v: dict(v)
    attributes = [("n", value(intValue="200")), ("x", value(doubleValue=2.5)), ("ok", value(boolValue=True)), ("s", value(stringValue='a "b"')), ("n", value(intValue=404)), ("l", value(arrayValue={"values": [value(intValue="1"), value(stringValue="z")]})), ("o", value(kvlistValue={"values": [{"key": "in", "value": value(intValue="3")}]})), ("bad", value(intValue="many")), (None, value(intValue="1")), ("none", None)]
    listed = [{"key": k, "value": v} for k, v in attributes]
    span = {"traceId": "t", "spanId": "s", "name": "GET", "kind": 2, "status": {"code": 2, "message": "no"}, "startTimeUnixNano": "1700000000123456789", "endTimeUnixNano": "never", "attributes": listed, "events": [{"timeUnixNano": "1700000001000000000", "name": "retry", "attributes": [{"key": "try", "value": {"intValue": "2"}}]}, {}], "links": [{"traceId": "u", "spanId": "v"}]}
    body = lambda *spans: json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "n", "value": {"intValue": "1"}}, {"key": "host", "value": {"stringValue": "h"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": list(spans)}]}]})
    df = spark.createDataFrame([(body(span),), (body({"spanId": "w", "parentSpanId": "s"}),), ("no json",), ("{}",), (None,)], "body string")
    rows = bodies.otlp_traces(df, "body").withColumn("payload", F.to_json("payload")).collect()
    assert sorted((r.annotation, r.is_root, r.parent_id) for r in rows) == [("", False, "s"), ("", True, None), ("link", False, "s"), ("span_event", False, "s"), ("span_event", False, "s")]
    root = next(r for r in rows if r.is_root)
    assert json.loads(root.payload) == {"host": "h", "n": 404, "x": 2.5, "ok": True, "s": 'a "b"', "l": [1, "z"], "o": {"in": 3}}
    assert root.attributes["n"] == "404" and root.attributes["x"] == "2.5" and json.loads(root.attributes["l"]) == [1, "z"] and root.resource == {"n": "1", "host": "h"}
    assert (root.kind, root.status_code, root.status_message, root.duration_ms, root.ts.microsecond) == ("2", "2", "no", None, 123456)
    event = next(r for r in rows if r.name == "retry")
    assert json.loads(event.payload) == {"n": 1, "host": "h", "try": 2} and next(r for r in rows if r.annotation == "link").link_trace_id == "u"
    log = {"traceId": "t", "timeUnixNano": "0", "observedTimeUnixNano": "1700000000000000000", "severityText": "WARN", "body": {"intValue": "7"}, "attributes": listed}
    logs = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [log, {"body": {"stringValue": "b"}, "timeUnixNano": "x"}]}]}]})
    got = bodies.otlp_logs(spark.createDataFrame([(logs,), ("[",)], "body string"), "body").withColumn("payload", F.to_json("payload")).orderBy("body").collect()
    assert [(r.body, r.severity, r.ts is None, r.is_root) for r in got] == [("7", "WARN", False, False), ("b", None, True, False)] and json.loads(got[0].payload)["n"] == 404


def test_batches_split_by_size(spark):
    df = spark.createDataFrame([("d", 0, 0, i, i, s) for i, s in enumerate([40, 40, 200, 40])], "destination string, slot long, batch long, arrival int, id long, size long")
    got = {r.id: r.part for r in size_limited(df, 100, 100).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 1}


@pytest.mark.parametrize("steps,states", [([(0, 95), (5, 70), (11, 70), (12, 70)], [True, True, False, False]), ([(0, 95), (11, 70), (12, 95), (30, 10)], [True, False, True, False]), ([(0, 80), (5, 74)], [False, False])])
def test_stress_states(spark, steps, states):
    from tracesift.operators.timing import stress_states

    df = spark.createDataFrame([("n", t, level) for t, level in steps], "node string, t long, level long").select("node", F.timestamp_seconds("t").alias("at"), "level")
    assert [r.stressed for r in stress_states(df).orderBy("at").collect()] == states
    assert {r.stressed for r in stress_states(df, mode="always").collect()} == {True}


def test_delivery(spark, tmp_path):
    from tracesift.operators.sinks import deliver

    rows = [("ok", 0, 0, 0, 1), ("ok", 0, 0, 0, 2), ("busy", 0, 0, 0, 3), ("down", 0, 0, 0, 4), ("slow", 0, 0, 0, 5), ("ok", 0, 0, None, 6), ("short", 0, 0, 0, 7), ("short", 0, 0, 0, 8)]
    df = spark.createDataFrame(rows, "destination string, slot long, batch long, part int, id long")
    tried = str(tmp_path)

    def send(pdf):
        import os

        name = pdf["destination"].iloc[0]
        again = os.path.exists(f"{tried}/{name}")
        open(f"{tried}/{name}", "w").close()
        if name == "busy" and not again:
            return 429, None, 0.0
        if name == "down":
            return 503, None, 120.0
        if name == "slow" and not again:
            raise TimeoutError
        return 200, [202] * (1 if name == "short" else len(pdf)), None

    assert {r.id: r.status for r in deliver(df, send, lambda s: None).collect()} == {1: 202, 2: 202, 3: 202, 4: 503, 5: 202, 6: 400, 7: 202, 8: 500}


@pytest.mark.parametrize("name", ["otlp_traces", "otlp_events"])
def test_requests_do_not_grow_with_the_table(spark, sf_dir, monkeypatch, name):
    """Ten times the order lines are more requests of at most as many spans, and none is lost."""
    from tracesift.queries import extract
    from tracesift.sources import bodies
    from tracesift.sources.spans import Spans, line_spans

    lines = line_spans(spark, sf_dir).df.crossJoin(spark.range(10).select(F.col("id").alias("copy"))).withColumn("trace_id", F.concat_ws("-", "trace_id", "copy")).drop("copy")
    made = []
    monkeypatch.setattr(extract, "line_spans", lambda *_: Spans(lines))
    monkeypatch.setattr(bodies, "otlp_traces", lambda requests, body, run=bodies.otlp_traces: made.append(requests) or run(requests, body))
    extract.QUERIES[name][0](spark, sf_dir)
    sizes = [r.n for r in made[0].select(F.size(F.from_json("body", bodies.TRACES)["resourceSpans"][0]["scopeSpans"][0]["spans"]).alias("n")).collect()]
    assert max(sizes) <= 500 and sum(sizes) == lines.count()
