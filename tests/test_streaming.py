"""Live assembly over two runs of one job: due times, late records, rules that change in between, and counts that go on."""

import json

import pytest
from pyspark.sql import functions as F

from tracesift.operators import samplers as S
from tracesift.operators import timing as T
from tracesift.plans import decide as D
from tracesift.sources import rulesfile
from tracesift.sources.spans import Spans
from tracesift.streaming import assembly

COLUMNS = ("trace_id", "is_root", "at_ms", "event_id", "type")
START = 1_000_000_000_000


def _write(folder, name, records):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(COLUMNS, (*r[:2], r[2] + START, *r[3:]), strict=False))) for r in records))


def _records(spark, folder):
    return spark.readStream.schema("trace_id string, is_root boolean, at_ms long, event_id long, type string").json(str(folder)).withColumn("ts", F.timestamp_millis("at_ms"))


def test_reload_and_late_records(spark, tmp_path):
    source, rules = tmp_path / "in", tmp_path / "rules.json"
    source.mkdir()
    rate = lambda n: rules.write_text(json.dumps({"RulesVersion": 2, "Samplers": {"__default__": {"DeterministicSampler": {"SampleRate": n}}}}))
    rate(1)
    known = rulesfile.Reloading([str(rules)])
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)

    def go():
        query = assembly.run(_records(spark, source), T.Timing(60, 2, 3), lambda s: D.decide(s, known.now()["__default__"]), f"file://{tmp_path}/out", f"{tmp_path}/checkpoint", "1 hour", {"availableNow": True})
        query.awaitTermination()
        return {(r.event_id, r.rate, r.reason, r.send_reason) for r in assembly.kept(spark, f"file://{tmp_path}/out").collect()}

    # a: root after 1 s; b: no root; c: over the limit of 3 records; z only moves the clock
    _write(source, "1.json", [("a", False, 0, 1), ("a", True, 1000, 2), ("b", False, 0, 3), *[("c", False, 100 * i, 10 + i) for i in range(5)], ("z", False, 8_000_000, 99)])
    always = "deterministic/always"
    first = {(1, 1, always, T.GOT_ROOT), (2, 1, always, T.GOT_ROOT), (3, 1, always, T.EXPIRED), *[(10 + i, 1, always, T.LIMIT) for i in range(4)], (14, 1, f"{always} - {T.LATE_REASON}", T.LATE)}
    assert go() == first
    # new rules hold for new traces; a late record follows its trace's earlier decision. Of the two ids one in ten keeps the first
    rate(10)
    picked = [f"t{i}" for i in range(100) if spark.range(1).select(S.Deterministic(10).decide(F.lit(f"t{i}"))[1]).first()[0]][0]
    _write(source, "2.json", [("a", False, 8_000_000, 4), (picked, True, 8_000_000, 5), ("other", True, 8_000_000, 6), ("z", False, 16_000_000, 98)])
    late = {(4, 1, f"{always} - {T.LATE_REASON}", T.LATE)}
    more = {x for x in go() - first if x[0] not in (98, 99, 6)}
    assert more == late | {(5, 10, "deterministic/chance", T.GOT_ROOT)}
    assert spark.conf.get(setting, None) == before


@pytest.mark.parametrize("sampler", [S.Dynamic(10, ("type",), 60), S.EmaDynamic(10, ("type",), 60), S.EmaThroughput(1, ("type",), 60, initial=5), S.WindowedThroughput(1, ("type",), 60, 120), S.TotalThroughput(1, ("type",), 60)], ids=lambda s: s.name)
def test_dynamic_rates_go_on_from_batch_to_batch(spark, tmp_path, sampler):
    """Three intervals in three runs of the stream give the rates of one batch plan over all of them."""
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    minute, every = 60_000, []
    offset = -(START // 1000 % 60) * 1000  # intervals begin on the minute
    for i, counts in enumerate(({"a": 300, "b": 30}, {"a": 350, "c": 10}, {"a": 60, "b": 60})):
        rows = [(f"{i}{k}{j}", True, offset + (i + 1) * minute + j * 100, 10_000 * i + 5000 * (k == "b") + j, k) for k, n in counts.items() for j in range(n)]
        rows.append((f"clock{i}", False, offset + (i + 2) * minute - 1, -1 - i, "clock"))
        every += rows
        _write(source, f"{i}.json", rows)
        assembly.run(_records(spark, source), T.Timing(1, 0, 0), lambda s, counts: D.decide(s, sampler, history=counts), out, f"{tmp_path}/checkpoint", "0 seconds", {"availableNow": True}).awaitTermination()
    got = {r.trace_id: (r.rate, r.keep) for r in spark.read.parquet(f"{out}/decisions").collect()}
    df = spark.createDataFrame([(r[0], r[1], r[2] + START, r[4]) for r in every], "trace_id string, is_root boolean, at_ms long, type string")
    spans = Spans(df.select("trace_id", "is_root", F.struct("at_ms").alias("arrival"), F.timestamp_millis("at_ms").alias("ts"), "type"))
    want = {r.trace_id: (r.rate, r.keep) for r in D.decide(spans, sampler).collect()}
    assert len(got) >= len(want) - 1 and got == {t: want[t] for t in got}
    assert max(rate for rate, _ in got.values()) > 1
    assert len([n for n in (tmp_path / "out" / "counts").iterdir() if n.name.startswith("epoch=")]) <= 2


def test_rules_of_one_sampler_share_its_counts(spark):
    """Two rules with the same downstream sampler count together, and another prefix counts apart."""
    from tracesift.operators.conditions import Condition
    from tracesift.operators.rules import Rule, RuleSet

    day, sampler = 86400, S.Dynamic(4, ("type",), 86400)
    rows = [(f"{d}-{i}", True, d * day + i, "x", i % 2 == 0) for d in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "trace_id string, is_root boolean, at long, type string, even boolean")
    spans = Spans(df.select("trace_id", "is_root", F.struct("at").alias("arrival"), F.timestamp_seconds("at").alias("ts"), "type", "even"))
    both = RuleSet((Rule("even", (Condition.of("even", "=", True),), sampler=sampler), Rule("odd", None, sampler=sampler)))
    got = D.decide(spans, both).collect()
    assert {r.rate for r in got if r.trace_id.startswith("2-")} == {r.rate for r in D.decide(spans, sampler).collect() if r.trace_id.startswith("2-")} == {4}
    assert {r.reason for r in got} == {"rules/trace/even:dynamic", "rules/trace/odd:dynamic"}
    assert S.state_key("p", sampler) != S.state_key("q", sampler) == S.state_key("q", S.Dynamic(4, ("type",), 30))


class _Kept:
    """State of one key, as the assembler reads and writes it; each access is counted."""

    def __init__(self):
        self.value, self.rows, self.timers, self.n = None, [], set(), 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return type("", (), {"get": lambda _: self._do(self.value), "update": lambda _, x: self._do(setattr(self, "value", x)), "clear": lambda _: self._do(setattr(self, "value", None))})()

    def _do(self, out=None):
        self.n += 1
        return out

    def get(self):
        return self._do(iter(list(self.rows)))

    def put(self, rows):
        self._do(setattr(self, "rows", list(rows)))

    def clear(self):
        self._do(self.rows.clear())

    def appendValue(self, row):
        self._do(self.rows.append(row))

    def registerTimer(self, at):
        self._do(self.timers.add(at))

    def deleteTimer(self, at):
        self._do(self.timers.remove(at))


def test_one_call_takes_many_traces():
    """500 traces over three batches are sent as each by itself, with a handful of accesses to state a call."""
    import random

    import pandas as pd
    from pyspark.sql.types import BooleanType, LongType, StringType, StructType

    timing, draw = T.Timing(60, 2, 3), random.Random(5)
    schema = StructType().add("trace_id", StringType()).add("is_root", BooleanType()).add("at_ms", LongType()).add("event_id", LongType())
    records = sorted(((f"t{draw.randrange(500)}", draw.random() < 0.2, draw.randrange(300_000), i) for i in range(3000)), key=lambda r: r[2])

    def after(state, op, batch, watermark):
        clock = type("", (), {"getCurrentWatermarkInMs": lambda _: watermark})()
        out = list(op.handleInputRows((0,), iter([pd.DataFrame(batch, columns=schema.fieldNames())]), clock)) if batch else []
        for at in sorted(t for t in state.timers if t <= watermark):
            state.timers.discard(at)
            out += op.handleExpiredTimer((0,), clock, type("", (), {"getExpiryTimeInMs": lambda _, at=at: at})())
        return [tuple(r) for x in out for r in x.itertuples(index=False)]

    def run(of):
        state, op = _Kept(), assembly.Assembler(schema, timing, True)
        op.init(state)
        got, before = [], 0
        for end in (100_000, 200_000, 300_000, 10**9):
            got += after(state, op, [r for r in of if before <= r[2] < end], end)
            before = end
        return got, state

    together, state = run(records)
    apart = [x for t in {r[0] for r in records} for x in run([r for r in records if r[0] == t])[0]]
    assert sorted(together) == sorted(apart) and len(together) == len(records)
    assert {x[-2] for x in together} == {T.GOT_ROOT, T.LIMIT, T.EXPIRED, T.LATE} and state.n < 60 and not state.rows
    # by rule: the first arrival's timeout, the first root's delay and the record after the limit, whichever comes first
    for t in {r[0] for r in records}:
        own = [r for r in records if r[0] == t]
        send_by = min([own[0][2] + 60_000, *[r[2] + 2000 for r in own if r[1]][:1], *[r[2] for r in own[3:4]]])
        assert {(x[3], x[4], x[6]) for x in together if x[0] == t} == {(r[3], send_by, r[2] > send_by) for r in own}
