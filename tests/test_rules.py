"""Rules over small traces of schemaless records, and decisions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracesift.operators import samplers as S
from tracesift.operators.conditions import Condition
from tracesift.operators.rules import Rule, RuleSet
from tracesift.operators.tracekey import TraceKey
from tracesift.plans import decide as D
from tracesift.sources.spans import Spans

C = Condition.of
R = "root"


def spans(spark, traces):
    """``traces``: lists of records; a record marked with the key ``root`` is the root."""
    rows = [(str(t), r.get(R, False), i, json.dumps({k: v for k, v in r.items() if k != R})) for t, trace in enumerate(traces) for i, r in enumerate(trace)]
    df = spark.createDataFrame(rows, "trace_id string, is_root boolean, at int, body string")
    return Spans(df.select("trace_id", "is_root", F.struct("at").alias("arrival"), F.timestamp_seconds(F.col("at")).alias("ts"), F.parse_json("body").alias("payload")), "payload")


def rule(*conditions, rate=10, drop=False, scope="trace", name="x", sampler=None):
    return Rule(name, conditions or None, rate, drop, scope, sampler)


FIELDS, VALUES = ("colour", "depth", "root.colour", "root.size"), ("red", "blue", 3, 8)
NAME = "only"


def looked_up(record: dict, root: dict, fields: tuple) -> object:
    """The first of the fields that the record, or the root, has."""
    for f in fields:
        place = root if f.startswith("root.") else record
        if (f := f.removeprefix("root.")) in place:
            return place[f]
    return None


def holds(c: Condition, record: dict, root: dict) -> bool:
    value = looked_up(record, root, c.fields)
    if c.operator in ("exists", "not-exists"):
        return (value is not None) == (c.operator == "exists")
    if c.operator in ("starts-with", "contains", "does-not-contain"):
        seen = "<nil>" if value is None else str(value)
        return seen.startswith(c.value) if c.operator == "starts-with" else (c.value in seen) == (c.operator == "contains")
    same = value is not None and isinstance(value, str) == isinstance(c.value, str)
    return same and {"=": value == c.value, "!=": value != c.value, ">": same and value > c.value, "<=": same and value <= c.value}[c.operator]


def expected(rules: list[Rule], trace: list[dict]) -> tuple[int, str]:
    """The first rule that the trace meets: in one record for the span scope, else each condition in some record."""
    root = next((r for r in trace if r.get(R)), {})
    has = lambda c: bool(root) == c.value if c.operator == "has-root-span" else COUNTS[c.operator](len(trace), c.value) if c.computed else None
    for r in rules:
        # a record alone doesn't know of a root's presence
        late = [False if c.operator == "has-root-span" and r.scope == "span" else has(c) for c in r.conditions or ()]
        plain = [c for c, x in zip(r.conditions or (), late, strict=True) if x is None]
        if r.scope == "span":
            met = not plain or any(all(holds(c, x, root) for c in plain) for x in trace)
        else:
            met = all(any(holds(c, x, root) for x in trace) for c in plain)
        if met and all(x is not False for x in late):
            return r.sample_rate, f"rules/{r.scope}/{r.name}"
    return 1, "no rule matched"


COUNTS = {">": lambda n, v: n > v, "<=": lambda n, v: n <= v}


def invented(rng: random.Random) -> tuple[list[Rule], list[dict]]:
    def condition() -> Condition:
        kind = rng.random()
        if kind < 0.1:
            return C(None, "has-root-span", rng.random() < 0.5)
        if kind < 0.2:
            return C("?.NUM_DESCENDANTS", rng.choice([">", "<="]), rng.randint(1, 3))
        fields = tuple(rng.sample(FIELDS, rng.randint(1, 2)))
        op = rng.choice(["=", "!=", ">", "<=", "exists", "not-exists", "starts-with", "contains", "does-not-contain"])
        value = None if "exists" in op else rng.choice(["r", "lu", "3"]) if op in ("starts-with", "contains", "does-not-contain") else rng.choice(VALUES)
        return C(None, op, value, fields=fields)

    rules = [rule(*[condition() for _ in range(rng.randint(1, 2))], rate=rng.randint(2, 9), scope=rng.choice(["trace", "span"]), name=f"r{i}") for i in range(rng.randint(1, 3))]
    trace = [{f: rng.choice(VALUES) for f in ("colour", "depth", "size") if rng.random() < 0.6} for _ in range(rng.randint(1, 4))]
    if rng.random() < 0.6:
        trace[rng.randrange(len(trace))][R] = True
    return rules, trace


@pytest.mark.parametrize("seed", range(6))
def test_rules(spark, seed):
    """Invented rules on invented traces against the plain model; every seed takes many traces at once."""
    rng = random.Random(seed)
    for _ in range(4):
        rules, _ = invented(rng)
        traces = [invented(rng)[1] for _ in range(60)]
        got = {r.trace_id: (r.rate, r.reason) for r in D.decide(spans(spark, traces), RuleSet(tuple(rules))).collect()}
        want = {str(i): expected(rules, t) for i, t in enumerate(traces)}
        assert {i: (want[i], traces[int(i)]) for i in want if want[i] != got[i]} == {}, rules


def test_drops_invalid_scopes_and_downstream_samplers(spark):
    ask = lambda *rules: D.decide(spans(spark, [[{"depth": 8}]]), RuleSet(tuple(rules))).first()
    dropped = ask(rule(C("depth", "=", 8), rate=0, drop=True, name=NAME))
    assert (dropped.rate, dropped.keep, dropped.reason) == (0, False, "rules/trace/only")
    assert ask(rule(rate=3, scope="forest", name=NAME)).reason == "rules/invalid scope/only"
    assert ask(rule(C("depth", "exists"), sampler=S.Deterministic(1), name=NAME)).reason == "rules/trace/only:deterministic/always"
    assert ask(rule(C("depth", "matches", "^[0-9]$"), name=NAME)).reason == "rules/trace/only"


@pytest.mark.parametrize("name", ["it's", 'say "so"', "back\\slash", "dotted.name", "a b"])
def test_names_with_any_sign(spark, name):
    for nested in (False, True):
        assert D.decide(spans(spark, [[{name: "v"}]]), RuleSet((rule(C(name, "=", "v"), name=NAME),), nested)).first().reason == "rules/trace/only"
        assert D.decide(spans(spark, [[{R: True, name: "v"}]]), RuleSet((rule(C(f"root.{name}", "=", "v"), name=NAME),), nested)).first().reason == "rules/trace/only"


@pytest.mark.parametrize("path,record,nested,found", [(p, r, n, n and "." in p or p in r) for p, r in [("outer.inner", {"outer": {"inner": "v"}}), ("outer.inner", {"outer.inner": "v"}), ("plain", {"plain": "v"})] for n in (True, False)])
def test_nested(spark, path, record, nested, found):
    assert (D.decide(spans(spark, [[record]]), RuleSet((rule(C(path, "=", "v")),), nested)).first().rate == 10) == found


def test_deterministic(spark):
    """One in ten of many ids, the same ones each time, and all at a rate of 1."""
    df = spark.range(20_000).select(F.concat(F.lit("id"), F.col("id").cast("string")).alias("t"))
    kept = {r.t for r in df.where(S.Deterministic(10).decide(F.col("t"))[1]).collect()}
    assert 1800 < len(kept) < 2200 and kept == {r.t for r in df.repartition(3).where(S.Deterministic(10).decide(F.col("t"))[1]).collect()}
    assert df.where(S.Deterministic(1).decide(F.col("t"))[1]).count() == 20_000


def _typed(spark, records, schema):
    df = spark.createDataFrame([("t", r.pop(R, False), i, *(r.get(n.split()[0]) for n in schema.split(", "))) for i, r in enumerate(records)], "trace_id string, is_root boolean, at int, " + schema)
    return Spans(df.withColumn("arrival", F.struct("at")).drop("at"))


def _key(spark, records, schema, fields, by_arrival=True):
    s, key = _typed(spark, [dict(r) for r in records], schema), TraceKey(fields, True, by_arrival)
    t = s.df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), *key.aggregates(s, "k"))
    k, n = key.key(s, "k")
    return tuple(t.select(k.alias("k"), n.alias("n")).first())


def test_trace_keys(spark):
    """Fields in name order, each one's distinct values as sorted texts; then the root's; then the number of records."""
    rng = random.Random(11)
    for _ in range(4):
        records = [{"port": rng.choice([80, 443]), "share": rng.choice([0.5, 2.0]), "zone": rng.choice(["n", "s"]), "up": rng.random() < 0.5} for _ in range(rng.randint(1, 6))]
        root = rng.choice(records)
        root[R] = True
        text = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)
        parts = [sorted({text(r[f]) for r in records}) for f in ("port", "share", "up")]
        want = "".join("•".join(p) + "•," for p in parts) + f"{root['zone']}," + str(len(records))
        assert _key(spark, records, "port long, share double, zone string, up boolean", ("up", "root.zone", "share", "port")) == (want, sum(map(len, parts)) + 2)
    assert _key(spark, [{}, {}], "port long, zone string", ("port", "root.zone")) == ("2", 1)


def test_trace_keys_beyond_the_cap(spark):
    assert _key(spark, [{"a": i, "b": 1000 + i} for i in range(130)], "a long, b long", ("a", "b"))[1] == 100


def test_trace_keys_of_schemaless_roots(spark):
    s = spans(spark, [[{"a": 1, "deep": {"x": 2}, "r": 9}, {R: True, "a": 2.5, "r": "web", "big": 4000000, "flag": True, "none": None}]])
    key = TraceKey(("a", "root.r", "root.big", "root.flag", "root.none", "root.missing"))
    t = s.df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), *key.aggregates(s, "k"))
    k, n = key.key(s, "k")
    assert tuple(t.select(k, n).first()) == ("1•2.5•,4e+06,true,<nil>,web,", 6)


def test_rates_and_dry_run(spark):
    df = spark.createDataFrame([(50, 2), (0, 2), (0, 10), (10, 100)], "o long, r long")
    live = df.select(*[c.alias(n) for n, c in D.merged_rates(F.col("o"), F.col("r"), False).items()]).collect()
    assert [(r.original_sample_rate, r.final_sample_rate) for r in live] == [(50, 100), (None, 2), (None, 10), (10, 1000)]
    dry = df.select(*[c.alias(n) for n, c in D.merged_rates(F.col("o"), F.col("r"), True).items()]).collect()
    assert [(r.final_sample_rate, r.dryrun_sample_rate, r.out_sample_rate) for r in dry][2] == (None, 10, 1)


def test_decisions_scan_only_what_rules_read(spark, sf_dir):
    from tracesift.queries.decisions import FLAGSHIP
    from tracesift.sources.spans import line_spans

    plan = D.decide(line_spans(spark, sf_dir), FLAGSHIP)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "l_extendedprice" not in schema and "l_quantity" in schema
