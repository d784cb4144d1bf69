"""Ordered rules over traces, and what evaluating them asks of a trace.

Every condition becomes one mergeable ``bool_or`` over the trace's records, so a set of rules costs one hash aggregation by
trace id. Conditions on the root, the number of records or the root's presence are evaluated once per trace, after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.functions import values as V
from tracesift.operators.conditions import DESCENDANTS, ROOT, Condition, Field, evaluate
from tracesift.sources.spans import Spans, json_path, member


@dataclass(frozen=True)
class Rule:
    """``conditions`` None: matches every trace. ``sampler``: a downstream sampler of tracesift.operators.samplers."""

    name: str
    conditions: tuple[Condition, ...] | None = None
    sample_rate: int = 0
    drop: bool = False
    scope: str = "trace"
    sampler: object = None

    @property
    def tag(self) -> str:
        return {"span": "rules/span/", "trace": "rules/trace/", "": "rules/trace/"}.get(self.scope, "rules/invalid scope/")


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    nested: bool = False

    def fields(self) -> set[str]:
        """All fields that conditions and downstream samplers read."""
        own = {f for r in self.rules for c in r.conditions or () for f in c.fields if not c.computed}
        return own | {f for r in self.rules if r.sampler is not None for f in getattr(r.sampler, "fields", ())}


def root_of(spans: Spans, fields: list[str]) -> Column:
    """Aggregate: the last root to arrive, as a struct of ``fields`` (null without a root)."""
    return F.max_by(F.struct(F.lit(True).alias("there"), *[F.col(f"`{f}`") for f in fields]), F.when(F.col("is_root"), F.col("arrival")))


def _late(c: Condition) -> bool:
    """Whether a condition has one answer for the whole trace."""
    return c.operator == "has-root-span" or c.computed or c.only_root


def matches(spans: Spans, rules: RuleSet, extra: list[Column] = ()) -> DataFrame:
    """One row a trace: trace_id, n_descendants, has_root, ``rule`` (index of the first matching rule, null: none), ``extra`` aggregates."""
    wanted = rules.fields()
    s = spans
    names = s.names()
    rooted = [n for n in sorted({f.removeprefix(ROOT) for f in wanted if f.startswith(ROOT)}) if n in names or s.payload]
    typed = [n for n in rooted if n in names]
    carried = typed + ([s.payload] if s.payload and len(typed) < len(rooted) else [])
    conditions = [(i, j, c) for i, r in enumerate(rules.rules) for j, c in enumerate(r.conditions or ())]
    mixed = any(not _late(c) and any(f.startswith(ROOT) for f in c.fields) for _, _, c in conditions) or (rules.nested and bool(rooted))
    df = s.df
    root = F.struct(F.lit(True).alias("there"), *[F.col(f"`{f}`") for f in carried])
    if mixed:  # some condition looks at a record and the root at once
        df = df.withColumn("_root", F.max_by(root, F.when(F.col("is_root"), F.col("arrival"))).over(Window.partitionBy("trace_id")))

    def resolver(at: str):
        def resolve(name: str) -> Field | None:
            if not name.startswith(ROOT):
                return s.field(name) if at == "_root" else None
            own = name.removeprefix(ROOT)
            if own in typed:
                return Field(s.field(own).kind, F.col(f"{at}.`{own}`"))
            if s.payload and s.payload in carried:
                return Field("variant", member(F.col(f"{at}.`{s.payload}`"), own))
            return None

        return resolve

    def nested(c: Condition):
        """Nested paths are looked up in the record that the last field read."""
        if not (rules.nested and s.payload):
            return None
        if c.fields and c.fields[-1].startswith(ROOT):
            text = F.coalesce(F.to_json(F.col(f"_root.`{s.payload}`")), F.to_json(F.col(s.payload))) if s.payload in carried else F.to_json(F.col(s.payload))
            return lambda path: F.get_json_object(text, json_path(path))
        return s.nested

    early, late = {}, {}
    for i, j, c in conditions:
        if c.operator == "has-root-span":
            late[i, j] = F.lit(False) if rules.rules[i].scope == "span" else F.col("has_root") == F.lit(V.plain_boolean(c.value))
        elif c.computed:
            there = Field("long", F.col("n_descendants")) if c.fields[0] == DESCENDANTS else None
            late[i, j] = evaluate(c, lambda name, there=there: there)
        elif c.only_root and not (rules.nested and s.payload):
            late[i, j] = evaluate(c, resolver("root"))
        else:
            early[i, j] = evaluate(c, resolver("_root"), nested(c))
    found = []
    for i, r in enumerate(rules.rules):
        own = {j: early[i, j] for j in range(len(r.conditions or ())) if (i, j) in early}
        if r.scope == "span" and own:
            every = None
            for t in own.values():
                every = t if every is None else every & t
            found.append(F.bool_or(every).alias(f"r{i}"))
        else:
            found += [F.bool_or(t).alias(f"c{i}_{j}") for j, t in own.items()]
    traces = df.groupBy("trace_id").agg(F.count("*").alias("n_descendants"), F.coalesce(F.bool_or("is_root"), F.lit(False)).alias("has_root"), root_of(spans, carried).alias("root"), *found, *extra)
    rule = F.lit(None).cast("int")
    for i in reversed(range(len(rules.rules))):
        r = rules.rules[i]
        hit = F.lit(True)
        if r.tag != "rules/invalid scope/" and r.conditions is not None:
            own = [j for j in range(len(r.conditions)) if (i, j) in early]
            for j in range(len(r.conditions)):
                if (i, j) in late:
                    hit = hit & late[i, j]
                elif r.scope != "span":
                    hit = hit & F.coalesce(f"c{i}_{j}", F.lit(False))
            if r.scope == "span" and own:
                hit = hit & F.coalesce(f"r{i}", F.lit(False))
        rule = F.when(hit, F.lit(i)).otherwise(rule)
    traces = traces.withColumn("rule", rule)
    return traces.drop(*[f"r{i}" for i in range(len(rules.rules))], *[f"c{i}_{j}" for i, j in early])
