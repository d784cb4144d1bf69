"""Rules, decisions and what is done with kept spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.operators import samplers as S
from tracesift.operators.conditions import Condition
from tracesift.operators.rules import Rule, RuleSet
from tracesift.plans import decide as D
from tracesift.sources.spans import EVENTS, LINES, event_spans, line_spans

C = Condition.of
RETURNED, LARGE = C("flag", "=", "R"), C("quantity", ">", 45)


def draw(rate, salt: str = "rules", trace: str = "trace_id") -> str:
    """SQL of the deterministic draw; ``rate``: a number or a column."""
    return f"(CAST('0x' || substr(sha1({trace} || '{salt}'), 1, 8) AS BIGINT) <= 4294967295 // {rate})"


SALT = "5VQ8l2jE5aJLPVqk"
_SHAPE = "trace_id, n_descendants, rate, keep, reason"


def _decided(rules: RuleSet):
    return lambda spark, sf_dir: D.decide(line_spans(spark, sf_dir), rules).select(*_SHAPE.split(", "))


def _cases(*cases: tuple[str, object, str, str]) -> str:
    """SQL of decisions: (predicate over aggregates, rate, keep, reason), first match wins."""
    pick = lambda k: " ".join(f"WHEN {c[0]} THEN {c[k]}" for c in cases)
    return f"""WITH {LINES}, t AS (SELECT trace_id, count(*) AS n_descendants, bool_or(is_root) AS has_root, bool_or(flag = 'R') AS a, bool_or(quantity > 45) AS b,
  bool_or(flag = 'R' AND quantity > 45) AS ab, coalesce(bool_or(depot = '7'), false) AS d FROM l GROUP BY trace_id)
SELECT trace_id, n_descendants, CAST(CASE {pick(1)} ELSE 1 END AS BIGINT) AS rate, CASE {pick(2)} ELSE true END AS keep, CASE {pick(3)} ELSE 'no rule matched' END AS reason FROM t"""


FLAGSHIP = RuleSet(
    (
        Rule("rootless", (C(None, "has-root-span", False), C("?.NUM_DESCENDANTS", "<", 3, "int")), drop=True),
        Rule("returned and large", (RETURNED, LARGE), 1, scope="span"),
        Rule("depot", (C("depot", "=", "7"),), 5),
        Rule("rest", None, sampler=S.Deterministic(10)),
    )
)
FLAGSHIP_CASES = (
    ("NOT has_root AND n_descendants < 3", 0, "false", "'rules/trace/rootless'"),
    ("ab", 1, "true", "'rules/span/returned and large'"),
    ("d", 5, draw(5), "'rules/trace/depot'"),
    ("true", 10, draw(10, SALT), "'rules/trace/rest:deterministic/chance'"),
)


def flagship(spark, sf_dir):
    """Kept spans with their final rates."""
    s = line_spans(spark, sf_dir)
    out = D.kept(s, D.decide(s, FLAGSHIP), D.Decoration(counts_on_root=False, span_count_on_root=True))
    return out.select("trace_id", "line", "part", "supplier", F.date_format("ts", "yyyy-MM-dd").alias("day"), "final_sample_rate", "meta_reason", "meta_span_count")


def _kept(d: D.Decoration, columns: list[str], rules=RuleSet((Rule("purchases", (C("type", "=", "purchase"),), 2), Rule("rest", None, sampler=S.Deterministic(4)))), late=None):
    def run(spark, sf_dir):
        s = event_spans(spark, sf_dir)
        decisions = D.decide(s, rules, extra=D.counts(), reads=("annotation",))
        return D.kept(s, decisions, d).select("event_id", "trace_id", *columns)

    return run


_EVENT_DECISIONS = f"""WITH {EVENTS}, t AS (SELECT trace_id, count(*) AS n, bool_or(type = 'purchase') AS p, count(*) FILTER (annotation = 'span_event') AS ne,
  count(*) FILTER (annotation = 'link') AS nl, count(*) FILTER (annotation NOT IN ('span_event', 'link')) AS ns FROM e GROUP BY trace_id),
d AS (SELECT *, CASE WHEN p THEN 2 ELSE 4 END AS rate, CASE WHEN p THEN {draw(2)} ELSE {draw(4, SALT)} END AS keep,
  CASE WHEN p THEN 'rules/trace/purchases' ELSE 'rules/trace/rest:deterministic/chance' END AS reason FROM t)
SELECT event_id, trace_id, """
_RATES = "CAST(CASE WHEN sample_rate > 0 THEN sample_rate END AS BIGINT) AS original_sample_rate"


def _dynamic_reasons(spark, sf_dir):
    rules = RuleSet((Rule("purchases", (C("type", "=", "purchase"),), sampler=S.Dynamic(3, ("type",), 86400)), Rule("others", None, 2)))
    s = event_spans(spark, sf_dir)
    return D.decide(s, rules).select("trace_id", "n_descendants", "reason", "sample_key")


QUERIES = {
    "rule_trace_scope": (_decided(RuleSet((Rule("x", (RETURNED, LARGE), 4),))), _cases(("a AND b", 4, draw(4), "'rules/trace/x'"))),
    "rule_span_scope": (_decided(RuleSet((Rule("x", (RETURNED, LARGE), 4, scope="span"),))), _cases(("ab", 4, draw(4), "'rules/span/x'"))),
    "rule_first_match": (
        _decided(RuleSet((Rule("one", (LARGE,), 3), Rule("two", (RETURNED,), 2), Rule("three", None, 7)))),
        _cases(("b", 3, draw(3), "'rules/trace/one'"), ("a", 2, draw(2), "'rules/trace/two'"), ("true", 7, draw(7), "'rules/trace/three'")),
    ),
    "rule_drop": (_decided(RuleSet((Rule("gone", (LARGE,), 5, drop=True), Rule("zero", (RETURNED,), 0)))), _cases(("b", 5, "false", "'rules/trace/gone'"), ("a", 0, "false", "'rules/trace/zero'"))),
    "rule_no_match": (_decided(RuleSet((Rule("none", (C("flag", "=", "?"),), 5),))), _cases(("false", 1, "true", "''"))),
    "rule_invalid_scope": (_decided(RuleSet((Rule("odd", (C("flag", "=", "?"),), 1, scope="tree"),))), _cases(("true", 1, "true", "'rules/invalid scope/odd'"))),
    "rule_no_conditions": (_decided(RuleSet((Rule("all", None, 1),))), _cases(("true", 1, "true", "'rules/trace/all'"))),
    "rule_has_root_in_span_scope": (_decided(RuleSet((Rule("never", (C(None, "has-root-span", True),), 9, scope="span"),))), _cases(("false", 1, "true", "''"))),
    "rule_downstream": (_decided(RuleSet((Rule("down", (LARGE,), 1, sampler=S.Deterministic(10)), Rule("always", None, 1, sampler=S.Deterministic(1))))), _cases(("b", 10, draw(10, SALT), "'rules/trace/down:deterministic/chance'"), ("true", 1, "true", "'rules/trace/always:deterministic/always'"))),
    "rule_reason_dynamic": (
        _dynamic_reasons,
        f"""WITH {EVENTS}, t AS (SELECT trace_id, count(*) AS n_descendants, bool_or(type = 'purchase') AS p, array_to_string(list_sort(list(DISTINCT type)), '•') || '•,' AS k FROM e GROUP BY trace_id)
SELECT trace_id, n_descendants, CASE WHEN p THEN 'rules/trace/purchases:dynamic' ELSE 'rules/trace/others' END AS reason, CASE WHEN p THEN k ELSE '' END AS sample_key FROM t""",
    ),
    "decisions": (_decided(FLAGSHIP), _cases(*FLAGSHIP_CASES)),
    "kept_spans": (
        flagship,
        f"WITH d AS ({_cases(*FLAGSHIP_CASES)}), {LINES} SELECT l.trace_id, line, part, supplier, strftime(ts, '%Y-%m-%d') AS day, rate AS final_sample_rate, reason AS meta_reason, CASE WHEN is_root THEN n_descendants END AS meta_span_count FROM l JOIN d USING (trace_id) WHERE keep",
    ),
    "kept_deterministic": (
        lambda spark, sf_dir: D.kept_deterministic(line_spans(spark, sf_dir), 10).groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("part").alias("parts")),
        f"WITH {LINES} SELECT trace_id, count(*) AS n, CAST(sum(part) AS BIGINT) AS parts FROM l WHERE {draw(10, SALT)} GROUP BY trace_id",
    ),
    "root_counts": (
        _kept(D.Decoration(reasons=False), ["meta_span_event_count", "meta_span_link_count", "meta_span_count", "meta_event_count"]),
        _EVENT_DECISIONS + "CASE WHEN is_root THEN ne END AS meta_span_event_count, CASE WHEN is_root THEN nl END AS meta_span_link_count, CASE WHEN is_root THEN ns END AS meta_span_count, CASE WHEN is_root THEN n END AS meta_event_count FROM e JOIN d USING (trace_id) WHERE keep",
    ),
    "rate_merge": (
        _kept(D.Decoration(), ["original_sample_rate", "final_sample_rate", "out_sample_rate"]),
        _EVENT_DECISIONS + f"{_RATES}, greatest(sample_rate, 1) * rate AS final_sample_rate, greatest(sample_rate, 1) * rate AS out_sample_rate FROM e JOIN d USING (trace_id) WHERE keep",
    ),
    "dry_run": (
        _kept(D.Decoration(dry_run=True), ["original_sample_rate", "final_sample_rate", "dryrun_sample_rate", "out_sample_rate", "meta_dryrun_kept"]),
        _EVENT_DECISIONS + f"{_RATES}, CAST(NULL AS BIGINT) AS final_sample_rate, greatest(sample_rate, 1) * rate AS dryrun_sample_rate, greatest(sample_rate, 1) AS out_sample_rate, keep AS meta_dryrun_kept FROM e JOIN d USING (trace_id)",
    ),
    "reasons": (
        _kept(D.Decoration(), ["meta_reason", "meta_sample_key"]),
        _EVENT_DECISIONS + "reason AS meta_reason, CAST(NULL AS VARCHAR) AS meta_sample_key FROM e JOIN d USING (trace_id) WHERE keep",
    ),
    "additional_attrs": (
        _kept(D.Decoration(host="node-1", attributes=(("cluster", "east"),)), ["meta_local_hostname", "cluster"]),
        _EVENT_DECISIONS + "'node-1' AS meta_local_hostname, 'east' AS cluster FROM e JOIN d USING (trace_id) WHERE keep",
    ),
    "estimated_population": (
        lambda spark, sf_dir: _kept(D.Decoration(), ["type", "final_sample_rate"])(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_kept"), F.sum("final_sample_rate").alias("n_estimated")),
        "SELECT type, count(*) AS n_kept, CAST(sum(rate) AS BIGINT) AS n_estimated FROM (" + _EVENT_DECISIONS + "type, greatest(sample_rate, 1) * rate AS rate FROM e JOIN d USING (trace_id) WHERE keep) GROUP BY type",
    ),
}
