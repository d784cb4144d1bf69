"""Conditions, one query for each operator and datatype: which traces have a matching record."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.operators.conditions import Condition
from tracesift.operators.rules import Rule, RuleSet, matches
from tracesift.sources.spans import EVENTS, LINES, Spans, event_spans, line_spans


def text(column: str) -> str:
    """SQL of a number's text."""
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


def _query(condition: Condition, spans=line_spans, nested: bool = False):
    def run(spark, sf_dir):
        s = spans(spark, sf_dir)
        rules = RuleSet((Rule("r", (condition,), 1),), nested)
        found = matches(s.narrowed(rules.fields()) if not s.payload else s, rules)
        return found.select("trace_id", F.col("rule").isNotNull().alias("matched"))

    return run


def _sql(predicate: str) -> str:
    return f"WITH {LINES} SELECT trace_id, coalesce(bool_or({predicate}), false) AS matched FROM l GROUP BY trace_id"


def _root_sql(predicate: str) -> str:
    """``predicate`` over columns of ``l`` and root_flag, root_depot, has_root, n of its trace."""
    return f"""WITH {LINES}, r AS (SELECT trace_id, count(*) AS n, bool_or(is_root) AS has_root, arg_max(flag, arrival) FILTER (is_root) AS root_flag,
  arg_max_null(depot, arrival) FILTER (is_root) AS root_depot FROM l GROUP BY trace_id)
SELECT trace_id, coalesce(bool_or({predicate}), false) AS matched FROM l JOIN r USING (trace_id) GROUP BY trace_id"""


def payload_events(spark, sf_dir) -> Spans:
    """Events whose fields are a schemaless payload."""
    s = event_spans(spark, sf_dir)
    body = F.to_json(F.struct(F.col("type").alias("event.type"), F.col("k"), F.struct(F.col("k").alias("inner"), F.col("type")).alias("attrs")))
    return Spans(s.df.select("trace_id", "is_root", "arrival", F.parse_json(body).alias("payload")), "payload")


C = Condition.of
SIMPLE = {
    "cond_eq_untyped": (C("flag", "=", "R"), "flag = 'R'"),
    "cond_ne_untyped": (C("depot", "!=", "5"), "depot <> '5'"),
    "cond_ne_mismatch": (C("flag", "!=", 5), "false"),
    "cond_lt_untyped": (C("quantity", "<", 10), "quantity < 10"),
    "cond_le_untyped": (C("line", "<=", 2.5), "line <= 2.5"),
    "cond_gt_untyped": (C("quantity", ">", 45), "quantity > 45"),
    "cond_ge_untyped": (C("discount", ">=", 0.09), "discount >= CAST(0.09 AS DOUBLE)"),
    "cond_bool_untyped": (C("bulky", "=", True), "bulky"),
    "cond_nil_untyped": (C("depot", ">", None), "depot IS NOT NULL"),
    "cond_eq_string": (C("quantity", "=", 45, "string"), f"{text('quantity')} = '45'"),
    "cond_ne_string": (C("depot", "!=", "5", "string"), "coalesce(depot, '<nil>') <> '5'"),
    "cond_gt_string": (C("quantity", ">", "9", "string"), f"{text('quantity')} > '9'"),
    "cond_ge_string": (C("flag", ">=", "N", "string"), "flag >= 'N'"),
    "cond_lt_string": (C("depot", "<", "2", "string"), "coalesce(depot, '<nil>') < '2'"),
    "cond_le_string": (C("status", "<=", "F", "string"), "status <= 'F'"),
    "cond_eq_int": (C("quantity", "=", "45", "int"), "trunc(quantity) = 45"),
    "cond_ne_int": (C("depot", "!=", 5, "int"), "TRY_CAST(depot AS BIGINT) <> 5"),
    "cond_lt_int": (C("depot", "<", 50, "int"), "TRY_CAST(depot AS BIGINT) < 50"),
    "cond_le_int": (C("discount", "<=", 0, "int"), "trunc(discount) <= 0"),
    "cond_gt_int": (C("bulky", ">", 0, "int"), "false"),
    "cond_ge_int": (C("part", ">=", 100, "int"), "part >= 100"),
    "cond_eq_float": (C("discount", "=", "0.05", "float"), "discount = CAST(0.05 AS DOUBLE)"),
    "cond_ne_float": (C("tax", "!=", 0.02, "float"), "tax <> CAST(0.02 AS DOUBLE)"),
    "cond_lt_float": (C("line", "<", 1.5, "float"), "line < 1.5"),
    "cond_le_float": (C("depot", "<=", 4.13, "float"), "TRY_CAST(depot AS DOUBLE) <= 4.13"),
    "cond_gt_float": (C("depot", ">", 49.5, "float"), "TRY_CAST(depot AS DOUBLE) > 49.5"),
    "cond_ge_float": (C("flag", ">=", 0, "float"), "false"),
    "cond_eq_bool": (C("line", "=", True, "bool"), "line = 1"),
    "cond_ne_bool": (C("depot", "!=", "false", "bool"), "depot = '1'"),
    "cond_gt_bool": (C("bulky", ">", False, "bool"), "bulky"),
    "cond_starts_with": (C("depot", "starts-with", "1"), "starts_with(coalesce(depot, '<nil>'), '1')"),
    "cond_contains": (C("part", "contains", 99), "contains(CAST(part AS VARCHAR), '99')"),
    "cond_contains_missing": (C("depot", "contains", "nil"), "contains(coalesce(depot, '<nil>'), 'nil')"),
    "cond_does_not_contain": (C("depot", "does-not-contain", "1"), "NOT contains(coalesce(depot, '<nil>'), '1')"),
    "cond_exists": (C("depot", "exists"), "depot IS NOT NULL"),
    "cond_not_exists": (C("depot", "not-exists"), "depot IS NULL"),
    "cond_in_string": (C("quantity", "in", [1, 2, "3"]), f"{text('quantity')} IN ('1', '2', '3')"),
    "cond_in_int": (C("depot", "in", [1, "2", 3.7], "int"), "TRY_CAST(depot AS BIGINT) IN (1, 2, 3)"),
    "cond_in_float": (C("discount", "in", [0.05, "0.1"], "float"), "discount IN (CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE))"),
    "cond_in_scalar": (C("flag", "in", "R"), "flag = 'R'"),
    "cond_in_error": (C("bulky", "in", [True], "bool"), "false"),
    "cond_not_in": (C("depot", "not-in", [1, 2, 3], "int"), "coalesce(TRY_CAST(depot AS BIGINT) NOT IN (1, 2, 3), true)"),
    "cond_not_in_string": (C("flag", "not-in", ["R", "A"]), "flag NOT IN ('R', 'A')"),
    "cond_regex": (C("part", "matches", "^[1-3][0-9]$"), "regexp_matches(CAST(part AS VARCHAR), '^[1-3][0-9]$')"),
    "cond_regex_missing": (C("depot", "matches", "nil|9$"), "regexp_matches(coalesce(depot, '<nil>'), 'nil|9$')"),
    "cond_regex_invalid": (C("part", "matches", "[a-z+"), "false"),
    "cond_unknown_operator": (C("flag", "resembles", "R"), "false"),
    "cond_absent_field": (C("nowhere", "not-in", [1]), "true"),
    "cond_fields_order": (C(None, "=", "R", fields=("depot", "flag")), "CASE WHEN depot IS NOT NULL THEN depot = 'R' ELSE flag = 'R' END"),
}
ROOTED = {
    "cond_root_prefix": (C("root.flag", "=", "R"), "root_flag = 'R'"),
    "cond_root_not_exists": (C("root.depot", "not-exists"), "root_depot IS NULL"),
    "cond_fields_root_first": (C(None, "=", "R", fields=("root.flag", "flag")), "coalesce(root_flag, flag) = 'R'"),
    "cond_fields_root_last": (C(None, "=", "2", fields=("depot", "root.flag")), "coalesce(depot, root_flag) = '2'"),
    "cond_num_descendants": (C("?.NUM_DESCENDANTS", ">", 4, "int"), "n > 4"),
    "cond_num_descendants_in_fields": (C(None, ">", 4, "int", fields=("?.NUM_DESCENDANTS",)), "false"),
    "cond_has_root": (C(None, "has-root-span", True), "has_root"),
    "cond_has_no_root": (C(None, "has-root-span", False), "NOT has_root"),
}
_PAYLOAD = f"WITH {EVENTS} SELECT trace_id, coalesce(bool_or({{}}), false) AS matched FROM e GROUP BY trace_id"
QUERIES = (
    {n: (_query(c), _sql(p)) for n, (c, p) in SIMPLE.items()}
    | {n: (_query(c), _root_sql(p)) for n, (c, p) in ROOTED.items()}
    | {
        "cond_payload_number": (_query(C("k", ">", 500), payload_events), _PAYLOAD.format("k > 500")),
        "cond_payload_dotted": (_query(C("event.type", "=", "error"), payload_events), _PAYLOAD.format("type = 'error'")),
        "cond_payload_root": (_query(C("root.k", "exists"), payload_events), _PAYLOAD.format("is_root AND k IS NOT NULL")),
        "cond_nested": (_query(C("attrs.inner", "contains", "77"), payload_events, True), _PAYLOAD.format("contains(CAST(k AS VARCHAR), '77')")),
        "cond_nested_off": (_query(C("attrs.inner", "exists"), payload_events), _PAYLOAD.format("false")),
    }
)
