"""Conditions on single values against a plain Python model of their meaning; patterns against RE2 itself; texts of numbers."""

import itertools
import operator
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracesift.functions import values as V
from tracesift.operators.conditions import Condition, ConditionError, check_pattern, compile_test

KINDS = {bool: "boolean", int: "long", float: "double", str: "string"}
ORDER = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
FIELDS = [7, -2, 0, 7.0, 6.5, -0.25, "7", "6.5", "07", "seven", "", "true", "t", "False", True, False]
RULES = [7, 6.5, 0, "7", "zebra", "T", True, False]


def text(x) -> str:
    return {True: "true", False: "false"}[x] if isinstance(x, bool) else f"{x:g}" if isinstance(x, float) else str(x)


def whole(x) -> int | None:
    if isinstance(x, bool) or isinstance(x, str) and not re.fullmatch(r"[+-]?\d+", x):
        return None
    return int(x)


def real(x) -> float | None:
    try:
        return None if isinstance(x, bool) else float(x)
    except ValueError:
        return None


def truth(x) -> bool:
    return text(x) in ("1", "t", "T", "TRUE", "true", "True")


CONVERT = {"string": text, "int": whole, "float": real, "bool": truth}


def model(datatype, x, op, y) -> bool | None:
    """What ``x op y`` should be; None where the condition can't be set up."""
    if op in ("in", "not-in"):
        known = [v for v in map(CONVERT[datatype or "string"], y) if v is not None]
        return (CONVERT[datatype or "string"](x) in known) == (op == "in")
    if datatype:
        if datatype == "bool" and op not in ("=", "!="):
            return None
        a, b = CONVERT[datatype](x), CONVERT[datatype](y)
        return None if b is None else a is not None and ORDER[op](a, b)
    if isinstance(x, str) != isinstance(y, str) or isinstance(x, bool) != isinstance(y, bool):
        return False
    return ORDER[op](x, y)


def test_comparisons_and_sets(spark):
    asked = [(Condition.of("f", op, y, t), x, want) for t, x, op, y in itertools.product(("", *CONVERT), FIELDS, ORDER, RULES) if (want := model(t, x, op, y)) is not None]
    lists = [list(s) for s in itertools.combinations([7, 6.5, "7", "zebra"], 2)]
    asked += [(Condition.of("f", op, y, t), x, model(t, x, op, y)) for t, x, op, y in itertools.product(("", "string", "int", "float"), FIELDS, ("in", "not-in"), lists)]
    wrong = []
    for i in range(0, len(asked), 250):
        part = asked[i : i + 250]
        # the values come from a row, so that nothing is folded away
        row = spark.range(1).select(*[F.when(F.col("id") >= 0, F.lit(x)).alias(f"v{k}") for k, (_, x, _) in enumerate(part)])
        got = row.select(*[F.coalesce(compile_test(c)(KINDS[type(x)], F.col(f"v{k}")), F.lit(False)).alias(f"r{k}") for k, (c, x, _) in enumerate(part)]).first()
        wrong += [(c, x, want) for k, (c, x, want) in enumerate(part) if got[k] != want]
    assert not wrong, wrong[:5]


PATTERNS = [
    r"\d+x", r"^\d+$", r"[[:alpha:]]+-", r"[^[:alpha:]_]", r"\p{L}\z", r"\pN", r"\p{Greek}+", r"(?P<word>o)p", r"(?i)straSSE", r"(?i:Q)r", r"q.r", r"(?s)q.r", r"q$", r"(?m)^r$", r"(?m)q$", r"\brow\b", r"\Bow",
    r"o{2,3}p", r"o{,2}", r"o{p", r"[o&&p]+", r"[]o]p", r"[^]o]p", r"[o\]p-]q", r"\Qo.p\E+", r"\x6f\x{1F680}?", r"\157", r"[\s\S]q", r"[^\S]q", r"\sq", r"\Dq", r"(?U)o+p", r"(|o)+p", r"[\d-q]", r"(?i)[k-m]", r"[à-ü]+", r"\v", r"\a", r"(?i-s)O.", r"#q", r"{", r"}q", r"\A\z", r"^$", r"(?m)^$", r"[\pL\d]+$", r"[^\pL]", r"[\PL]", r"^*o",
]
REFUSED = [r"o++", r"o**", r"*o", r"(o", r"o)", r"[p-o]", r"[o", r"\y", r"\8", r"(o)\1", r"(?=o)", r"(?!o)", r"(?<=o)p", r"(?<!o)p", r"(?>o)", r"(?P=word)", r"[[:letters:]]", r"\p{Martian}", r"o{1001}", r"o{3,2}", r"[o-\d]"]
TEXTS = ["", "o", "op", "oop", "ooop-", "12x", "34", "q\nr", "q\r\nr", "r\nq\n", "q\n", "straße", "STRASSE", "row boat", "crow", "o.p", "o.p.p", "]op", "o]pq", "-q", "o&p", "o🚀", "é à", "αβγ", " q", "\x0bq", "\tq", "o{p", "o{,2}", "kK", "ſ", "Qr", "#q", "{", "}q", "Op", "5-q", "_", "\x07", "op\n\nqr"]


def test_patterns_are_those_of_re2(spark):
    con = duckdb.connect()  # its patterns are RE2's
    want = {p: [r[0] for r in con.execute("SELECT regexp_matches(t, ?) FROM (SELECT unnest(?) AS t)", [p, TEXTS]).fetchall()] for p in PATTERNS}
    tests = [compile_test(Condition.of("f", "matches", p))("string", F.col("t")).alias(f"c{k}") for k, p in enumerate(PATTERNS)]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", *tests).orderBy("i").collect()
    assert [(p, [x for x, r, w in zip(TEXTS, rows, want[p], strict=True) if r[k + 1] != w]) for k, p in enumerate(PATTERNS)] == [(p, []) for p in PATTERNS]
    for p in REFUSED:
        with pytest.raises(duckdb.Error):
            con.execute("SELECT regexp_matches('o', ?)", [p]).fetchall()
        with pytest.raises(ConditionError):
            check_pattern(p)
    check_pattern(r"(?<word>o)p")


@pytest.mark.parametrize("digits", ["1", "25", "7.5", "1.0625"])
def test_texts_of_numbers(spark, digits):
    """An exponent below 1e-4 and from 1e6 on, in conditions; never one in trace keys."""
    numbers = [float(f"{sign}{digits}e{e}") for e in range(-6, 20) for sign in ("", "-")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for x, general, fixed in df.select("x", V.text_general("double", F.col("x")), V.text_fixed("double", F.col("x"))).collect():
        small = 0 < abs(x) < 1e-4 or abs(x) >= 1e6
        assert float(general) == float(fixed) == x and ("e" in general) == small and "e" not in fixed.lower() and V.plain_text(x) == general
        assert not re.search(r"\.0*$|\.\d*0$", fixed) and not re.search(r"e[+-]\d$", general)


def test_bad_conditions():
    for bad in (Condition.of("f", "resembles", 1), Condition.of("f", "in", True), Condition.of("f", "in", [1], "bool"), Condition.of("f", "=", "x", "int"), Condition.of("f", "=", 1, "date"), Condition.of("f", "matches", "[q-")):
        with pytest.raises(ConditionError):
            compile_test(bad)
    with pytest.raises(ConditionError):
        Condition.of("a", "=", 1, fields=("b",))
