"""Conditions of the rules language, compiled to boolean columns.

A condition reads the first existing of its fields, in order. ``root.`` fields read the trace's root record and are skipped
when there is none. Missing fields count differently by operator, so every case compiles to a column that is never null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions import re2
from tracesift.functions import values as V

ROOT = "root."
COMPUTED = "?."
DESCENDANTS = "?.NUM_DESCENDANTS"
ORDER = ("=", "!=", "<", "<=", ">", ">=")
TEXT = ("starts-with", "contains", "does-not-contain")
OPERATORS = (*ORDER, *TEXT, "exists", "not-exists", "in", "not-in", "matches", "has-root-span")
DATATYPES = ("", "string", "int", "float", "bool")


class ConditionError(ValueError):
    """A condition that can't be set up. Such a condition is compared without a datatype, as far as that goes."""


@dataclass(frozen=True)
class Condition:
    operator: str
    value: object = None
    fields: tuple[str, ...] = ()
    datatype: str = ""
    computed: bool = False  # a computed field counts only where it's given as the one ``Field``

    @classmethod
    def of(cls, field: str | None = None, operator: str = "", value=None, datatype: str = "", fields=()) -> Condition:
        if field and fields:
            raise ConditionError("both Field and Fields are given")
        return cls(operator, value, (field,) if field else tuple(fields), datatype or "", bool(field) and field.startswith(COMPUTED))

    @property
    def only_root(self) -> bool:
        return bool(self.fields) and all(f.startswith(ROOT) for f in self.fields)


@dataclass(frozen=True)
class Field:
    """A field's place: its kind, its value and whether it exists (by default: isn't null)."""

    kind: str
    value: Column
    exists: Column = field(default=None)  # type: ignore[assignment]

    def there(self) -> Column:
        return self.value.isNotNull() if self.exists is None else self.exists


Test = Callable[[str, Column | None], Column]


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _untyped(op: str, value) -> Test:
    """Numbers compare with numbers, booleans with booleans, strings with strings; any other pair never matches."""

    def test(kind: str, x: Column | None) -> Column:
        if x is None:
            return F.lit(op == "not-exists")
        if op == "exists":
            return F.lit(True)
        if op not in ORDER:
            return F.lit(False)
        if value is None:
            return F.lit(op in ("!=", ">", ">="))
        if isinstance(value, bool):
            return _compare(op, x.cast("int"), F.lit(int(value))) if kind == "boolean" else F.lit(False)
        if isinstance(value, int):
            return _compare(op, x, F.lit(value).cast(kind)) if kind in ("long", "double") else F.lit(False)
        if isinstance(value, float):
            return _compare(op, x.cast("double"), F.lit(value)) if kind in ("long", "double") else F.lit(False)
        return _compare(op, x, F.lit(str(value))) if kind == "string" else F.lit(False)

    return test


def _set(values: list) -> list:
    return list(dict.fromkeys(values))


def compile_test(c: Condition) -> Test:
    """What the condition asks of a value (None: missing). Raises ConditionError where it can't be set up."""
    op, value, datatype = c.operator, c.value, c.datatype
    text = lambda kind, x: F.lit(V.MISSING) if x is None else V.text_general(kind, x)
    if op not in OPERATORS:
        raise ConditionError(f"unknown operator {op!r}")
    if op in ("exists", "not-exists"):
        return lambda kind, x: F.lit((x is not None) == (op == "exists"))
    if op == "has-root-span":
        return lambda kind, x: F.lit(False)
    if op in TEXT:
        wanted = V.plain_text(value)
        if op == "starts-with":
            return lambda kind, x: text(kind, x).startswith(wanted)
        found = lambda kind, x: text(kind, x).contains(wanted)
        return found if op == "contains" else lambda kind, x: ~found(kind, x)
    if op == "matches":
        pattern = check_pattern(V.plain_text(value))
        return lambda kind, x: text(kind, x).rlike(pattern)
    if op in ("in", "not-in"):
        if isinstance(value, (list, tuple)):
            given = list(value)
        elif isinstance(value, (str, float)) or isinstance(value, int) and not isinstance(value, bool):
            given = [value]
        else:
            raise ConditionError("the value must be a list of scalars")
        if datatype == "bool":
            raise ConditionError(f"{op} takes no boolean datatype")
        if datatype == "int":
            known = _set([n for n in map(V.plain_long, given) if n is not None])
            convert, make = V.to_long, lambda v: F.lit(v).cast("long")
        elif datatype == "float":
            known = _set([n for n in map(V.plain_double, given) if n is not None])
            convert, make = V.to_double, lambda v: F.lit(float(v))
        else:
            known = _set(list(map(V.plain_text, given)))
            convert, make = V.text_general, F.lit

        def inside(kind: str, x: Column | None) -> Column:
            if x is None:
                return F.lit(datatype in ("", "string") and V.MISSING in known)
            return F.coalesce(convert(kind, x).isin(*map(make, known)), F.lit(False)) if known else F.lit(False)

        return inside if op == "in" else lambda kind, x: ~inside(kind, x)
    if datatype == "string":
        wanted = V.plain_text(value)
        return lambda kind, x: _compare(op, text(kind, x), F.lit(wanted))
    if datatype == "int":
        if (wanted := V.plain_long(value)) is None:
            raise ConditionError(f"{value!r} is no integer")
        return lambda kind, x: F.lit(False) if x is None else _compare(op, V.to_long(kind, x), F.lit(wanted).cast("long"))
    if datatype == "float":
        if (wanted := V.plain_double(value)) is None:
            raise ConditionError(f"{value!r} is no number")
        return lambda kind, x: F.lit(False) if x is None else _compare(op, V.to_double(kind, x), F.lit(wanted))
    if datatype == "bool" and op in ("=", "!="):
        wanted = V.plain_boolean(value)
        return lambda kind, x: F.lit(False) if x is None else _compare(op, V.to_boolean(kind, x), F.lit(wanted))
    if datatype not in DATATYPES:
        raise ConditionError(f"datatype {datatype!r} is none of string, int, float, bool")
    return _untyped(op, value)


def check_pattern(pattern: str) -> str:
    """The pattern for Spark's engine. Raises ConditionError for what isn't in RE2's syntax."""
    try:
        translated = re2.java(pattern)
    except re2.PatternError as e:
        raise ConditionError(str(e)) from e
    if (session := SparkContext._active_spark_context) is not None:  # names of Unicode classes are known to the engine alone
        try:
            session._jvm.java.util.regex.Pattern.compile(translated)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise ConditionError(f"bad pattern {pattern!r}") from e
    return translated


#: Variant types by kind. Numbers of JSON are floats.
_VARIANT = (("STRING", "string", "string"), ("BOOLEAN", "boolean", "boolean"), ("BIGINT", "double", "double"), ("DOUBLE", "double", "double"), ("DECIMAL", "double", "double"))


def on_field(f: Field, test: Test) -> Column:
    """The test on a field that exists; a variant's kind is found at run time."""
    if f.kind != "variant":
        return test(f.kind, f.value)
    shape, out = F.schema_of_variant(f.value), F.when(F.is_variant_null(f.value), test("other", F.lit(V.MISSING)))
    for name, kind, cast in _VARIANT:
        out = out.when(shape.startswith(name), test(kind, F.try_variant_get(f.value, "$", cast)))
    return out.otherwise(test("other", F.to_json(f.value)))


def evaluate(c: Condition, resolve: Callable[[str], Field | None], nested: Callable[[str], Column] | None = None) -> Column:
    """The condition on one record. ``resolve`` gives a field's place, or None for one that no record has.

    ``nested``: for schemaless payloads, the text at a nested path; used where none of the fields exists."""
    try:
        test = compile_test(c)
    except ConditionError:
        test = _untyped(c.operator, c.value)
    out = None
    for name in c.fields:
        place = resolve(name)
        if place is not None:
            there = place.there()
            out = F.when(there, on_field(place, test)) if out is None else out.when(there, on_field(place, test))
    if nested is not None:
        for name in c.fields:
            path = nested(name)
            out = F.when(path.isNotNull(), test("string", path)) if out is None else out.when(path.isNotNull(), test("string", path))
    missing = test("other", None)
    return F.coalesce(missing if out is None else out.otherwise(missing), F.lit(False))
