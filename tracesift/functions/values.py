"""Values of fields: kinds, text forms and conversions, all as built-in expressions.

A kind is ``long``, ``double``, ``string``, ``boolean`` or ``other``. Two text forms exist: ``text_general`` (shortest
digits, an exponent below 1e-4 and from 1e6 on) is used by conditions, and
``text_fixed`` (never an exponent) by trace keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "<nil>"

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(t: T.DataType) -> str:
    """Kind of a typed column."""
    if isinstance(t, INTEGERS):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.VariantType):
        return "variant"
    return "other"


def _special(x: Column, otherwise: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == F.lit(float("inf")), "+Inf").when(x == F.lit(float("-inf")), "-Inf").otherwise(otherwise)


def text_general(kind: str, x: Column) -> Column:
    """A value's default text: floats in the shortest form, as ``0.0001``, ``200``, ``1e+06``, ``1e-05``."""
    if kind != "double":
        return x.cast("string")
    x = x.cast("double")
    size, plain = F.abs(x), x.cast("string")
    whole = F.regexp_replace(plain, r"\.0$", "")
    # Spark's own exponent form: at least 1e7, or below 1e-3
    mantissa, power = F.regexp_extract(plain, r"^(-?[0-9.]+)E", 1), F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).cast("int")
    signed = F.concat(F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    exponent = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), signed)
    # seven digits before the point: Spark writes them out
    digits = F.regexp_replace(F.regexp_replace(plain, r"[-.]", ""), "0+$", "")
    seven = F.concat(F.when(x < 0, "-").otherwise(""), F.substring(digits, 1, 1), F.when(F.length(digits) > 1, ".").otherwise(""), F.substring(digits, 2, 400), F.lit("e+06"))
    small = F.regexp_replace(x.cast("decimal(38,24)").cast("string"), "0+$", "")
    return _special(x, F.when(size == 0, F.when(plain == "-0.0", "-0").otherwise("0")).when((size >= 1e6) & (size < 1e7), seven).when((size >= 1e-4) & (size < 1e-3), small).when((size >= 1e7) | (size < 1e-4), exponent).otherwise(whole))


def text_fixed(kind: str, x: Column) -> Column:
    """A value's text in a trace key: floats without an exponent."""
    if kind != "double":
        return x.cast("string")
    x = x.cast("double")
    plain = x.cast("string")
    wide = F.when(F.abs(x) >= 1e15, F.format_string("%.0f", x)).otherwise(F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"\.?0+$", ""))
    return _special(x, F.when(plain.contains("E"), wide).otherwise(F.regexp_replace(plain, r"\.0$", "")))


def to_long(kind: str, x: Column) -> Column:
    """Integer of a number (floats are cut), or of a string that is one; null otherwise."""
    if kind == "long":
        return x.cast("long")
    if kind == "double":
        return F.when(~F.isnan(x), x.try_cast("long"))
    if kind == "string":
        return F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long"))
    return F.lit(None).cast("long")


def to_double(kind: str, x: Column) -> Column:
    """Float of a number, or of a string that is one; null otherwise."""
    if kind in ("long", "double"):
        return x.cast("double")
    if kind == "string":
        return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), x.try_cast("double")).when(F.lower(x).isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(F.lower(x).isin("-inf", "-infinity"), float("-inf")).when(F.lower(x) == "nan", float("nan"))
    return F.lit(None).cast("double")


#: Texts that are true.
TRUE_TEXTS = ("1", "t", "T", "TRUE", "true", "True")


def to_boolean(kind: str, x: Column) -> Column:
    """Whether a value's text says true; anything unreadable is false."""
    return F.coalesce(text_general(kind, x).isin(*TRUE_TEXTS), F.lit(False))


def plain_text(value) -> str:
    """``text_general`` of a Python value, for rule values."""
    if value is None:
        return MISSING
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "+Inf" if value > 0 else "-Inf"
        text = repr(value)
        mantissa, _, power = text.partition("e")
        if not power and 1e6 <= abs(value):
            digits = mantissa.replace("-", "").replace(".0", "") if mantissa.endswith(".0") else mantissa.replace("-", "")
            left = len(digits.partition(".")[0])
            digits = digits.replace(".", "").rstrip("0")
            mantissa, power = ("-" if value < 0 else "") + digits[0] + ("." + digits[1:] if digits[1:] else ""), str(left - 1)
        if not power:
            return mantissa.removesuffix(".0")
        return f"{mantissa.removesuffix('.0')}e{'-' if power.startswith('-') else '+'}{power.lstrip('+-').zfill(2)}"
    return str(value)


def plain_long(value) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value)
    if isinstance(value, str):
        try:
            return int(value) if value.strip() == value and "_" not in value else None
        except ValueError:
            return None
    return None


def plain_double(value) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str):
        try:
            return float(value) if value.strip() == value and "_" not in value else None
        except ValueError:
            return None
    return None


def plain_boolean(value) -> bool:
    return plain_text(value) in TRUE_TEXTS
