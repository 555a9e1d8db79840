"""Scalar semantics as Column expressions: three-valued logic, comparison, arithmetic, LIKE, casts, time.

All results are the same whether or not the session runs in ANSI mode: what may fail is written with try_
functions or an explicit CASE.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def null_bool() -> Column:
    return F.lit(None).cast("boolean")



def family(t: T.DataType) -> str:
    """Types of one family compare with each other; others give NULL."""
    if isinstance(t, NUMERIC) or isinstance(t, TIMES):
        return "number"
    for kind, name in ((T.StringType, "string"), (T.BooleanType, "bool"), (T.BinaryType, "bytes"), (T.ArrayType, "array"), (T.StructType, "document"), (T.MapType, "document"), (T.NullType, "null")):
        if isinstance(t, kind):
            return name
    return t.typeName()


def millis(c: Column, t: T.DataType) -> Column:
    """Epoch milliseconds of a timestamp; other values as they are."""
    return F.unix_millis(c.cast("timestamp")) if isinstance(t, TIMES) else c


def compare(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """= != < <= > >= with containment for array against scalar and NULL across families."""
    fa, fb = family(ta), family(tb)
    if "null" in (fa, fb):
        return null_bool()
    if fa == "array" and fb != "array":
        if op not in ("=", "!=") or family(ta.elementType) != fb:
            return null_bool()
        has = F.when(a.isNull() | b.isNull(), null_bool()).otherwise(F.coalesce(F.array_contains(a, b), F.lit(False)))
        return has if op == "=" else ~has
    if fa != fb:
        return null_bool()
    if fa == "number":
        a, b = millis(a, ta), millis(b, tb)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def is_in(a: Column, ta: T.DataType, items: list[tuple[Column, T.DataType]]) -> Column:
    """IN: true if any item equals, else NULL if any comparison is NULL, else false. An array matches by any element."""
    if isinstance(ta, T.ArrayType):
        tests = [compare("=", a, ta, c, t) for c, t in items]
    else:
        tests = [compare("=", a, ta, c, t) if not isinstance(t, T.ArrayType) else compare("=", c, t, a, ta) for c, t in items]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def arithmetic(op: str, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Integers stay integers and divide by truncation; anything else is double. By zero, and on overflow, NULL."""
    if family(ta) != "number" or family(tb) != "number":
        return F.lit(None).cast("double")
    if isinstance(ta, INTEGRAL) and isinstance(tb, INTEGRAL):
        a, b = a.cast("long"), b.cast("long")
        if op == "/":
            return F.when(b != 0, _div(a, b))
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    a, b = millis(a, ta).cast("double"), millis(b, tb).cast("double")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()


def _div(a: Column, b: Column) -> Column:
    """Exact truncating division of longs, without going through double; b is not 0."""
    safe = F.when(b == 0, F.lit(1).cast("long")).otherwise(b)
    whole = F.floor(F.abs(a.cast("decimal(20,0)")) / F.abs(safe.cast("decimal(20,0)")))
    return (whole * F.signum(a) * F.signum(safe)).try_cast("long")


def like(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE without an escape character: only % and _ are special, and a line break is an ordinary character."""
    regex = "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + "$"
    if ignore_case:
        return F.lower(value).rlike("(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()) + "\\z")
    simple = re.fullmatch(r"([^%_]*)(%?)", pattern)
    if simple and simple[2]:
        return value.startswith(simple[1])  # reaches the scan as a prefix filter
    if "%" not in pattern and "_" not in pattern:
        return value == pattern
    return value.rlike(regex[:-1] + "\\z")


def to_int(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        s = F.trim(c)
        return F.coalesce(s.try_cast("long"), s.try_cast("double").try_cast("long"))
    if isinstance(t, TIMES):
        return millis(c, t)
    return c.try_cast("long")


def to_float(c: Column, t: T.DataType) -> Column:
    d = millis(c, t).cast("double") if isinstance(t, TIMES) else (F.trim(c).try_cast("double") if isinstance(t, T.StringType) else c.try_cast("double"))
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None)).otherwise(d)


def to_bool(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, T.StringType):
        s = F.lower(F.trim(c))
        return F.when(s.isin("true", "t", "1"), True).when(s.isin("false", "f", "0"), False)
    return F.when(c.cast("double") == 0, False).when(c.isNotNull(), True)


def iso(ms: Column) -> Column:
    """An epoch-ms number as ISO 8601 in UTC; milliseconds only if there are any."""
    base = F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(ms, F.lit(1000))
    return F.when(part == 0, F.concat(base, F.lit("Z"))).otherwise(F.concat(base, F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("Z")))


def to_string(c: Column, t: T.DataType) -> Column:
    return iso(millis(c, t)) if isinstance(t, TIMES) else c.cast("string")


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:[0-5]\d|:60)?(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"


def to_timestamp(c: Column, t: T.DataType) -> Column:
    """An epoch-ms number or an ISO 8601 string as a timestamp, cut to milliseconds; NULL for anything else."""
    if isinstance(t, TIMES):
        return F.timestamp_millis(millis(c, t))
    if isinstance(t, NUMERIC):
        return F.timestamp_millis(c.cast("long"))
    if isinstance(t, T.StringType):
        parsed = F.when(c.rlike(_ISO), F.try_to_timestamp(c))
        return F.timestamp_millis(F.unix_millis(parsed))
    return F.lit(None).cast("timestamp")


STEPS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration(text: str | int) -> int:
    """`5m`, `1h` and so on as milliseconds."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d|w)", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * STEPS[m[2]]


def time_bucket(step: str | int, c: Column, t: T.DataType) -> Column:
    """The start of the step that a time lies in, counted from the epoch and rounded down; of the input's type."""
    ms = duration(step)
    if ms <= 0:
        raise ValueError("time_bucket needs a step above 0")
    if isinstance(t, TIMES):
        m = millis(c, t)
        return F.timestamp_millis(m - F.pmod(m, F.lit(ms))).cast(t)
    if isinstance(t, INTEGRAL):
        return c - F.pmod(c.cast("long"), F.lit(ms))
    if isinstance(t, NUMERIC):
        return c.cast("double") - F.pmod(c.cast("double"), F.lit(float(ms)))
    return F.lit(None).cast("long")


def coalesce(*columns: Column) -> Column:
    return F.coalesce(*columns)


# --- distances ---------------------------------------------------------------------------------------------

# Metres in each unit.
METRES = {
    "": 1.0, "m": 1.0, "meters": 1.0, "metres": 1.0, "km": 1000.0, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048,
    "in": 0.0254, "cm": 0.01, "mm": 0.001, "nm": 1852.0,
}


def distance(text: str | float) -> float:
    """`5km` and the like in metres."""
    if isinstance(text, (int, float)):
        return float(text)
    m = re.fullmatch(r"\s*([0-9.]+(?:e[+-]?\d+)?)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in METRES:
        raise ValueError(f"no distance: {text!r}")
    return float(m[1]) * METRES[m[2]]
