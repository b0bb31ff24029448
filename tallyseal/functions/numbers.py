"""Numbers as canonical text: no exponent, no trailing zeros, no signed zero."""

from __future__ import annotations

from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTEXT = Context(prec=28)


def number_text(x) -> str:
    """Shortest text of a Python number; 28 significant digits at most."""
    d = Decimal(repr(x) if isinstance(x, float) else str(x))
    if not d.is_finite():
        return "NaN" if d.is_nan() else ("Infinity" if d > 0 else "-Infinity")
    d = _CONTEXT.plus(d)
    if d == 0:
        return "0"
    text = format(d, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@F.arrow_udf(T.StringType())
def _double_text(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else number_text(x) for x in a.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _decimal_text(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else number_text(x) for x in a.to_pylist()], pa.string())


#: Decimal digits that every double of normal size tells apart: of all texts that short, one at most means a given double.
_SURE_DIGITS = 15
_SMALLEST_NORMAL = 2.2250738585072014e-308


def native_text(d: Column) -> Column:
    """Canonical text of a double in the JVM; null where only Python knows it.

    The JVM's text of a double means that double, but is not always the shortest one. Up to 15 digits there is no
    other text so short, so it is; doubles with longer texts and subnormal ones are left to Python.
    """
    text = d.cast("string")
    mantissa = F.substring_index(F.ltrim(text, F.lit("-")), "E", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"^0\.0*|\.", ""), "0+$", "")
    power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int"))
    moved = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    )
    shortest = F.when(power.isNull(), F.regexp_replace(text, r"\.?0+$", "")).otherwise(F.concat(F.when(d < 0, "-").otherwise(""), moved))
    whole = (F.floor(d) == d) & (F.abs(d) < F.lit(2.0**53))
    strange = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    sure = (F.length(digits) <= _SURE_DIGITS) & (F.abs(d) >= F.lit(_SMALLEST_NORMAL))
    return F.when(strange, text).when(whole, F.when(whole, d).cast("long").cast("string")).when(sure, shortest)


def canonical_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(kind, T.DecimalType):
        if kind.precision > 28:
            return _decimal_text(c)
        text = c.cast("string")
        if kind.scale > 0:
            text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(c == 0, "0").when(F.contains(text, F.lit("E")), _decimal_text(F.when(F.contains(text, F.lit("E")), c))).otherwise(text)
    d = c.cast("double")
    if isinstance(kind, T.FloatType):
        d = c.cast("string").cast("double")
    known = native_text(d)
    return F.coalesce(known, _double_text(F.when(known.isNull(), d)))


def money_text(c: Column) -> Column:
    """Native text of doubles with few decimals, for columns known to be such (amounts below 2^53 / 100)."""
    text = c.cast("string")
    return F.regexp_replace(text, r"\.0$", "")
