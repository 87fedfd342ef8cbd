"""Numbers out of text, safe ratios and rounding, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.text import strip

_NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_INFINITE = r"^(?i)[+-]?inf(?:inity)?\z"


def rating_value(text: Column) -> Column:
    """First decimal number in the text as double, or null."""
    return F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def first_integer(text: Column, default: int = 0) -> Column:
    """First run of digits as bigint, or ``default`` where there is none.

    Null where the number is too large for bigint, so it doesn't pass for a missing one.
    """
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "([0-9]+)", 1)
    return F.when(found == "", F.lit(default).cast("bigint")).otherwise(found.try_cast("bigint"))


def price_value(text: Column) -> Column:
    """First number with optional thousands commas as double, or null."""
    found = F.regexp_extract(text.cast("string"), r"[0-9,]+\.?[0-9]*", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def numeric_or_null(text: Column) -> Column:
    """The whole text as a number, or null.

    The pattern guard keeps out forms that only Spark's cast accepts, such as ``12d``.
    """
    value = strip(text.cast("string"))
    accepted = value.rlike(_NUMERIC) | value.rlike(_INFINITE)
    return F.when(accepted, value.try_cast("double"))


def whole_number_or_null(text: Column) -> Column:
    """The text as a number cut towards zero; null if it is not finite or not a number."""
    return numeric_or_null(text).try_cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 where ``whole`` is 0 or null."""
    quotient = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(quotient, F.lit(0.0))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double to ``digits`` places, ties to even.

    ``round`` and ``bround`` both start from the shortest decimal text of the double, so
    they see 2.675 as a tie although the stored number lies below it. Here the product
    with the power of ten keeps its rounding error (an error-free product), and the
    error decides what looks like a tie.
    """
    scale = float(10**digits)
    scaled = value * F.lit(scale)
    spread = value * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = spread - (spread - value)
    low = value - high
    error = (high * F.lit(scale) - scaled) + low * F.lit(scale)
    base = F.floor(scaled).cast("double")
    rest = scaled - base
    up = (rest > 0.5) | (
        (rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(base, F.lit(2.0)) == 1.0)))
    )
    rounded = (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)
    # Beyond 2**52 every double is whole already.
    return F.when(F.abs(scaled) < F.lit(float(2**52)), rounded).otherwise(value)
