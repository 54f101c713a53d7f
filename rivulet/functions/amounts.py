"""Exact token amounts up to 128 bits and beyond, as column expressions.

A ``DECIMAL(38,0)`` does not hold every 128-bit integer, so amounts come in two lanes. The *number*
lane (``BIGINT`` or ``DECIMAL`` columns) sums in ``DECIMAL(38,0)``. The *text* lane (``STRING``
columns of decimal digits, optionally signed) splits a value in ``high * 10^13 + low`` and sums the
parts apart, so nothing overflows. The fold works on the parts and does not know which lane it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_DIGITS = 13
BASE = 10**BASE_DIGITS


def big(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def base() -> Column:
    return F.lit(BASE).cast("decimal(14,0)")


class NumberLane:
    names = ("n",)

    def split(self, value: Column) -> list[Column]:
        return [big(value)]

    def join(self, parts: list[Column]) -> Column:
        return big(parts[0])


class TextLane:
    names = ("hi", "lo")

    def split(self, value: Column) -> list[Column]:
        negative = F.startswith(value, F.lit("-"))
        digits = F.lpad(F.ltrim(value, F.lit("-")), F.greatest(F.length(value), F.lit(BASE_DIGITS + 1)), "0")
        sign = F.when(negative, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
        high = F.left(digits, F.length(digits) - BASE_DIGITS).cast("decimal(37,0)")
        low = F.right(digits, F.lit(BASE_DIGITS)).cast("decimal(13,0)")
        return [big(high * sign), big(low * sign)]

    def join(self, parts: list[Column]) -> Column:
        high, low = parts
        rest = F.pmod(low, base())
        return signed_text(high + big((low - rest) / base()), rest)


def signed_text(high: Column, rest: Column) -> Column:
    """Text of ``high * 10^13 + rest`` with ``0 <= rest < 10^13`` and ``high`` of either sign."""

    def glue(top: Column, low: Column) -> Column:
        padded = F.concat(top.cast("string"), F.lpad(low.cast("string"), BASE_DIGITS, "0"))
        return F.when(top == 0, low.cast("string")).otherwise(padded)

    whole = rest == 0
    magnitude = F.when(whole, glue(-high, F.lit(0))).otherwise(glue(-high - 1, (base() - rest).cast("decimal(13,0)")))
    return F.when(high >= 0, glue(high, rest.cast("decimal(13,0)"))).otherwise(F.concat(F.lit("-"), magnitude))


def lane_of(frame: DataFrame, column: str) -> NumberLane | TextLane:
    return TextLane() if isinstance(frame.schema[column].dataType, T.StringType) else NumberLane()
