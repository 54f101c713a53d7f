"""Text of metric labels and values in the exposition format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_label(value: Column) -> Column:
    """Backslash, double quote and newline escaped."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def label_pairs(names: list[str]) -> Column:
    """``k="v",...`` from the columns of these names, without the braces."""
    parts = [
        F.concat(F.lit(f'{n}="'), escape_label(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit('"'))
        for n in names
    ]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def braces(pairs: Column) -> Column:
    """The label set of a sample; nothing at all when there are no labels."""
    return F.when(pairs == "", "").otherwise(F.concat(F.lit("{"), pairs, F.lit("}")))


def number_text(value: Column) -> Column:
    """A number without an exponent where 38 digits hold it, and without a trailing fraction of zeros."""
    text = value.cast("string")
    size = F.abs(value.cast("double"))
    # a double has 17 digits at most, so one of 1e-6 ends at the 22nd decimal
    digits = F.when(size < 1, text.try_cast("decimal(38,22)").cast("string")).otherwise(text.try_cast("decimal(38,16)").cast("string"))
    plain = F.when(F.contains(text, F.lit("E")) & (size >= 1e-6) & (size < 1e21), digits).otherwise(text)
    bare = F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))
    return F.when(F.contains(plain, F.lit(".")) & ~F.contains(plain, F.lit("E")), bare).otherwise(plain)
