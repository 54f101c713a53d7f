"""Keeping computed columns computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(frame: DataFrame, names: list[str]) -> DataFrame:
    """Fix the values of costly columns at this point of the plan; the others pass through.

    A filter on a column made of many stacked projections is pushed to the bottom of the stack with
    every definition written out in it, which repeats the work and swells the plan. Filters do not
    pass the output of a generator, so a one-element ``inline`` stops exactly those; filters on the
    other columns still reach the scan.
    """
    others = [F.col(c) for c in frame.columns if c not in names]
    return frame.select(*others, F.inline(F.array(F.struct(*names)))).select(*frame.columns)
