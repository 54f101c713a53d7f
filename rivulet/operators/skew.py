"""Keys too large for one task, found inside the plan.

``hot_keys`` is an exact count per key with a filter on top, so building a plan starts no job. It has fewer rows than the input has
rows divided by the limit, by definition of a hot key; that bound is why it may be broadcast, and holds for groups of keys as well. Where no key is hot, it
is empty when it is sent, and adaptive execution drops the branch for hot keys before its rows are read; where no group is full, also the count per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS_SETTING = "rivulet.skew.hotRows"
HOT_ROWS = 4_000_000  # rows of one key that a single task still sorts comfortably
GROUPS = 1 << 14


def hot_rows(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def hot_keys(frame: DataFrame, key: str) -> DataFrame:
    """The keys with more than the allowed rows, one row each: less than rows / ``hot_rows`` of them.

    Rows are counted in ``GROUPS`` groups of keys first, as a hot key's group has at least its rows; only keys of groups with too many are counted apart.
    """
    many = F.col("rows") > hot_rows(frame)
    rows = frame.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("group"))
    full = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).where(many).select("group")
    counts = rows.join(F.broadcast(full), "group", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(many).select(key)


def split_hot(frame: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, all other rows)."""
    few = F.broadcast(hot)
    return frame.join(few, key, "left_semi"), frame.join(few, key, "left_anti")


def join_by_key(frame: DataFrame, lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join with a table that has at most one row per key, safe when one key dominates.

    Hot keys meet a broadcast of their own lookup rows, one each; the others are shuffled as usual.
    """
    large, rest = split_hot(frame, key, hot)
    few = lookup.join(F.broadcast(hot), key, "left_semi")
    return large.join(F.broadcast(few), key, "left").unionByName(rest.join(lookup, key, "left"))
