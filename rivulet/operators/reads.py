"""Look-ups over the stream table: by id, by party, in pages."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.vesting import VIEW_COLUMNS, view

DEFAULT_LIMIT = 50
MAX_LIMIT = 100
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_RADIX = re.compile(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")


def _number(raw: str | int | float) -> float:
    """A query argument as a number; anything that is not one gives NaN."""
    text = str(raw).strip()
    if text == "":
        return 0.0
    if _RADIX.fullmatch(text):
        return float(int(text, 0))
    return float(text) if _NUMBER.fullmatch(text) else math.nan


@dataclass(frozen=True)
class PageArgument:
    """A whole number in a query: what stands for a missing or unusable one, whether zero is usable, and the cap."""

    default: int
    zero: bool = False
    cap: float = math.inf

    def read(self, raw: str | int | float | None) -> int:
        given = self.default if raw in (None, "") else _number(raw)
        usable = math.isfinite(given) and (given > 0 or (self.zero and given == 0))
        return int(min(math.floor(given), self.cap)) if usable else self.default


parse_limit = PageArgument(DEFAULT_LIMIT, cap=MAX_LIMIT).read
parse_offset = PageArgument(0, zero=True).read


def parse_stream_id(raw: str | int) -> int:
    text = str(raw)
    if not re.fullmatch(r"[0-9]+", text):
        raise ValueError("invalid stream id")
    return int(text)


def stream_by_id(streams: DataFrame, raw: str | int) -> DataFrame:
    """The stream with this id, or an empty frame; ``ValueError`` when it is not an id."""
    wanted = parse_stream_id(raw)
    kind = streams.schema["stream_id"].dataType
    top = 2**63 if isinstance(kind, T.LongType) else 2**64
    if wanted >= top:
        return streams.where(F.lit(False))
    return streams.where(F.col("stream_id") == F.lit(str(wanted)).cast(kind))


def filter_streams(
    streams: DataFrame, sender: str | None = None, recipient: str | None = None, token: str | None = None
) -> DataFrame:
    """Streams that match all the given parties; an empty or absent one does not restrict."""
    for column, wanted in (("sender", sender), ("recipient", recipient), ("token", token)):
        if wanted:
            streams = streams.where(F.col(column) == wanted)
    return streams


def list_streams(streams: DataFrame, limit=None, offset=None, **parties: str | None) -> DataFrame:
    """One page of matching streams, newest id first."""
    take, skip = parse_limit(limit), parse_offset(offset)
    return filter_streams(streams, **parties).orderBy(F.desc("stream_id")).offset(skip).limit(take)


def count_streams(streams: DataFrame, **parties: str | None) -> DataFrame:
    """How many streams match, whatever page is shown."""
    return filter_streams(streams, **parties).agg(F.count(F.lit(1)).alias("total"))


def stream_page(streams: DataFrame, as_of=None, limit=None, offset=None, **parties: str | None) -> DataFrame:
    """The whole answer as one row: views of the page, total, limit and offset.

    Page and count meet in one small aggregate, so both come from the same version of the table.
    """
    views = view(list_streams(streams, limit, offset, **parties), as_of).select(F.struct(*VIEW_COLUMNS).alias("view"))
    return envelope(views, count_streams(streams, **parties), limit, offset)


def envelope(views: DataFrame, count: DataFrame, limit=None, offset=None) -> DataFrame:
    """One row of at most MAX_LIMIT views (view) and a one-row count (total)."""
    shown = views.withColumn("total", F.lit(None).cast("bigint"))
    count = count.select(F.lit(None).cast(views.schema["view"].dataType).alias("view"), "total")
    rank = F.struct((-F.col("view.id").cast("decimal(20,0)")).alias("rank"), F.col("view").alias("view"))
    return (
        shown.unionByName(count)
        .agg(F.sort_array(F.collect_list(F.when(F.col("view").isNotNull(), rank))).alias("ranked"), F.max("total").alias("total"))
        .select(
            F.transform("ranked", lambda r: r["view"]).alias("streams"),
            "total",
            F.lit(parse_limit(limit)).cast("bigint").alias("limit"),
            F.lit(parse_offset(offset)).cast("bigint").alias("offset"),
        )
    )
