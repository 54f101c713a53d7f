"""How far the log has been processed, and how far that is behind the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGES_PER_BLOCK = 65_536


def start_of(saved: DataFrame, start_ledger: int, head: int) -> DataFrame:
    """One row: where to read from (cursor or start_ledger) and the last ledger claimed until then.

    ``saved`` holds the stored position (last_ledger, cursor) or nothing. Its cursor comes first; without one a
    configured ledger, of which all before it count as done; without that (0) the head of the chain.
    """
    configured = F.lit(start_ledger if start_ledger > 0 else None).cast("bigint")
    head = F.lit(head).cast("bigint")
    return (
        saved.where(F.length("cursor") > 0)
        .agg(F.max("cursor").alias("cursor"), F.max("last_ledger").alias("last_ledger"))
        .select(
            F.coalesce("last_ledger", configured - 1, head).alias("last_ledger"),
            "cursor",
            F.when(F.col("cursor").isNull(), F.coalesce(configured, head)).alias("start_ledger"),
        )
    )


def page_progress(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the highest ledger each one processed; failed and unknown events do not count."""
    done = events.where(F.col("error").isNull()).groupBy("page_seq").agg(F.max("ledger").alias("done_ledger"))
    return pages.join(done, "page_seq", "left")


def position_history(progress: DataFrame, floor: int = 0) -> DataFrame:
    """The position as saved after every page.

    The running maximum goes block by block: inside a block of pages in parallel, and across blocks
    over one row per block, so no task sees all pages.
    """
    blocked = progress.withColumn("block", F.floor(F.col("page_seq") / PAGES_PER_BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("block")
        .agg(F.max("done_ledger").alias("block_max"))
        .select("block", F.max("block_max").over(earlier).alias("carried"))
    )
    inside = Window.partitionBy("block").orderBy("page_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.greatest(F.lit(floor).cast("bigint"), F.col("carried"), F.max("done_ledger").over(inside))
    return (
        blocked.join(carried, "block", "left")
        .withColumn("last_ledger", last)
        .select(
            "page_seq",
            "last_ledger",
            F.col("latest_ledger").alias("chain_ledger"),
            "cursor",
            lag_of(F.col("latest_ledger"), F.col("last_ledger")).alias("lag_ledgers"),
        )
    )


def last_position(saved: DataFrame, high_page: int, last_ledger: int, chain_ledger: int | None, cursor: str | None) -> tuple:
    """(last ledger, chain head, cursor) after the saved pages; only a page above ``high_page`` moves head and cursor."""
    newest = F.max(F.when(F.col("page_seq") > high_page, F.struct("page_seq", "chain_ledger", "cursor"))).alias("page")
    row = saved.agg(F.max("last_ledger").alias("last_ledger"), newest).first()
    last = last_ledger if row.last_ledger is None else max(last_ledger, row.last_ledger)
    return (last, chain_ledger, cursor) if row.page is None else (last, row.page.chain_ledger, row.page.cursor)


def lag_of(chain, last):
    """Never negative."""
    return F.greatest(F.lit(0).cast("bigint"), chain - last)


def position(progress: DataFrame, floor: int = 0) -> DataFrame:
    """The position after all pages: one row, or none when there is no page."""
    return (
        progress.agg(
            F.greatest(F.lit(floor).cast("bigint"), F.max("done_ledger")).alias("last_ledger"),
            F.max(F.struct("page_seq", "latest_ledger", "cursor")).alias("page"),
        )
        .where(F.col("page").isNotNull())
        .select("last_ledger", F.col("page.latest_ledger").alias("chain_ledger"), "page.cursor")
    )


def status_report(saved: DataFrame) -> DataFrame:
    """Always one row: zeros and nulls until a first position has been saved."""
    there = F.col("n") > 0
    return saved.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("last_ledger").alias("last"),
        F.max("chain_ledger").alias("chain"),
        F.max("cursor").alias("cursor"),
    ).select(
        there.alias("initialized"),
        F.coalesce("last", F.lit(0).cast("bigint")).alias("last_ledger"),
        "cursor",
        F.coalesce("chain", F.lit(0).cast("bigint")).alias("latest_ledger"),
        F.when(there, lag_of(F.col("chain"), F.col("last"))).alias("lag_ledgers"),
    )
