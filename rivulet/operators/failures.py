"""The dead letters: events whose attempt failed and has not succeeded since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.skew import hot_keys, join_by_key

FAILURE_COLUMNS = ["event_id", "kind", "stream_id", "ledger", "error", "failure_count"]
LIST_LIMIT = 100


def attempts_failed(events: DataFrame) -> DataFrame:
    """Failed attempts of a log in the shape of a dead letter; the stream id is text."""
    return events.where(F.col("error").isNotNull()).select(
        "event_id",
        "kind",
        F.col("stream_id").cast("string").alias("stream_id"),
        "ledger",
        "error",
        F.struct("page_seq", "pos").alias("seq"),
    )


def record_failures(failed: DataFrame) -> DataFrame:
    """One row per event: count of failures and newest error; the rest as at the first failure."""
    return (
        failed.groupBy("event_id")
        .agg(
            F.min(F.struct("seq", "kind", "stream_id", "ledger")).alias("first"),
            F.max(F.struct("seq", "error")).alias("last"),
            F.count(F.lit(1)).alias("failure_count"),
        )
        .select("event_id", "first.kind", "first.stream_id", "first.ledger", "last.error", "failure_count")
    )


def last_successes(events: DataFrame, failed: DataFrame) -> DataFrame:
    """When each event that ever failed last went through; duplicate and missing count as success."""
    suspects = failed.select("event_id").distinct()
    return (
        events.where(F.col("error").isNull())
        .select("event_id", F.struct("page_seq", "pos").alias("seq"))
        .join(suspects, "event_id", "left_semi")
        .groupBy("event_id")
        .agg(F.max("seq").alias("ok_seq"))
    )


def open_failures(events: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Dead letters still open after a log, on top of those recorded before it.

    A success clears the event's row; failures after it start a new one.
    """
    failed = attempts_failed(events)
    suspects = failed.select("event_id")
    if recorded is not None:
        suspects = suspects.unionByName(recorded.select("event_id"))
    cleared = last_successes(events, suspects)
    fresh = record_failures(
        join_by_key(failed, cleared, "event_id", hot_keys(failed, "event_id"))
        .where(F.col("ok_seq").isNull() | (F.col("seq") > F.col("ok_seq")))
        .drop("ok_seq")
    )
    if recorded is None:
        return fresh
    kept = recorded.join(cleared, "event_id", "left_anti")
    both = kept.withColumn("age", F.lit(0)).unionByName(fresh.withColumn("age", F.lit(1)))
    return (
        both.groupBy("event_id")
        .agg(
            F.min(F.struct("age", "kind", "stream_id", "ledger")).alias("first"),
            F.max(F.struct("age", "error")).alias("last"),
            F.sum("failure_count").alias("failure_count"),
        )
        .select("event_id", "first.kind", "first.stream_id", "first.ledger", "last.error", "failure_count")
    )


def oldest_failures(recorded: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The longest-stuck events first."""
    return recorded.orderBy("ledger", "event_id").limit(limit)
