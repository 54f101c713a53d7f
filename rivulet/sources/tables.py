"""Canonical tables derived by Spark from the order, line-item and request tables.

An order is a payment stream, a line item a withdrawal, a request a log sample. The events of one
order come from one scan of the orders table, and replayed copies from an explode, so each source
table is scanned once however many kinds and passes it yields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
# Fixed values of the derivation.
PASS_STRIDE = 1_000_000
LEDGERS_PER_PAGE = 7
HEAD_LEAD = 10
FAILURE_TEXT = "constraint violated"
EVENTS_PER_TASK = 1_000_000  # about 200 MB of rows in a sort


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(price: Column, per_unit: int) -> Column:
    """A price as whole token units, rounded half up."""
    return F.floor(price * per_unit + 0.5)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone is."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * DAY + clock


def _day(seconds: Column) -> Column:
    return F.floor(seconds / DAY)


def _ten(number: Column) -> Column:
    return F.lpad(number.cast("string"), 10, "0")


def base_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream as it is at creation."""
    k, start = F.col("o_orderkey"), F.col("start_time")
    return (
        table(spark, sf_dir, "orders")
        .withColumn("start_time", epoch_seconds(F.col("o_orderdate")))
        .select(
            k.alias("stream_id"),
            F.concat(F.lit("G"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("sender"),
            F.concat(F.lit("R"), F.lpad((k % 97).cast("string"), 9, "0")).alias("recipient"),
            F.col("o_orderpriority").alias("token"),
            _units(F.col("o_totalprice"), 100).alias("total_amount"),
            start,
            (start + 365 * DAY).alias("end_time"),
            (start + 30 * DAY * (k % 4)).alias("cliff_time"),
            F.col("o_orderstatus").alias("order_status"),
        )
    )


def _lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``created`` and ``cancelled`` rows of each stream, one scan for both.

    A row is doubled by its kind alone, so that a query that asks for few columns builds no others.
    """
    k = F.col("stream_id")
    kinds = F.array(F.when(k % 10 != 3, F.lit("created")), F.when((F.col("order_status") == "F") & (k % 4 == 0), F.lit("cancelled")))
    created = F.col("kind") == "created"
    closed_at = F.when(created, F.col("start_time")).otherwise(F.col("start_time") + DAY * (1 + k % 300))
    ledger = _day(closed_at)
    payout = F.expr("total_amount div 10")
    return (
        base_streams(spark, sf_dir)
        .withColumn("kind", F.explode(F.array_compact(kinds)))
        .select(
            "stream_id",
            "kind",
            F.concat(_ten(ledger), F.when(created, "-0").otherwise("-2"), _ten(k), F.lit("0" * 21)).alias("event_id"),
            ledger.alias("ledger"),
            closed_at.alias("closed_at"),
            "sender",
            *[F.when(created, F.col(c)).alias(c) for c in ("recipient", "token", "total_amount", "start_time", "end_time", "cliff_time")],
            F.when(~created, payout).alias("recipient_amount"),
            F.when(~created, F.col("total_amount") - payout).alias("sender_refund"),
        )
    )


def _withdrawal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _day(F.col("closed_at"))
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("closed_at", epoch_seconds(F.col("l_shipdate")))
        .select(
            F.col("l_orderkey").alias("stream_id"),
            F.lit("withdrawn").alias("kind"),
            F.concat(
                _ten(ledger),
                F.lit("-1"),
                _ten(F.col("l_orderkey")),
                F.col("l_linenumber").cast("string"),
                _ten(F.col("l_partkey")),
                _ten(F.col("l_suppkey")),
            ).alias("event_id"),
            ledger.alias("ledger"),
            "closed_at",
            F.concat(F.lit("R"), F.lpad((F.col("l_orderkey") % 97).cast("string"), 9, "0")).alias("recipient"),
            _units(F.col("l_extendedprice"), 10).alias("amount"),
            (F.col("l_suppkey") % 50 == 7).alias("rejected"),
        )
    )


def event_log(spark: SparkSession, sf_dir: str, passes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The typed event log in the wide schema, ``pos`` being the event id.

    Pass 0 holds every event, pass 1 replays the events of every tenth stream. ``error`` is set on
    the attempts that fail.
    """
    events = _lifecycle_events(spark, sf_dir).unionByName(
        _withdrawal_events(spark, sf_dir), allowMissingColumns=True
    )
    if passes == (0,):
        staged = events.withColumn("pass_no", F.lit(0).cast("bigint"))
    elif passes == (1,):
        staged = events.where("stream_id % 10 = 0").withColumn("pass_no", F.lit(1).cast("bigint"))
    else:
        once, twice = F.expr("array(0L)"), F.expr("array(0L, 1L)")
        staged = events.withColumn("pass_no", F.explode(F.when(F.col("stream_id") % 10 == 0, twice).otherwise(once)))
    failed = F.coalesce(F.col("rejected"), F.lit(False)) & (F.col("pass_no") == 0)
    return staged.select(
        (F.col("pass_no") * PASS_STRIDE + F.floor(F.col("ledger") / LEDGERS_PER_PAGE)).alias("page_seq"),
        F.col("event_id").alias("pos"),
        "event_id",
        "kind",
        "stream_id",
        "ledger",
        "closed_at",
        F.md5(F.col("event_id").cast("binary")).alias("tx_hash"),
        "sender",
        "recipient",
        "token",
        "total_amount",
        "start_time",
        "end_time",
        "cliff_time",
        "amount",
        "recipient_amount",
        "sender_refund",
        F.when(failed, F.lit(FAILURE_TEXT)).alias("error"),
    )


def stream_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the orders table, which its files state."""
    return table(spark, sf_dir, "orders").count()


def fold_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many partitions to deal a log that the cores do not take at once in ``EVENTS_PER_TASK``; its sources' files state their rows."""
    most = 2 * stream_rows(spark, sf_dir) + table(spark, sf_dir, "lineitem").count()
    tasks = -(-most // EVENTS_PER_TASK)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full state of some of the streams whose creation is not in the log."""
    return base_streams(spark, sf_dir).where("stream_id % 20 = 3").select(
        "stream_id",
        "sender",
        "recipient",
        "token",
        "total_amount",
        F.expr("total_amount div 20").alias("withdrawn"),
        "start_time",
        "end_time",
        "cliff_time",
        F.lit(False).alias("cancelled"),
    )


def page_heads(log: DataFrame) -> DataFrame:
    """One row per page of the log: the chain head it saw and the cursor after it."""
    return log.groupBy("page_seq").agg(
        (F.max("ledger") + HEAD_LEAD).alias("latest_ledger"),
        F.max("event_id").alias("cursor"),
        F.count(F.lit(1)).alias("events"),
    )


def page_progress(log: DataFrame) -> DataFrame:
    """``page_heads`` with the highest ledger that each page processed, in one pass."""
    return log.groupBy("page_seq").agg(
        (F.max("ledger") + HEAD_LEAD).alias("latest_ledger"),
        F.max("event_id").alias("cursor"),
        F.max(F.when(F.col("error").isNull(), F.col("ledger"))).alias("done_ledger"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the labels the metrics use; durations are exact decimals."""
    return table(spark, sf_dir, "events").select(
        F.lit("GET").alias("method"),
        F.col("event_type").alias("route"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        F.col("value").cast("decimal(18,2)").alias("duration_ms"),
        "user_id",
        "ts",
        "event_id",
    )


# Which request kind stands for which contract event.
REQUEST_KINDS = {"signup": "created", "purchase": "withdrawn", "error": "cancelled"}


def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event names with unknown ones among them; requests of other kinds keep their own name."""
    name = F.col("event_type")
    for request, kind in REQUEST_KINDS.items():
        name = F.when(F.col("event_type") == request, F.lit(kind)).otherwise(name)
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))
