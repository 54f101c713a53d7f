"""The live path: pages land as files, a stream copies them to a page log, drains fold what arrived.

The stream reads each landed file once and appends its pages, as they are, to a Parquet log through the file sink,
exactly once, resuming from its checkpoint. Every page gets the time of its micro-batch and the file it came in. A drain
folds the pages that arrived since the drain before, seeded by the store's version, and the version remembers two marks:

* ``seen_at``: all pages that arrived up to then have been looked at;
* ``high_page``: all page numbers up to it have been folded, or given up for late.

What is to be folded follows from the marks alone: a page that arrived after ``seen_at``, whatever its number, so one that comes late
or lands again under its own number is folded too; and an older arrival above ``high_page``, which had waited behind a
gap in the page numbers. The guard in the fold judges every event by its id, so repeated events change nothing, and a failed event that comes
again is retried. There is no watermark, since an event may come late by any amount.

Within a drain pages are taken in order of their numbers, copies of a page in the order of their arrival. Lines
that are no pages go to the dead letters. The times come from the clock of the driver, and are kept from
going back between runs of the stream.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from rivulet.operators.decode import decode_events
from rivulet.operators.position import start_of
from rivulet.schemas import RAW_PAGE
from rivulet.sources.mirror import MirrorStore, Version
from rivulet.sources.pages import BROKEN, page_events, page_positions, start_at, stream_pages

PAGES_PER_BLOCK = 65_536
COPY_SPAN = 65_536  # positions of an event in the nth copy of a page start at n times this
HOUR = 3_600_000_000
LOG_SCHEMA = T.StructType(
    [
        *RAW_PAGE.fields,
        T.StructField(BROKEN, T.StringType()),
        T.StructField("landing", T.StringType()),
        T.StructField("arrived_at", T.LongType()),
        T.StructField("arrived_hour", T.LongType()),
    ]
)
ARRIVAL = ["page_seq", "landing", "arrived_at"]


def _last_arrival(spark: SparkSession, log_dir: str) -> int:
    """The newest arrival time in the log; reads the newest hour alone."""
    try:
        log = spark.read.parquet(log_dir)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    newest = log.agg(F.max("arrived_hour")).first()[0]
    return log.where(F.col("arrived_hour") == newest).agg(F.max("arrived_at")).first()[0] if newest is not None else 0


def start_ingest(
    spark: SparkSession,
    pages_dir: str,
    log_dir: str,
    checkpoint_dir: str,
    files_per_batch: int | None = None,
    every: str | None = None,
    remove_landed: bool = False,
) -> StreamingQuery:
    """Start the stream: until the landed pages are used up, or for good at an interval.

    remove_landed: a landed file goes in a later micro-batch than its own, since the log has its lines.
    """
    now = F.greatest(F.unix_micros(F.current_timestamp()), F.lit(_last_arrival(spark, log_dir) + 1))
    rows = stream_pages(spark, pages_dir, files_per_batch, remove_landed).withColumn("arrived_at", now)
    rows = rows.withColumn("arrived_hour", F.floor(F.col("arrived_at") / HOUR)).select(*LOG_SCHEMA.fieldNames())
    writer = (
        rows.writeStream.format("parquet")
        .partitionBy("arrived_hour")
        .option("path", log_dir)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_log(spark: SparkSession, log_dir: str, since: int = 0) -> DataFrame:
    """Committed pages of the log that arrived at ``since`` or later; earlier hours are not opened."""
    log = spark.read.schema(LOG_SCHEMA).parquet(log_dir)
    return log.where((F.col("arrived_hour") >= since // HOUR) & (F.col("arrived_at") >= since))


def last_without_gap(pages: DataFrame, high: int) -> int:
    """The last page number before the first gap above ``high``.

    Full blocks of page numbers are counted first, one row per block, and only the first block that
    is not full is looked into.
    """
    numbers = pages.where(F.col("page_seq") > high).select((F.col("page_seq") - high - 1).alias("n")).distinct()

    def run_length(frame: DataFrame, column: str) -> int:
        rank = F.row_number().over(Window.orderBy(column)) - 1
        return frame.withColumn("rank", rank).where(F.col("rank") == F.col(column)).count()

    full = (
        numbers.groupBy(F.floor(F.col("n") / PAGES_PER_BLOCK).alias("block"))
        .count()
        .where(F.col("count") == PAGES_PER_BLOCK)
    )
    first = run_length(full, "block") * PAGES_PER_BLOCK
    rest = numbers.where(F.col("n").between(first, first + PAGES_PER_BLOCK - 1)).select((F.col("n") - first).alias("n"))
    return high + first + run_length(rest, "n")


def _is_page() -> Column:
    return F.col(BROKEN).isNull() & F.col("page_seq").isNotNull()


def broken_lines(log: DataFrame) -> DataFrame:
    """Lines of the log that are no pages, as failed attempts; the text's digest stands for the event's id."""
    text = F.coalesce(F.col(BROKEN), F.to_json("result"), F.lit(""))
    return log.where(~_is_page()).select(
        F.concat(F.lit("line-"), F.sha2(text, 256)).alias("event_id"),
        F.concat(F.lit("not a page: "), F.substring(text, 1, 200)).alias("error"),
        F.col("arrived_at").alias("page_seq"),
        F.lit(0).alias("pos"),
    )


def with_copies(pages: DataFrame) -> DataFrame:
    """pages with copy: 0 for the first arrival of a page number, 1 for the next, and so on."""
    order = Window.partitionBy("page_seq").orderBy("arrived_at", "landing")
    copies = pages.select(*ARRIVAL).distinct().withColumn("copy", F.row_number().over(order) - 1).where("copy > 0")
    if not copies.limit(1).count():
        return pages.withColumn("copy", F.lit(0))
    return pages.join(copies, ARRIVAL, "left").withColumn("copy", F.coalesce("copy", F.lit(0)))


def fold_arrived(
    spark: SparkSession,
    log_dir: str,
    store: MirrorStore,
    snapshot: DataFrame | None = None,
    hold_back_gaps: bool = True,
    floor: int = 0,
    contract: str | None = None,
    start_ledger: int | None = None,
) -> Version:
    """Fold the pages that arrived since the store's last version. Nothing to fold, no new version.

    start_ledger says where a store without a position begins, 0 for the head of the chain (``position.start_of``): events of
    earlier ledgers are left out, and all before it counts as done. Where it is None nothing is left out, and ``floor`` counts as done.
    """
    before = store.current()
    since = min(before.seen_at + 1, before.waiting_since or before.seen_at + 1)
    log = read_log(spark, log_dir, since)
    found = log.agg(F.max("arrived_at").alias("at"), F.max(F.when(_is_page(), F.col("page_seq"))).alias("page")).first()
    if found["at"] is None or found["at"] <= before.seen_at:
        return before
    log = log.where(F.col("arrived_at") <= found["at"])
    fresh, above = F.col("arrived_at") > before.seen_at, F.col("page_seq") > before.high_page
    candidates = log.where(_is_page() & (fresh | above))
    if hold_back_gaps:
        upto = last_without_gap(candidates, before.high_page)
    else:
        upto = max(before.high_page, before.high_page if found["page"] is None else found["page"])
    ready, broken = candidates.where(F.col("page_seq") <= upto), broken_lines(log.where(fresh))
    if not ready.limit(1).count() and not broken.limit(1).count():
        return before
    ready = with_copies(ready)
    waiting_since = candidates.where(F.col("page_seq") > upto).agg(F.min("arrived_at")).first()[0]
    numbered = page_events(ready, contract, "copy")
    events = decode_events(numbered.withColumn("pos", F.col("pos") + F.col("copy") * COPY_SPAN).drop("copy"))
    if start_ledger is not None and before.last_ledger is None:
        first = page_positions(ready).agg(F.min_by("latest_ledger", "page_seq")).first()[0]
        start = start_of(store.position(), start_ledger, first or 0).first()
        floor, events = start.last_ledger, start_at(events, start_ledger=start.start_ledger)
    # Of the copies of a page the newest says what the feed was like.
    last_copy = page_positions(ready, "copy").groupBy("page_seq").agg(F.max(F.struct("copy", "latest_ledger", "cursor")).alias("last"))
    headers = last_copy.select("page_seq", "last.latest_ledger", "last.cursor")
    return store.apply(events, headers, upto, snapshot, floor, found["at"], waiting_since, broken)


def drain(
    spark: SparkSession,
    pages_dir: str,
    log_dir: str,
    checkpoint_dir: str,
    store: MirrorStore,
    snapshot: DataFrame | None = None,
    contract: str | None = None,
    files_per_batch: int | None = None,
    floor: int = 0,
    hold_back_gaps: bool = True,
    start_ledger: int | None = None,
    remove_landed: bool = False,
) -> Version:
    """Take in every landed page and fold it, then return: the backlog is used up."""
    start_ingest(spark, pages_dir, log_dir, checkpoint_dir, files_per_batch, remove_landed=remove_landed).awaitTermination()
    return fold_arrived(spark, log_dir, store, snapshot, hold_back_gaps, floor, contract, start_ledger)
