"""The event feed: pages of raw events, landed as JSON files, one page to a line or a file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rivulet.functions import xdr
from rivulet.schemas import RAW_PAGE

PAGE_LIMIT = 100  # events the feed puts in a page
PAGES_PER_FILE = 512
BROKEN = "broken"


LANDED_PAGE = T.StructType([*RAW_PAGE.fields, T.StructField(BROKEN, T.StringType())])


def _landed(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    text = spark.read.text(path, wholetext=multi_line).where(F.length(F.trim("value")) > 0)
    page = F.from_json("value", LANDED_PAGE, {"columnNameOfCorruptRecord": BROKEN})
    return text.select(page.alias("page"), F.col("_metadata.file_path").alias("landing"))


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All landed pages that can be read; see ``broken_pages``. ``multi_line`` reads files that hold one pretty-printed page each."""
    return _landed(spark, path, multi_line).select("page.*").where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """broken (the text), landing (its file): lines and files that are no pages; none is dropped silently."""
    return _landed(spark, path, multi_line).select(f"page.{BROKEN}", "landing").where(F.col(BROKEN).isNotNull())


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None, remove: bool = False) -> DataFrame:
    """Everything that lands as an unbounded source, for the live path: pages, or broken lines, with the file they came in.

    remove: files of a committed micro-batch go when the next one begins.
    """
    reader = spark.readStream.schema(LANDED_PAGE).option("columnNameOfCorruptRecord", BROKEN)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if remove:
        reader = reader.option("cleanSource", "delete")
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("landing"))


def parse_pages(text: DataFrame, column: str = "value") -> DataFrame:
    """Pages from a text column, for feeds that do not come as files."""
    return text.select(F.from_json(F.col(column), RAW_PAGE).alias("page")).select("page.*")


def _wanted(contract: str | None):
    def test(event: Column) -> Column:
        keep = event["type"] == "contract"
        return keep if contract is None else keep & (event["contractId"] == contract)

    return test


def page_events(pages: DataFrame, contract: str | None = None, *also: str) -> DataFrame:
    """One row ``(page_seq, pos, event)`` per contract event, with further columns of its page; other events are dropped inside the page."""
    events = F.filter(F.col("result.events"), _wanted(contract))
    return pages.select("page_seq", *also, F.posexplode(events).alias("pos", "event"))


def page_positions(pages: DataFrame, *also: str) -> DataFrame:
    """What each page says of the feed: chain head, cursor, and how many events it holds."""
    return pages.select(
        "page_seq",
        *also,
        F.col("result.latestLedger").alias("latest_ledger"),
        F.col("result.cursor").alias("cursor"),
        F.coalesce(F.size("result.events"), F.lit(0)).alias("events"),
    )


def start_at(events: DataFrame, cursor: str | None = None, start_ledger: int | None = None) -> DataFrame:
    """Events after a cursor, or from a ledger on; a cursor wins over a ledger."""
    if cursor is not None:
        return events.where(F.col("event_id") > cursor)
    if start_ledger is not None:
        return events.where(F.col("ledger") >= start_ledger)
    return events


# -- writing pages --------------------------------------------------------------------------------


def account_key(name: Column) -> Column:
    """A 32-byte key for a party that has only a name."""
    return F.upper(F.sha2(name, 256))


def with_party_addresses(frame: DataFrame, *columns: str) -> DataFrame:
    """The addresses that the wire form gives to parties that have only a name."""
    hexed = frame.withColumns({f"_{c}": xdr.account_hex(account_key(F.col(c))) for c in columns})
    return xdr.with_addresses(hexed, {c: f"_{c}" for c in columns}).drop(*(f"_{c}" for c in columns))


def encode_event(contract: str, broken: Column) -> Column:
    """The raw form of a typed event whose amounts are below 2^63 and whose parties are names.

    A broken one gets a bare number where its map is due.
    """
    kind = F.col("kind")
    value = (
        F.when(broken, xdr.u64_hex(F.col("stream_id")))
        .when(
            kind == "created",
            xdr.map_hex(
                {
                    "id": xdr.u64_hex(F.col("stream_id")),
                    "token": xdr.account_hex(account_key(F.col("token"))),
                    "total_amount": xdr.i128_hex(F.col("total_amount")),
                    **{n: xdr.u64_hex(F.col(n)) for n in ("start_time", "end_time", "cliff_time")},
                }
            ),
        )
        .when(
            kind == "withdrawn",
            xdr.map_hex({"id": xdr.u64_hex(F.col("stream_id")), "amount": xdr.i128_hex(F.col("amount"))}),
        )
        .when(
            kind == "cancelled",
            xdr.map_hex(
                {
                    "id": xdr.u64_hex(F.col("stream_id")),
                    "recipient_amount": xdr.i128_hex(F.col("recipient_amount")),
                    "sender_refund": xdr.i128_hex(F.col("sender_refund")),
                }
            ),
        )
        .otherwise(xdr.u64_hex(F.col("stream_id")))
    )
    name_hex = F.concat(
        F.lit(xdr.tag_hex(xdr.TAG_SYMBOL)),
        F.lpad(F.hex(F.length(kind).cast("bigint")), 8, "0"),
        F.rpad(F.hex(kind.cast("binary")), (F.ceil(F.length(kind) / 4) * 8).cast("int"), "0"),
    )
    parties = F.array_compact(
        F.array(
            *[
                F.when(F.col(n).isNotNull(), xdr.to_base64(xdr.account_hex(account_key(F.col(n)))))
                for n in ("sender", "recipient")
            ]
        )
    )
    return F.struct(
        F.lit("contract").alias("type"),
        F.col("ledger"),
        F.date_format(F.timestamp_seconds("closed_at"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ledgerClosedAt"),
        F.lit(contract).alias("contractId"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("pagingToken"),
        F.concat(F.array(xdr.to_base64(name_hex)), parties).alias("topic"),
        xdr.to_base64(value).alias("value"),
        F.lit(True).alias("inSuccessfulContractCall"),
        F.col("tx_hash").alias("txHash"),
    )


def encode_pages(log: DataFrame, contract: str, rows_per_page: int = PAGE_LIMIT, head_lead: int = 10) -> DataFrame:
    """Raw pages of at most ``rows_per_page`` events from a typed log, in arrival order; events without ``pos`` are placed by ``event_id``.

    The log is range-partitioned on arrival and numbered inside each partition, so a page is a run of
    rows, packed where it stands: encoded events, several times as long as typed ones, are never shuffled. A failed attempt is written with a value its kind cannot have. Page
    numbers rise with arrival but leave gaps between partitions; ``number_pages`` closes them.
    """
    bad = F.col("error").isNotNull() if "error" in log.columns else F.lit(False)
    arrival = ["page_seq", "pos" if "pos" in log.columns else "event_id"]
    numbered = (
        log.withColumn("bad", bad)
        .repartitionByRange(*arrival)
        .sortWithinPartitions(*arrival)
        .select(
            F.monotonically_increasing_id().alias("row"),
            encode_event(contract, F.col("bad")).alias("event"),
        )
    )
    paged = T.StructType([T.StructField("page_seq", T.LongType()), T.StructField("events", T.ArrayType(numbered.schema["event"].dataType))])
    return numbered.mapInArrow(_into_pages(rows_per_page), paged).select(
        "page_seq",
        F.struct(
            F.col("events"),
            (F.array_max(F.transform("events", lambda e: e["ledger"])) + head_lead).alias("latestLedger"),
            F.element_at("events", -1)["id"].alias("cursor"),
        ).alias("result"),
    )


def _into_pages(rows_per_page: int):
    """Runs of rows of one partition, as they come, to lists of events; only the rows of an unfinished page are held back."""

    def lists(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks().to_batches()[0]
        starts = np.arange(0, rows.num_rows, rows_per_page)
        first = rows.column("row").to_numpy()[starts]
        page = (first >> 33 << 33) + (first & ((1 << 33) - 1)) // rows_per_page
        events = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), rows.column("event"))
        return pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), events], ["page_seq", "events"])

    def pack(batches):
        held = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            whole = rows.num_rows // rows_per_page * rows_per_page
            if whole:
                yield lists(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield lists(pa.Table.from_batches(held))

    return pack


def number_pages(stored: DataFrame) -> DataFrame:
    """Consecutive page numbers for stored pages of ``encode_pages``.

    Where each partition starts is one small row, which goes to the pages: they are never shuffled.
    """
    part = F.shiftright("page_seq", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy(part)
        .count()
        .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    slot = F.col("page_seq").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .select((F.col("first") + slot).alias("page_seq"), "result")
    )


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Land pages as JSON lines, compressed: the hex and base64 in them take several times their content.

    Such a file is read by one task, so a file holds ``PAGES_PER_FILE`` at most.
    """
    pages.write.mode(mode).option("maxRecordsPerFile", PAGES_PER_FILE).json(path, compression="gzip")
