"""The fold as a stateful stream: the row of each payment stream lives in Spark's state store.

Pages land as files; every micro-batch is decoded, meets the snapshots in a join with a static table, and is dealt by
stream id to the state store, where each stream's rows of the micro-batch are applied in order of ``(page_seq, pos)`` to its
stored row. What goes out is appended, exactly once, to a Parquet folder: an outcome for every event and, for every stream that
changed, its new row with a version number. The stored row of a stream is the one of its highest version.

A call into Python costs far more than an event, so streams share *slots*, by the hash of their id: a slot is the group that goes to
Python, and its state holds the rows of its streams. Their number is fixed for the life of a checkpoint, which remembers it; about one
for ``STREAMS_PER_SLOT`` streams is right.

Nothing but the row itself is kept for a stream, and only one micro-batch of events of a slot is in memory at a time
(``files_per_batch`` bounds it). State has no time limit, since an event may come late by any amount; a page that
lands again or late is applied when it arrives, and the guard judges its events by their ids. A run that
breaks off goes on from its checkpoint.

Events that failed to decode are outcomes of kind ``unknown`` and touch no state; they are dealt out by the hash of their id.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from rivulet.operators.decode import decode_events
from rivulet.operators.fold import BASE_FIELDS, CREATED_FIELDS
from rivulet.schemas import EVENT_COLUMNS, STREAM_COLUMNS, TIME, stream_schema
from rivulet.sources.pages import BROKEN, page_events, stream_pages

STATE, OUTCOME = "state", "outcome"
FAILED_SLOTS = 1024
DEFAULT_SLOTS = 1024
STREAMS_PER_SLOT = 256  # a slot's state is written whole when one of its streams changes
KEY = T.DecimalType(21, 0)  # stream ids, and slots of failed events below zero
ROW = T.StructType([f for f in stream_schema(time=TIME).fields if f.name != "stream_id"])
# The state of a slot: as JSON, from key to version and values of ROW.
STORED = T.StructType([T.StructField("rows", T.StringType())])
SNAPSHOT = [*(f"chain_{c}" for c in BASE_FIELDS), "as_of_event_id"]
LOG = T.StructType(
    [
        T.StructField("row_type", T.StringType()),
        T.StructField("key", KEY),
        T.StructField("version", T.LongType()),
        *ROW.fields,
        *(T.StructField(n, t) for n, t in (("page_seq", T.LongType()), ("pos", T.IntegerType()), ("event_id", T.StringType()), ("kind", T.StringType()), ("ledger", T.LongType()), ("outcome", T.StringType()), ("error", T.StringType()))),
    ]
)
# What a task needs of an event.
NEEDED = [c for c in EVENT_COLUMNS if c not in ("stream_id", "tx_hash", "sender_refund")]
# An event goes to Python, and a row of LOG comes back, as one array of texts: a slot has few rows in a micro-batch, so what
# a task spends goes with the number of columns that pandas cuts out and puts together for each slot.
TIMES = [c for c in CREATED_FIELDS if c.endswith("_time")]
FLAGS = ("chain_cancelled", "on_chain")
READ = dict.fromkeys(["page_seq", "pos", "ledger"], int) | dict.fromkeys(["closed_at", *TIMES, *(f"chain_{c}" for c in TIMES)], Decimal) | dict.fromkeys(FLAGS, "true".__eq__)


def _with_chain(events: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """events with the snapshot of their stream, in columns of their own."""
    kinds = {f.name: f.dataType for f in stream_schema(time=TIME).fields}
    if snapshot is None:
        return events.withColumns({f"chain_{c}": F.lit(None).cast(kinds[c]) for c in BASE_FIELDS} | {"as_of_event_id": F.lit(None).cast("string"), "on_chain": F.lit(False)})
    as_of = F.col("as_of_event_id") if "as_of_event_id" in snapshot.columns else F.lit(None).cast("string")
    chain = snapshot.select("stream_id", *(F.col(c).cast(kinds[c]).alias(f"chain_{c}") for c in BASE_FIELDS), as_of.alias("as_of_event_id"), F.lit(True).alias("on_chain"))
    return events.join(chain, "stream_id", "left").withColumn("on_chain", F.coalesce("on_chain", F.lit(False)))


def _slot() -> Column:
    """The stream id; a failed event has a slot below zero."""
    return F.when(F.col("error").isNull(), F.col("stream_id").cast(KEY)).otherwise((-1 - F.pmod(F.xxhash64("event_id"), F.lit(FAILED_SLOTS))).cast(KEY))


def apply_event(row: dict | None, e: dict) -> tuple[dict | None, str]:
    """The stream's row after one event, and the event's outcome; the row is not changed in place."""
    kind, ident = e["kind"], e["event_id"]
    if row is None:
        if kind == "created":
            own = {c: e[c] for c in CREATED_FIELDS} | {"withdrawn": "0", "cancelled": False}
        elif e["on_chain"]:
            own = {c: e[f"chain_{c}"] for c in BASE_FIELDS}
            ident = max(ident, e["as_of_event_id"] or ident)
        else:
            return None, "missing"
        own |= {"created_ledger": e["ledger"], "updated_ledger": e["ledger"], "last_event_id": ident}
        return own, "applied" if kind == "created" else "reconciled"
    seen = row["last_event_id"]
    if kind == "created" or (seen is not None and ident <= seen):
        return row, "duplicate"
    drawn = str(int(row["withdrawn"]) + int(e["amount"] if kind == "withdrawn" else e["recipient_amount"]))
    moved = {"withdrawn": drawn, "updated_ledger": e["ledger"], "last_event_id": ident}
    if kind == "cancelled":
        moved |= {"total_amount": drawn, "end_time": e["closed_at"], "cancelled": True}
    return row | moved, "applied"


EVENT = [*NEEDED, *SNAPSHOT, "on_chain", "key"]
PLACE = {name: i for i, name in enumerate(LOG.fieldNames())}


KINDS_OF = [READ.get(c) for c in EVENT]
ROW_NAMES = ROW.fieldNames()
ROW_TIMES = [i for i, name in enumerate(ROW_NAMES) if name in TIMES]


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _line(**values) -> list:
    """A row of LOG, in texts."""
    line = [None] * len(PLACE)
    for name, value in values.items():
        line[PLACE[name]] = _text(value)
    return line


def _packed(rows: dict[str, list]) -> str:
    """Rows of a slot as its state; whole numbers of any size go into JSON as they are."""
    return json.dumps(rows, default=int, separators=(",", ":"))


def _unpacked(text: str) -> dict[str, list]:
    rows = json.loads(text)
    for stored in rows.values():
        for i in ROW_TIMES:
            stored[1 + i] = None if stored[1 + i] is None else Decimal(stored[1 + i])
    return rows


def _applied(key, batches, state):
    """Rows of LOG for the events of one slot in a micro-batch, in order of arrival."""
    import pandas as pd

    events = []
    for frame in batches:
        for texts in frame["event"].tolist():
            events.append([t if t is None or kind is None else kind(t) for t, kind in zip(texts, KINDS_OF, strict=True)])
    events.sort(key=lambda e: e[:2])  # page_seq, pos
    stored = _unpacked(state.get[0]) if state.exists else {}
    rows, changed, out = {}, set(), []
    for values in events:
        e = dict(zip(EVENT, values, strict=True))
        stream, outcome = e["key"], "failed"
        if e["error"] is None:
            if stream not in rows:
                rows[stream] = dict(zip(ROW_NAMES, stored[stream][1:], strict=True)) if stream in stored else None
            row, outcome = apply_event(rows[stream], e)
            if row is not rows[stream]:
                rows[stream] = row
                changed.add(stream)
        out.append(_line(row_type=OUTCOME, key=stream, outcome=outcome, page_seq=e["page_seq"], pos=e["pos"], event_id=e["event_id"], kind=e["kind"], ledger=e["ledger"], error=e["error"]))
    for stream in sorted(changed):
        version = 1 + (stored[stream][0] if stream in stored else 0)
        stored[stream] = [version, *(rows[stream][n] for n in ROW_NAMES)]
        out.append(_line(row_type=STATE, key=stream, version=version, **rows[stream]))
    if changed:
        state.update((_packed(stored),))
    yield pd.DataFrame({"line": out})


def fold_stream(events: DataFrame, snapshot: DataFrame | None = None, slots: int | None = None) -> DataFrame:
    """A stream of events (EVENT_COLUMNS) to a stream of outcomes and new rows (LOG). slots must stay what it was when the checkpoint began."""
    rows = _with_chain(events, snapshot).withColumn("key", _slot()).where(F.col("key").isNotNull())
    shared = F.pmod(F.xxhash64("key"), F.lit(slots or DEFAULT_SLOTS)).cast(KEY)
    rows = rows.select(F.when(F.col("key") < 0, F.col("key")).otherwise(shared).alias("slot"), F.array(*(F.col(c).cast("string") for c in EVENT)).alias("event"))
    lines = rows.groupBy("slot").applyInPandasWithState(_applied, "line array<string>", STORED, "append", GroupStateTimeout.NoTimeout)
    return lines.select(*(F.col("line")[PLACE[f.name]].cast(f.dataType).alias(f.name) for f in LOG.fields))


def _kept_slots(spark: SparkSession, checkpoint_dir: str, slots: int | None) -> int:
    """The number of slots that the checkpoint began with, which is kept beside it; another one is refused."""
    place = f"{checkpoint_dir.rstrip('/')}-slots"
    try:
        kept = spark.read.schema("slots bigint").parquet(place).first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    if kept is None:
        kept = (slots or DEFAULT_SLOTS,)
        spark.createDataFrame([kept], "slots bigint").coalesce(1).write.mode("overwrite").parquet(place)
    if slots and slots != kept[0]:
        raise ValueError(f"the checkpoint in {checkpoint_dir} has {kept[0]} slots, not {slots}")
    return kept[0]


def start(
    spark: SparkSession,
    pages_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    snapshot: DataFrame | None = None,
    contract: str | None = None,
    files_per_batch: int | None = None,
    every: str | None = None,
    slots: int | None = None,
) -> StreamingQuery:
    """Start the stream: until the landed pages are used up, or for good at an interval.

    slots is for the first start; later ones take over its number. Broken lines are left to ``pages.broken_pages``.
    """
    pages = stream_pages(spark, pages_dir, files_per_batch).where(F.col(BROKEN).isNull() & F.col("page_seq").isNotNull())
    rows = fold_stream(decode_events(page_events(pages, contract)), snapshot, _kept_slots(spark, checkpoint_dir, slots))
    writer = rows.writeStream.format("parquet").partitionBy("row_type").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    writer = writer.option("compression", "zstd").outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _rows(spark: SparkSession, out_dir: str, row_type: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(out_dir).where(F.col("row_type") == row_type)


def streams(spark: SparkSession, out_dir: str) -> DataFrame:
    """The row of every stream after all micro-batches: the newest version of each, by a partial aggregate."""
    newest = F.max_by(F.struct(*ROW.fieldNames()), "version").alias("row")
    rows = _rows(spark, out_dir, STATE).groupBy("key").agg(newest).select(F.col("key").cast("decimal(20,0)").alias("stream_id"), "row.*")
    return rows.select(*STREAM_COLUMNS)


def outcomes(spark: SparkSession, out_dir: str) -> DataFrame:
    """What every event did; failed ones carry their error."""
    ident = F.when(F.col("key") >= 0, F.col("key").cast("decimal(20,0)")).alias("stream_id")
    return _rows(spark, out_dir, OUTCOME).select("page_seq", "pos", "event_id", "kind", ident, "ledger", "outcome", "error")
