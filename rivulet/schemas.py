"""Declared schemas. Every read of files uses one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LONG, TEXT, FLAG = T.LongType(), T.StringType(), T.BooleanType()
STREAM_ID = T.DecimalType(20, 0)  # unsigned 64-bit ids
TIME = T.DecimalType(20, 0)  # unsigned 64-bit seconds, as the wire form has them

RAW_EVENT = _struct(
    ("type", TEXT),
    ("ledger", LONG),
    ("ledgerClosedAt", TEXT),
    ("contractId", TEXT),
    ("id", TEXT),
    ("pagingToken", TEXT),
    ("topic", T.ArrayType(TEXT)),
    ("value", TEXT),
    ("inSuccessfulContractCall", FLAG),
    ("txHash", TEXT),
)

# One response of the event feed. ``page_seq`` is stamped when the page is landed.
RAW_PAGE = _struct(
    ("page_seq", LONG),
    (
        "result",
        _struct(("events", T.ArrayType(RAW_EVENT)), ("latestLedger", LONG), ("cursor", TEXT)),
    ),
)


def event_schema(
    amount: T.DataType = TEXT, stream_id: T.DataType = STREAM_ID, pos: T.DataType = T.IntegerType(), time: T.DataType = LONG
) -> T.StructType:
    """The wide event row; columns of the other kinds are null, ``error`` marks a bad event. ``time`` is that of the schedule."""
    return _struct(
        ("page_seq", LONG),
        ("pos", pos),
        ("event_id", TEXT),
        ("kind", TEXT),
        ("stream_id", stream_id),
        ("ledger", LONG),
        ("closed_at", LONG),
        ("tx_hash", TEXT),
        ("sender", TEXT),
        ("recipient", TEXT),
        ("token", TEXT),
        ("total_amount", amount),
        ("start_time", time),
        ("end_time", time),
        ("cliff_time", time),
        ("amount", amount),
        ("recipient_amount", amount),
        ("sender_refund", amount),
        ("error", TEXT),
    )


def stream_schema(amount: T.DataType = TEXT, stream_id: T.DataType = STREAM_ID, time: T.DataType = LONG) -> T.StructType:
    """One row per payment stream, as the mirror stores it."""
    return _struct(
        ("stream_id", stream_id),
        ("sender", TEXT),
        ("recipient", TEXT),
        ("token", TEXT),
        ("total_amount", amount),
        ("withdrawn", amount),
        ("start_time", time),
        ("end_time", time),
        ("cliff_time", time),
        ("cancelled", FLAG),
        ("created_ledger", LONG),
        ("updated_ledger", LONG),
        ("last_event_id", TEXT),
    )


def snapshot_schema(amount: T.DataType = TEXT, stream_id: T.DataType = STREAM_ID, time: T.DataType = LONG) -> T.StructType:
    """Authoritative state of a stream. ``as_of_event_id`` may be null: see the fold's guard."""
    return _struct(
        ("stream_id", stream_id),
        ("sender", TEXT),
        ("recipient", TEXT),
        ("token", TEXT),
        ("total_amount", amount),
        ("withdrawn", amount),
        ("start_time", time),
        ("end_time", time),
        ("cliff_time", time),
        ("cancelled", FLAG),
        ("as_of_event_id", TEXT),
    )


EVENT_COLUMNS = event_schema().fieldNames()
STREAM_COLUMNS = stream_schema().fieldNames()
OUTCOME_COLUMNS = ["page_seq", "pos", "event_id", "kind", "stream_id", "ledger", "outcome"]
