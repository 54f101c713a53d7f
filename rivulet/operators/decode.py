"""Raw event pages to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import xdr
from rivulet.functions.stage import settle
from rivulet.operators.fold import KINDS
from rivulet.schemas import EVENT_COLUMNS, STREAM_ID, TIME

# Which value-map fields each kind must carry.
VALUE_FIELDS = {
    "created": ("id", "token", "total_amount", "start_time", "end_time", "cliff_time"),
    "withdrawn": ("id", "amount"),
    "cancelled": ("id", "recipient_amount", "sender_refund"),
}
# The forms in which each kind's value is normally written; a token is a contract or an account.
_SCHEDULE = {"id": xdr.U64, "total_amount": xdr.I128, "start_time": xdr.U64, "end_time": xdr.U64, "cliff_time": xdr.U64}
LAYOUTS = [
    ("created", xdr.Layout.of({**_SCHEDULE, "token": xdr.CONTRACT})),
    ("created", xdr.Layout.of({**_SCHEDULE, "token": xdr.ACCOUNT})),
    ("withdrawn", xdr.Layout.of({"id": xdr.U64, "amount": xdr.I128})),
    ("cancelled", xdr.Layout.of({"id": xdr.U64, "recipient_amount": xdr.I128, "sender_refund": xdr.I128})),
]
# Which column each further topic fills.
TOPIC_FIELDS = {"created": ("sender", "recipient"), "withdrawn": ("recipient",), "cancelled": ("sender",)}
AMOUNTS = ("total_amount", "amount", "recipient_amount", "sender_refund")
ADDRESSES = ("sender", "recipient", "token")
TIMES = ("start_time", "end_time", "cliff_time")


def closed_at_seconds(text: Column) -> Column:
    """RFC 3339 close time as whole Unix seconds, rounded down."""
    return F.unix_seconds(F.try_to_timestamp(text))


def kind_of(topics: Column) -> Column:
    """The event's kind from its first topic, null for unknown names and for no topics.

    Names are compared in their encoded form, so an unknown event is dropped undecoded.
    """
    name = F.try_element_at(topics, F.lit(1))
    kind = None
    for known in KINDS:
        kind = (F if kind is None else kind).when(name.isin(*xdr.text_literals(known)), F.lit(known))
    return kind


def keep_known(named: DataFrame, kind: str = "kind") -> DataFrame:
    """Unknown kinds are skipped, not reported."""
    return named.where(F.col(kind).isin(*KINDS))


def decode_events(raw: DataFrame) -> DataFrame:
    """Typed events from rows ``(page_seq, pos, event)`` of raw ones.

    A value in its normal form is cut at known places; one with other fields in it, as a newer
    contract may write, is walked entry by entry. Only the known kinds come out. One that lacks a field, or holds it in the wrong form, has
    ``error`` set and its kind is given as ``unknown``; it goes to the dead letters.
    """
    kind = F.col("kind")
    layout = None
    for number, (known, form) in enumerate(LAYOUTS):
        layout = (F if layout is None else layout).when((kind == known) & form.fits(F.col("_value")), number)
    staged = (
        raw.withColumn("kind", kind_of(F.col("event.topic")))
        .where(F.col("kind").isNotNull())
        .withColumn("_value", xdr.bytes_of(F.col("event.value")))
        .withColumn("_layout", layout)
        .withColumn("_entries", F.when(F.col("_layout").isNull(), xdr.map_entries(F.col("_value"))))
    )
    raws = {}
    for name in ("id", "token", *TIMES, *AMOUNTS):
        at = None
        for number, (_, form) in enumerate(LAYOUTS):
            if name in form.fields:
                piece = F.hex(F.substring(F.col("_value"), *map(F.lit, form.fields[name])))
                at = (F if at is None else at).when(F.col("_layout") == number, piece)
        kinds = [k for k, fields in VALUE_FIELDS.items() if name in fields]
        walked = F.col("_layout").isNull() & kind.isin(*kinds)
        raws[f"_{name}"] = at.when(walked, xdr.entry(F.col("_entries"), name))
    for field in ("sender", "recipient"):
        at = None
        for known, topics in TOPIC_FIELDS.items():
            if field in topics:
                at = (F if at is None else at).when(kind == known, F.lit(topics.index(field) + 2))
        raws[f"_{field}"] = F.hex(xdr.bytes_of(F.try_element_at(F.col("event.topic"), at)))
    staged = staged.withColumns(raws)

    staged = xdr.with_i128_texts(staged, {name: f"_{name}" for name in AMOUNTS})
    staged = xdr.with_addresses(staged, {name: f"_{name}" for name in ADDRESSES})
    staged = staged.withColumns(
        {
            **{name: xdr.u64_text(F.col(f"_{name}")).cast(TIME) for name in TIMES},
            "stream_id": xdr.u64_text(F.col("_id")).cast(STREAM_ID),
            "event_id": F.col("event.id"),
            "ledger": F.col("event.ledger"),
            "closed_at": closed_at_seconds(F.col("event.ledgerClosedAt")),
            "tx_hash": F.col("event.txHash"),
        }
    )
    typed = (
        staged.withColumn("error", _problem())
        .withColumn("kind", F.when(F.col("error").isNull(), kind).otherwise("unknown"))
        .select(*EVENT_COLUMNS)
    )
    return settle(typed, [c for c in EVENT_COLUMNS if c not in ("page_seq", "pos")])


def _problem() -> Column:
    """The first missing or unreadable field of an event, null when it is whole."""
    problem = None
    for known in KINDS:
        columns = ["stream_id" if f == "id" else f for f in VALUE_FIELDS[known]]
        for column in ("event_id", "ledger", "closed_at", *TOPIC_FIELDS[known], *columns):
            test = (F.col("kind") == known) & F.col(column).isNull()
            text = F.lit(f"{known}: {column} is missing or unreadable")
            problem = (F if problem is None else problem).when(test, text)
    return problem
