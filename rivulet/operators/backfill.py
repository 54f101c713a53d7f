"""Window-free fold for a first load: an empty mirror and a log that arrives in chain order.

Arrival order then equals id order, so the seed is a minimum, the last cancellation a maximum, and
both totals are plain sums. One grouped aggregate finds where each stream starts and where it was last cancelled, a second one sums what
lies behind that. Both are combined on the map side before they are shuffled, and no window orders the events
of a stream, so a single stream that holds most of the log costs no more than many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.amounts import lane_of
from rivulet.operators.fold import CREATED_FIELDS, next_state, split_failed, with_step
from rivulet.operators.skew import hot_keys, join_by_key


def fold_backfill(events: DataFrame, snapshot: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """State of every stream. ``unique`` promises that no event occurs twice and saves a shuffle."""
    lane = lane_of(events, "amount")
    rows = with_step(split_failed(events)[0], lane)
    bounds = _bounds(rows, snapshot)
    steps = [f"step_{n}" for n in lane.names]
    moves = rows.where(F.col("kind") != "created").select("stream_id", "event_id", "ledger", *steps)
    if not unique:
        # Copies of an event are equal, so any aggregate of them is the event; a maximum of numbers
        # keeps this a hash aggregate. Minimum and maximum ids above need no such care.
        moves = moves.groupBy("stream_id", "event_id").agg(*[F.max(c).alias(c) for c in ("ledger", *steps)])
    upto_cancel = F.col("event_id") <= F.col("cancel_id")
    sums = (
        join_by_key(moves, bounds.select("stream_id", "seed_id", "cancel_id"), "stream_id", hot_keys(moves, "stream_id"))
        .where("event_id > seed_id")
        .groupBy("stream_id")
        .agg(
            F.max(F.struct("event_id", "ledger")).alias("last"),
            *[F.sum(f"step_{n}").cast("decimal(38,0)").alias(f"moved_{n}") for n in lane.names],
            *[
                F.sum(F.when(upto_cancel, F.col(f"step_{n}"))).cast("decimal(38,0)").alias(f"frozen_{n}")
                for n in lane.names
            ],
        )
    )
    deltas = (
        bounds.join(sums, "stream_id", "left")
        .select(
            "stream_id",
            "seed",
            F.coalesce("last.event_id", "seed_event").alias("last_event_id"),
            F.coalesce("last.ledger", "seed.created_ledger").alias("updated_ledger"),
            "cancel_id",
            "cancelled_at",
            *[f"moved_{n}" for n in lane.names],
            *[f"frozen_{n}" for n in lane.names],
        )
    )
    return next_state(deltas, None, snapshot, lane)


def _bounds(rows: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """Per stream its seed (the first ``created`` or, with a snapshot, the first event) and its last cancellation after that."""
    own = F.struct(*CREATED_FIELDS)
    created, cancelled = F.col("kind") == "created", F.col("kind") == "cancelled"
    first = rows.groupBy("stream_id").agg(
        F.min(F.when(created, F.struct("event_id", own.alias("own"), "ledger"))).alias("birth"),
        F.min(F.when(~created, F.struct("event_id", "ledger"))).alias("delta"),
        F.max(F.when(cancelled, F.struct("event_id", "closed_at"))).alias("cancel"),
    )
    if snapshot is None:
        first = first.withColumn("on_chain", F.lit(False)).withColumn("as_of", F.lit(None).cast("string"))
    else:
        as_of = F.col("as_of_event_id") if "as_of_event_id" in snapshot.columns else F.lit(None).cast("string")
        known = snapshot.groupBy("stream_id").agg(F.max(as_of).alias("as_of"), F.lit(True).alias("on_chain"))
        first = first.join(known, "stream_id", "left")
    # An adopted stream starts at its first delta, if that comes before its creation; events inside the snapshot are not added again.
    adopted = F.coalesce("on_chain", F.lit(False)) & F.col("delta").isNotNull() & (F.col("birth").isNull() | (F.col("delta.event_id") < F.col("birth.event_id")))
    seeds = first.withColumn("adopted", adopted).where(F.col("adopted") | F.col("birth").isNotNull())
    seed_event = F.when(F.col("adopted"), F.col("delta.event_id")).otherwise(F.col("birth.event_id"))
    seed_id = F.when(F.col("adopted"), F.greatest("delta.event_id", "as_of")).otherwise(F.col("birth.event_id"))
    seed = F.struct(F.when(~F.col("adopted"), F.col("birth.own")).alias("own"), F.when(F.col("adopted"), F.col("delta.ledger")).otherwise(F.col("birth.ledger")).alias("created_ledger"))
    seeds = seeds.select("stream_id", seed_id.alias("seed_id"), seed_event.alias("seed_event"), seed.alias("seed"), "cancel")
    last = F.when(F.col("cancel.event_id") > F.col("seed_id"), F.col("cancel"))
    return seeds.withColumn("cancel", last).select("stream_id", "seed_id", "seed_event", "seed", F.col("cancel.event_id").alias("cancel_id"), F.col("cancel.closed_at").alias("cancelled_at"))
