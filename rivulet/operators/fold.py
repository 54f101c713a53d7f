"""The fold: an ordered, exactly-once reduction of the event log to one row per payment stream.

Nothing is applied row by row. Per stream and in arrival order ``(page_seq, pos)``:

* the *seed* is the stored row if there is one, else the first event that can start the stream: a
  ``created``, or a delta for which a snapshot exists (the stream is *reconciled* from it);
* events before the seed are ``missing``; a ``created`` after it is a ``duplicate``;
* a delta after the seed is ``applied`` when its id exceeds every id the guard has seen, that is the
  running maximum over the seed and the later deltas, else it is a ``duplicate``;
* ``withdrawn`` is a running sum over applied rows, in which a cancellation is one more addend (its
  payout), and the frozen total is that sum at the last applied cancellation.

So one shuffle on ``stream_id``, one sort and three streaming windows give outcomes and state.

A stream too large for one task is folded in two levels: its pages are cut into blocks of ``PAGES_PER_BLOCK`` page numbers, every
(stream, block) is a group of its own, and is summed up in one row that says what it does to a stream that is or is not
known before it. A window over these rows carries the state from block to block, and goes back to the
rows by a join on (stream, block). Which streams are large is counted inside the plan, so building it starts no job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.functions.amounts import NumberLane, TextLane, lane_of
from rivulet.operators.skew import hot_keys, split_hot
from rivulet.schemas import EVENT_COLUMNS, OUTCOME_COLUMNS, STREAM_COLUMNS

PAGES_SETTING = "rivulet.skew.pagesPerBlock"
PAGES_PER_BLOCK = 16_384  # pages hold 100 events at most, so a block has 1.6 million at most
KINDS = ("created", "withdrawn", "cancelled")
CREATED_FIELDS = ("sender", "recipient", "token", "total_amount", "start_time", "end_time", "cliff_time")
BASE_FIELDS = (*CREATED_FIELDS, "withdrawn", "cancelled")


@dataclass(frozen=True)
class Folded:
    """``classified`` holds the rows with their outcome and ``state`` the streams after them."""

    classified: DataFrame
    failed: DataFrame
    state: DataFrame

    @property
    def outcomes(self) -> DataFrame:
        """The outcome log, with the failed attempts in it."""
        done = _with_pos(self.classified).select(*OUTCOME_COLUMNS)
        return done.unionByName(_with_pos(self.failed).select(*OUTCOME_COLUMNS[:-1], F.lit("failed").alias("outcome")))


def fold(events: DataFrame, mirror: DataFrame | None = None, snapshot: DataFrame | None = None, tasks: int | None = None) -> Folded:
    """Fold an event log, on top of a stored mirror and with snapshots as the fallback.

    Events without ``pos`` are placed in their page by ``event_id``. tasks: how many partitions the events are dealt to, for
    logs whose size is known; else the session decides.
    """
    lane = lane_of(events, "amount")
    good, failed = split_failed(events)
    rows = with_moved(good)
    facts = key_facts(mirror, snapshot)

    hot = hot_keys(rows, "stream_id")
    large, rest = split_hot(rows, "stream_id", hot)
    dealt = rest if tasks is None else rest.repartition(tasks, "stream_id")
    # A hash join does not sort the events, which the windows have to sort in an order of their own; snapshots are few.
    cold = classify(attach_facts(dealt, facts if facts is None or mirror is not None else facts.hint("shuffle_hash")), ["stream_id"])
    few = None if facts is None else F.broadcast(facts.join(F.broadcast(hot), "stream_id", "left_semi"))
    ranged = classify_blocks(attach_facts(large, few))
    classified = cold.unionByName(ranged, allowMissingColumns=True)
    deltas = sum_up(cold, ["stream_id"], lane).unionByName(stitch(sum_up(ranged, ["stream_id", "block"], lane), lane))
    return Folded(classified, failed, next_state(deltas, mirror, snapshot, lane))


def split_failed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to fold and rows for the dead letters; a bad row never holds up the others."""
    if "error" not in events.columns:
        return events, events.where(F.lit(False))
    return events.where(F.col("error").isNull()), events.where(F.col("error").isNotNull())


def _with_pos(rows: DataFrame) -> DataFrame:
    return rows if "pos" in rows.columns else rows.withColumn("pos", F.col("event_id"))


def _moved() -> Column:
    """The amount withdrawn or the payout of a cancellation."""
    return F.coalesce(F.col("amount"), F.col("recipient_amount"))


def with_moved(events: DataFrame) -> DataFrame:
    """Add what an event moves and, of a ``created``, the fields of its stream: one null column in all other events."""
    keep = [c for c in EVENT_COLUMNS if c in events.columns]
    own = F.when(F.col("kind") == "created", F.struct(*CREATED_FIELDS))
    return events.select(*keep, _moved().alias("moved"), own.alias("own"))


def with_step(events: DataFrame, lane: NumberLane | TextLane) -> DataFrame:
    """Add what an event moves, in parts."""
    parts = lane.split(_moved())
    keep = [c for c in EVENT_COLUMNS if c in events.columns]
    return events.select(*keep, *[p.alias(f"step_{n}") for n, p in zip(lane.names, parts)])


def key_facts(mirror: DataFrame | None, snapshot: DataFrame | None) -> DataFrame | None:
    """Per stream: is it stored, the last id applied to it, is there a snapshot and how far it goes."""
    stored = known = None
    if mirror is not None:
        stored = mirror.select("stream_id", F.col("last_event_id").alias("floor_id"), F.lit(True).alias("stored"))
    if snapshot is not None:
        as_of = F.col("as_of_event_id") if "as_of_event_id" in snapshot.columns else F.lit(None).cast("string")
        known = snapshot.select("stream_id", F.lit(True).alias("on_chain"), as_of.alias("as_of_event_id"))
    if stored is not None and known is not None:
        return stored.join(known, "stream_id", "full")
    return stored if stored is not None else known


def attach_facts(rows: DataFrame, facts: DataFrame | None) -> DataFrame:
    joined = rows if facts is None else rows.join(facts, "stream_id", "left")
    absent = {"stored": F.lit(False), "on_chain": F.lit(False)}
    texts = {"floor_id": F.lit(None).cast("string"), "as_of_event_id": F.lit(None).cast("string")}
    flags = {n: F.coalesce(F.col(n), v) if n in joined.columns else v for n, v in absent.items()}
    return joined.withColumns({**flags, **{n: v for n, v in texts.items() if n not in joined.columns}})


def _arrival(rows: DataFrame, keys: list[str]):
    return Window.partitionBy(*keys).orderBy("page_seq", "pos" if "pos" in rows.columns else "event_id")


def _before(rows: DataFrame, keys: list[str]):
    return _arrival(rows, keys).rowsBetween(Window.unboundedPreceding, -1)


def _find_seed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the seed row, and for every row whether the stream already existed when it arrived."""
    can_start = (F.col("kind") == "created") | F.col("on_chain")
    started = F.coalesce(F.max(can_start).over(_before(rows, keys)), F.lit(False))
    return (
        rows.withColumn("existed", F.col("stored") | started)
        .withColumn("is_seed", ~F.col("existed") & can_start)
        .withColumn(
            "guard_id",
            F.when(
                F.col("is_seed") & (F.col("kind") != "created"),
                F.greatest("event_id", "as_of_event_id"),
            ).when(F.col("is_seed") | (F.col("existed") & (F.col("kind") != "created")), F.col("event_id")),
        )
    )


def classify(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Give every row its outcome; ``floor_id`` and ``stored`` describe what came before the group."""
    seen = F.greatest("floor_id", F.max("guard_id").over(_before(rows, keys)))
    created = F.col("kind") == "created"
    outcome = (
        F.when(F.col("is_seed"), F.when(created, "applied").otherwise("reconciled"))
        .when(~F.col("existed"), "missing")
        .when(created, "duplicate")
        .when(F.col("seen_id").isNull() | (F.col("event_id") > F.col("seen_id")), "applied")
        .otherwise("duplicate")
    )
    return _find_seed(rows, keys).withColumn("seen_id", seen).withColumn("outcome", outcome)


def classify_blocks(rows: DataFrame) -> DataFrame:
    """``classify`` for streams that span many tasks."""
    blocked = rows.withColumn("block", F.floor(F.col("page_seq") / _pages_per_block(rows)))
    keys = ["stream_id", "block"]
    delta_id = F.when(F.col("kind") != "created", F.col("event_id"))
    summary = (
        _find_seed(blocked, keys)
        .groupBy(*keys)
        .agg(
            F.max("stored").alias("stored"),
            F.max("floor_id").alias("floor_id"),
            F.max(F.col("is_seed") | F.col("existed")).alias("starts"),
            F.max("guard_id").alias("guard_if_new"),
            F.max(delta_id).alias("guard_if_known"),
        )
    )
    # One row per block of a large stream.
    order = Window.partitionBy("stream_id").orderBy("block")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("known", F.col("stored") | F.coalesce(F.max("starts").over(prior), F.lit(False)))
        .withColumn("guard", F.when(F.col("known"), F.col("guard_if_known")).otherwise(F.col("guard_if_new")))
        .select(
            *keys,
            F.col("known").alias("stored"),
            F.greatest("floor_id", F.max("guard").over(prior)).alias("floor_id"),
        )
    )
    # The join has the keys of the windows after it, so it adds no shuffle of the rows.
    return classify(blocked.drop("stored", "floor_id").join(carried, keys), keys)


def _pages_per_block(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get(PAGES_SETTING, str(PAGES_PER_BLOCK)))


def sum_up(classified: DataFrame, keys: list[str], lane: NumberLane | TextLane) -> DataFrame:
    """One row per group: what the applied events moved, froze and touched last.

    Ids of applied rows rise in arrival order, so the largest id is the last one applied.
    """
    touched = F.col("outcome").isin("applied", "reconciled")
    moves = F.col("outcome").eqNullSafe("applied") & (F.col("kind") != "created")
    cancels = moves & (F.col("kind") == "cancelled")
    upto = _arrival(classified, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {
        f"run_{n}": F.sum(F.when(moves, part).otherwise(F.lit(0).cast("decimal(38,0)"))).over(upto)
        for n, part in zip(lane.names, lane.split(F.col("moved")))
    }
    at_cancel = F.struct("event_id", "closed_at", *[f"run_{n}" for n in lane.names])
    last = F.struct("guard_id", "ledger", *[f"run_{n}" for n in lane.names])
    seed = F.struct("own", F.col("ledger").alias("created_ledger"))
    return (
        classified.where(touched)
        .withColumns(running)
        .groupBy(*keys)
        .agg(
            F.max(last).alias("last"),
            F.max(F.when(cancels, at_cancel)).alias("cancel"),
            F.max(F.when(F.col("is_seed"), seed)).alias("seed"),
        )
        .select(
            *keys,
            "seed",
            F.col("last.guard_id").alias("last_event_id"),
            F.col("last.ledger").alias("updated_ledger"),
            F.col("cancel.event_id").alias("cancel_id"),
            F.col("cancel.closed_at").alias("cancelled_at"),
            *[F.col(f"last.run_{n}").alias(f"moved_{n}") for n in lane.names],
            *[F.col(f"cancel.run_{n}").alias(f"frozen_{n}") for n in lane.names],
        )
    )


def stitch(per_block: DataFrame, lane: NumberLane | TextLane) -> DataFrame:
    """Join the blocks of each stream end to end; one row per block comes in."""
    prior = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    carried = per_block.withColumns(
        {
            f"frozen_{n}": F.col(f"frozen_{n}") + F.coalesce(F.sum(f"moved_{n}").over(prior), zero)
            for n in lane.names
        }
    )
    cancel = F.struct("block", "cancel_id", "cancelled_at", *[f"frozen_{n}" for n in lane.names])
    last = F.struct("block", "last_event_id", "updated_ledger")
    return (
        carried.groupBy("stream_id")
        .agg(
            F.max("seed").alias("seed"),
            F.max(last).alias("last"),
            F.max(F.when(F.col("cancel_id").isNotNull(), cancel)).alias("cancel"),
            *[F.sum(f"moved_{n}").alias(f"moved_{n}") for n in lane.names],
        )
        .select(
            "stream_id",
            "seed",
            "last.last_event_id",
            "last.updated_ledger",
            "cancel.cancel_id",
            "cancel.cancelled_at",
            *[F.col(f"moved_{n}").cast("decimal(38,0)") for n in lane.names],
            *[F.col(f"cancel.frozen_{n}") for n in lane.names],
        )
    )


def next_state(
    deltas: DataFrame, mirror: DataFrame | None, snapshot: DataFrame | None, lane: NumberLane | TextLane
) -> DataFrame:
    """Lay the sums over what each stream started from: stored row, own ``created`` or snapshot."""
    joined = deltas
    if mirror is not None:
        stored = mirror.select("stream_id", F.struct(*[c for c in STREAM_COLUMNS if c != "stream_id"]).alias("old"))
        joined = joined.join(stored, "stream_id", "full")
    if snapshot is not None:
        chain = snapshot.select("stream_id", F.struct(*BASE_FIELDS).alias("chain"))
        joined = joined.join(chain, "stream_id", "left")

    def started_from(field: str) -> Column:
        choices = [F.col(f"old.{field}")] if mirror is not None else []
        if field in CREATED_FIELDS:
            choices.append(F.col(f"seed.own.{field}"))
        if snapshot is not None:
            # A created seed has its own values, and a stored row never asks for a snapshot.
            unborn = F.col("seed").isNotNull() & F.col("seed.own").isNull()
            choices.append(F.when(unborn, F.col(f"chain.{field}")))
        return F.coalesce(*choices) if choices else F.lit(None)

    zero = F.lit("0") if isinstance(lane, TextLane) else F.lit(0).cast("decimal(38,0)")
    none = F.lit(0).cast("decimal(38,0)")
    withdrawn0 = F.coalesce(started_from("withdrawn"), zero)
    start = lane.split(withdrawn0)
    withdrawn = lane.join([s + F.coalesce(F.col(f"moved_{n}"), none) for n, s in zip(lane.names, start)])
    frozen = lane.join([s + F.coalesce(F.col(f"frozen_{n}"), none) for n, s in zip(lane.names, start)])
    total0 = started_from("total_amount")
    was_cancelled = F.coalesce(started_from("cancelled").cast("boolean"), F.lit(False))
    old = (lambda field: [F.col(f"old.{field}")]) if mirror is not None else (lambda field: [])
    is_cancel = F.col("cancel_id").isNotNull()
    return joined.select(
        "stream_id",
        started_from("sender").alias("sender"),
        started_from("recipient").alias("recipient"),
        started_from("token").alias("token"),
        F.when(is_cancel, frozen).otherwise(total0 if isinstance(lane, TextLane) else lane.join([total0])).alias(
            "total_amount"
        ),
        withdrawn.alias("withdrawn"),
        started_from("start_time").alias("start_time"),
        F.when(is_cancel, F.col("cancelled_at")).otherwise(started_from("end_time")).alias("end_time"),
        started_from("cliff_time").alias("cliff_time"),
        (is_cancel | was_cancelled).alias("cancelled"),
        F.coalesce(*old("created_ledger"), F.col("seed.created_ledger")).alias("created_ledger"),
        F.coalesce(F.col("updated_ledger"), *old("updated_ledger")).alias("updated_ledger"),
        F.coalesce(F.col("last_event_id"), *old("last_event_id")).alias("last_event_id"),
    )
