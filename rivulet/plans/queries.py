"""The named queries, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import vesting
from rivulet.operators import failures, metrics, position
from rivulet.operators.backfill import fold_backfill
from rivulet.operators.decode import TIMES, decode_events, keep_known
from rivulet.operators.fold import KINDS, Folded, fold
from rivulet.plans.registry import DECLARED
from rivulet.schemas import EVENT_COLUMNS, OUTCOME_COLUMNS, STREAM_COLUMNS
from rivulet.session import fresh_folder, remove_folder, shared_folder, shuffles_dropped
from rivulet.sources import pages, tables
from rivulet.sources.mirror import MirrorStore
from rivulet.sources.stored import StoredStreams, sizes
from rivulet.streaming import keyed, live

AS_OF = 915_148_800  # 1999-01-01
START_LEDGER = 9_131  # 1995-01-01
CURSOR = "0000010592-1"
FROM_LEDGER = 10_592
STREAM_ID = 40
SENDER, RECIPIENT, TOKEN = "G000000042", "R000000040", "1-URGENT"
CONTRACT = "stand-in contract"
WIDEN = "0" * 30


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_log(spark, sf_dir)


def _fold(spark: SparkSession, sf_dir: str, log: DataFrame, mirror: DataFrame | None = None) -> Folded:
    """The place of an event in its page is its id here, so one of the two columns is enough. Events on top of stored rows are dealt as these are."""
    tasks = tables.fold_tasks(spark, sf_dir) if mirror is None else None
    return fold(log.drop("pos"), mirror, tables.snapshots(spark, sf_dir), tasks)


def _folded(spark: SparkSession, sf_dir: str) -> Folded:
    return _fold(spark, sf_dir, _log(spark, sf_dir))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).state


def _texts(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.col(n).cast("string") for n in names})


# -- events ---------------------------------------------------------------------------------------


def events_typed(spark, sf_dir):
    return _log(spark, sf_dir).select(*[c for c in EVENT_COLUMNS if c not in ("pos", "error")])


def events_unknown_skipped(spark, sf_dir):
    names = tables.event_names(spark, sf_dir)
    kept = keep_known(names, "name").groupBy("name").count().withColumn("verdict", F.lit("kept"))
    skipped = names.where(~F.col("name").isin(*KINDS)).groupBy("name").count().withColumn("verdict", F.lit("skipped"))
    return kept.unionByName(skipped).withColumnRenamed("count", "n")


def events_from_cursor(spark, sf_dir):
    rows = pages.start_at(_log(spark, sf_dir), cursor=CURSOR, start_ledger=START_LEDGER)
    return rows.select("page_seq", "event_id", "kind", "stream_id", "ledger")


def events_from_ledger(spark, sf_dir):
    rows = pages.start_at(_log(spark, sf_dir), start_ledger=FROM_LEDGER)
    return rows.select("page_seq", "event_id", "kind", "stream_id", "ledger")


def decode_raw_pages(spark, sf_dir):
    """Every event to its wire form, into JSON pages, and back."""
    raw = pages.encode_pages(tables.event_log(spark, sf_dir, (0,)).drop("error"), CONTRACT)
    text = raw.select(F.to_json(F.struct("page_seq", "result")).alias("value"))
    events = decode_events(pages.page_events(pages.parse_pages(text), CONTRACT))
    return events.withColumns({c: F.col(c).cast("bigint") for c in ("stream_id", *TIMES)}).select(
        *[c for c in EVENT_COLUMNS if c not in ("page_seq", "pos")]
    )


# -- fold -----------------------------------------------------------------------------------------


def apply_outcomes(spark, sf_dir):
    return _folded(spark, sf_dir).outcomes.select(*[c for c in OUTCOME_COLUMNS if c != "pos"])


def outcome_counts(spark, sf_dir):
    done = _folded(spark, sf_dir).classified
    return metrics.counter(done, ["kind", "outcome"])


def stream_state(spark, sf_dir):
    return _texts(_state(spark, sf_dir), "total_amount", "withdrawn")


def stream_state_incremental(spark, sf_dir):
    """Pass 0 into stored rows bucketed by stream id, then pass 1 on top of them."""
    first = _fold(spark, sf_dir, tables.event_log(spark, sf_dir, (0,))).state
    mirror = StoredStreams.write(first, **sizes(tables.stream_rows(spark, sf_dir)), lookups=False).streams
    state = _fold(spark, sf_dir, tables.event_log(spark, sf_dir, (1,)), mirror).state
    return _texts(state, "total_amount", "withdrawn")


def stream_state_backfill(spark, sf_dir):
    log = tables.event_log(spark, sf_dir, (0,))
    return _texts(fold_backfill(log, tables.snapshots(spark, sf_dir)), "total_amount", "withdrawn")


def created_inserts(spark, sf_dir):
    done = _folded(spark, sf_dir).classified
    rows = done.where((F.col("kind") == "created") & (F.col("outcome") == "applied"))
    return rows.select(
        "stream_id", "event_id", "sender", "recipient", "token", "total_amount", "start_time", "end_time", "cliff_time"
    )


def withdrawal_totals(spark, sf_dir):
    done = _folded(spark, sf_dir).classified
    return (
        done.where((F.col("kind") == "withdrawn") & (F.col("outcome") == "applied"))
        .groupBy("stream_id")
        .agg(F.sum("amount").alias("drawn"), F.count(F.lit(1)).alias("withdrawals"))
    )


def cancel_freeze(spark, sf_dir):
    rows = _state(spark, sf_dir).where("cancelled")
    return _texts(rows, "total_amount", "withdrawn").select(
        "stream_id", "total_amount", "withdrawn", "end_time", "updated_ledger", "last_event_id"
    )


def replay_is_noop(spark, sf_dir):
    """The whole log again on top of its own result: nothing may change."""
    shared_folder(spark)
    log = _log(spark, sf_dir)
    mirror = _fold(spark, sf_dir, log).state.checkpoint()
    again = _fold(spark, sf_dir, log, mirror).classified
    return again.groupBy("kind").agg(
        F.count(F.lit(1)).alias("replayed"),
        F.count_if(F.col("outcome").isin("applied", "reconciled")).alias("changed"),
    )


def reconciled_streams(spark, sf_dir):
    folded = _folded(spark, sf_dir)
    seeds = folded.classified.where(F.col("outcome") == "reconciled").select("stream_id", "event_id", "ledger")
    state = _texts(folded.state, "total_amount", "withdrawn").select(
        "stream_id", "sender", "total_amount", "withdrawn", "created_ledger"
    )
    return seeds.join(state, "stream_id")


def missing_events(spark, sf_dir):
    done = _folded(spark, sf_dir).classified
    return done.where(F.col("outcome") == "missing").select("page_seq", "event_id", "stream_id", "ledger")


LANDINGS = 3


def _land_in_turns(spark, sf_dir, folder):
    """The log as raw pages, landed in turns: yields after each of them. The place of an event in its page is its id."""
    # Packed by columns: a checkpoint keeps plain rows, many times as large.
    pages.encode_pages(_log(spark, sf_dir).drop("pos"), CONTRACT).write.parquet(f"{folder}/encoded", compression="zstd")
    numbered = pages.number_pages(spark.read.parquet(f"{folder}/encoded"))
    last = numbered.agg(F.max("page_seq")).first()[0] + 1
    for turn in range(LANDINGS):
        here = F.col("page_seq").between(turn * last // LANDINGS, (turn + 1) * last // LANDINGS - 1)
        pages.write_pages(numbered.where(here), f"{folder}/pages")
        if turn == LANDINGS - 1:  # all of it has landed
            remove_folder(spark, f"{folder}/encoded")
        yield turn


def _wire_snapshots(spark, sf_dir):
    """Snapshots as the live path meets them: amounts as texts, parties as addresses."""
    plain = _texts(tables.snapshots(spark, sf_dir), "total_amount", "withdrawn")
    named = pages.with_party_addresses(plain, "sender", "recipient", "token")
    return named.withColumn("stream_id", F.col("stream_id").cast("decimal(20,0)"))


def _by_name(spark, sf_dir, streams):
    """Rows of the live path with the names of their parties in place of addresses."""
    known = tables.base_streams(spark, sf_dir).select("sender", "recipient", "token")
    book = known.select(F.explode(F.array(*known.columns)).alias("name")).distinct()
    book = pages.with_party_addresses(book.withColumn("address", F.col("name")), "address")
    for party in known.columns:
        own = book.select(F.col("address").alias(party), F.col("name").alias(f"{party}_name"))
        streams = streams.join(own, party, "left").drop(party).withColumnRenamed(f"{party}_name", party)
    return streams.withColumns({c: F.col(c).cast("bigint") for c in ("stream_id", *TIMES)}).select(*STREAM_COLUMNS)


def _live_store(spark, sf_dir):
    """The store after the landed pages were drained in turns."""
    folder = fresh_folder(spark, "live")
    snapshot = _wire_snapshots(spark, sf_dir)
    store = MirrorStore(spark, f"{folder}/mirror", buckets=16)
    with shuffles_dropped(spark):
        for _ in _land_in_turns(spark, sf_dir, folder):
            live.drain(
                spark, f"{folder}/pages", f"{folder}/log", f"{folder}/checkpoint", store, snapshot, CONTRACT, floor=START_LEDGER - 1, remove_landed=True
            )
    return store


def live_apply(spark, sf_dir):
    """The log as raw pages, landed in turns and drained by the live path after each of them."""
    return _by_name(spark, sf_dir, _live_store(spark, sf_dir).streams())


def live_counters(spark, sf_dir):
    """Events by kind and outcome as kept over the drains; failed attempts have a counter of their own."""
    return _live_store(spark, sf_dir).counters().where("outcome <> 'failed'")


def live_state(spark, sf_dir):
    """The same landings through the stateful stream, whose rows live in the state store between runs."""
    folder = fresh_folder(spark, "keyed")
    snapshot = _wire_snapshots(spark, sf_dir)
    slots = max(keyed.DEFAULT_SLOTS, -(-tables.stream_rows(spark, sf_dir) // keyed.STREAMS_PER_SLOT))
    with shuffles_dropped(spark):
        for _ in _land_in_turns(spark, sf_dir, folder):
            keyed.start(spark, f"{folder}/pages", f"{folder}/out", f"{folder}/checkpoint", snapshot, CONTRACT, slots=slots).awaitTermination()
    return _by_name(spark, sf_dir, keyed.streams(spark, f"{folder}/out"))


# -- failures -------------------------------------------------------------------------------------


def failed_events(spark, sf_dir):
    return failures.record_failures(failures.attempts_failed(_log(spark, sf_dir)))


def failed_events_open(spark, sf_dir):
    return failures.open_failures(_log(spark, sf_dir))


def failed_events_oldest(spark, sf_dir):
    return failures.oldest_failures(failures.open_failures(_log(spark, sf_dir)))


# -- position -------------------------------------------------------------------------------------


def _progress(spark, sf_dir):
    return tables.page_progress(_log(spark, sf_dir))


def _floor() -> int:
    """No position is stored, so all before the configured ledger counts as done (``position.start_of``)."""
    return START_LEDGER - 1


def position_now(spark, sf_dir):
    return position.position(_progress(spark, sf_dir), _floor())


def position_history(spark, sf_dir):
    return position.position_history(_progress(spark, sf_dir), _floor())


def status_report(spark, sf_dir):
    return position.status_report(position_now(spark, sf_dir))


# -- reads ----------------------------------------------------------------------------------------


_STORED: dict[tuple[str, str], StoredStreams] = {}


def _stored(spark, sf_dir) -> StoredStreams:
    """The folded streams in their layouts for look-ups, written once a session; all reads share them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = StoredStreams.write(_state(spark, sf_dir), **sizes(tables.stream_rows(spark, sf_dir)))
    return _STORED[key]


def stream_by_id(spark, sf_dir):
    return vesting.view(_stored(spark, sf_dir).by_id(STREAM_ID), AS_OF)


def _listed(spark, sf_dir, **arguments):
    return vesting.view(_stored(spark, sf_dir).listed(**arguments), AS_OF)


def streams_by_sender(spark, sf_dir):
    return _listed(spark, sf_dir, sender=SENDER, limit=100)


def streams_by_recipient(spark, sf_dir):
    return _listed(spark, sf_dir, recipient=RECIPIENT)


def streams_by_token(spark, sf_dir):
    return _listed(spark, sf_dir, token=TOKEN)


def streams_by_all(spark, sf_dir):
    """Filter by the three parties of one known stream."""
    known = _stored(spark, sf_dir).by_id(STREAM_ID).first()
    return _listed(spark, sf_dir, sender=known.sender, recipient=known.recipient, token=known.token)


def streams_page(spark, sf_dir):
    return _listed(spark, sf_dir, limit="50", offset="100")


def streams_deep_page(spark, sf_dir):
    """A page far down the list, found by the counts of its ranges."""
    return _listed(spark, sf_dir, limit="100", offset="1200")


def streams_count(spark, sf_dir):
    return _stored(spark, sf_dir).count(token=TOKEN)


def streams_envelope(spark, sf_dir):
    page = _stored(spark, sf_dir).page(AS_OF, limit="20", offset="10", token=TOKEN)
    return page.withColumn("streams", F.to_json("streams"))


# -- valuation ------------------------------------------------------------------------------------


def vesting_asof(spark, sf_dir):
    return vesting.with_vested(_state(spark, sf_dir), AS_OF).select("stream_id", "vested")


def withdrawable_asof(spark, sf_dir):
    valued = vesting.with_withdrawable(vesting.with_vested(_state(spark, sf_dir), AS_OF))
    return valued.select("stream_id", "vested", "withdrawable", "locked")


def progress_asof(spark, sf_dir):
    valued = vesting.with_progress(vesting.with_vested(_state(spark, sf_dir), AS_OF))
    return valued.select("stream_id", "progress")


def status_asof(spark, sf_dir):
    return _state(spark, sf_dir).select("stream_id", vesting.status_of(vesting.clock(AS_OF)).alias("status"))


def stream_view(spark, sf_dir):
    return vesting.view(_state(spark, sf_dir), AS_OF)


def vesting_wide(spark, sf_dir):
    """Amounts of up to 38 digits: every total and balance with thirty zeros more."""
    wide = _state(spark, sf_dir).withColumns(
        {n: F.concat(F.col(n).cast("string"), F.lit(WIDEN)) for n in ("total_amount", "withdrawn")}
    )
    valued = vesting.with_valuation(wide, AS_OF)
    return valued.select("stream_id", "vested", "withdrawable", "locked", "progress")


# -- metrics --------------------------------------------------------------------------------------

REQUEST_LABELS = ["method", "route", "status"]


def request_counter(spark, sf_dir):
    return metrics.counter(tables.request_log(spark, sf_dir), REQUEST_LABELS)


def request_histogram(spark, sf_dir):
    rows = metrics.histogram(tables.request_log(spark, sf_dir), REQUEST_LABELS, "duration_ms")
    return _texts(rows, "sum").drop("bucket_no")


REQUEST_DRAINS = 3


def request_metrics_merged(spark, sf_dir):
    """The histogram of all requests from the summaries of three drains, each written and merged into the one before."""
    folder = fresh_folder(spark, "metrics")
    requests = tables.request_log(spark, sf_dir)
    kept = None
    for drain in range(REQUEST_DRAINS):
        part = requests.where(F.pmod(F.col("event_id"), F.lit(REQUEST_DRAINS)) == drain)
        fresh = metrics.summary(part, REQUEST_LABELS, "duration_ms", ["ts", "event_id"])
        merged = fresh if kept is None else metrics.merge(REQUEST_LABELS, kept, fresh)
        merged.write.parquet(f"{folder}/{drain}")
        kept = spark.read.parquet(f"{folder}/{drain}")
    return _texts(metrics.histogram_of(kept, REQUEST_LABELS), "sum").drop("bucket_no")


def gauge_last(spark, sf_dir):
    rows = metrics.gauge(tables.request_log(spark, sf_dir), ["user_id"], "duration_ms", ["ts", "event_id"])
    return _texts(rows, "value")


def failed_counter(spark, sf_dir):
    return metrics.counter(failures.attempts_failed(_log(spark, sf_dir)), ["kind"])


def pages_counter(spark, sf_dir):
    return metrics.counter(tables.page_heads(_log(spark, sf_dir)), [])


def error_counter(spark, sf_dir):
    errors = tables.request_log(spark, sf_dir).where(F.col("status") == "500")
    return metrics.counter(errors.withColumnRenamed("route", "operation"), ["operation"])


def lag_gauge(spark, sf_dir):
    return status_report(spark, sf_dir).select("lag_ledgers")


def drain_faults(spark, sf_dir):
    """No drain can break off here, so this one shows how a metric without samples is written."""
    faults = tables.request_log(spark, sf_dir).where(F.col("status") == "drain")
    return metrics.counter(faults, []).where("value > 0")


SAMPLES = {
    "outcome_counts": outcome_counts,
    "failed_counter": failed_counter,
    "pages_counter": pages_counter,
    "lag_gauge": lambda spark, sf_dir: lag_gauge(spark, sf_dir).where("lag_ledgers IS NOT NULL").select(F.col("lag_ledgers").alias("value")),
    "request_counter": request_counter,
    "request_histogram": lambda spark, sf_dir: metrics.histogram(tables.request_log(spark, sf_dir), REQUEST_LABELS, "duration_ms"),
    "error_counter": error_counter,
    "drain_faults": drain_faults,
}


def exposition_lines(spark, sf_dir):
    declared = [metrics.Metric(d.name, d.help, d.kind, SAMPLES[d.source](spark, sf_dir), list(d.labels)) for d in DECLARED]
    return metrics.exposition(declared).select("metric_no", "label_text", "line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events_typed": events_typed,
    "events_unknown_skipped": events_unknown_skipped,
    "events_from_cursor": events_from_cursor,
    "events_from_ledger": events_from_ledger,
    "decode_raw_pages": decode_raw_pages,
    "apply_outcomes": apply_outcomes,
    "outcome_counts": outcome_counts,
    "stream_state": stream_state,
    "stream_state_incremental": stream_state_incremental,
    "stream_state_backfill": stream_state_backfill,
    "live_apply": live_apply,
    "live_state": live_state,
    "live_counters": live_counters,
    "created_inserts": created_inserts,
    "withdrawal_totals": withdrawal_totals,
    "cancel_freeze": cancel_freeze,
    "replay_is_noop": replay_is_noop,
    "reconciled_streams": reconciled_streams,
    "missing_events": missing_events,
    "failed_events": failed_events,
    "failed_events_open": failed_events_open,
    "failed_events_oldest": failed_events_oldest,
    "position": position_now,
    "position_history": position_history,
    "status_report": status_report,
    "stream_by_id": stream_by_id,
    "streams_by_sender": streams_by_sender,
    "streams_by_recipient": streams_by_recipient,
    "streams_by_token": streams_by_token,
    "streams_by_all": streams_by_all,
    "streams_page": streams_page,
    "streams_deep_page": streams_deep_page,
    "streams_count": streams_count,
    "streams_envelope": streams_envelope,
    "vesting_asof": vesting_asof,
    "withdrawable_asof": withdrawable_asof,
    "progress_asof": progress_asof,
    "status_asof": status_asof,
    "stream_view": stream_view,
    "vesting_wide": vesting_wide,
    "request_counter": request_counter,
    "request_histogram": request_histogram,
    "request_metrics_merged": request_metrics_merged,
    "gauge_last": gauge_last,
    "failed_counter": failed_counter,
    "pages_counter": pages_counter,
    "error_counter": error_counter,
    "lag_gauge": lag_gauge,
    "exposition_lines": exposition_lines,
}
