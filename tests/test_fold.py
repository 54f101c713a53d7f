"""The fold against a sequential model: random logs, seeds, lanes, hot streams, replays."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.backfill import fold_backfill
from rivulet.operators.fold import PAGES_SETTING, fold
from rivulet.operators.skew import HOT_ROWS_SETTING
from rivulet.schemas import event_schema, snapshot_schema, stream_schema
from tests.model import apply_all

LANES = {"number": T.LongType(), "text": T.StringType()}
AMOUNTS = ("total_amount", "withdrawn", "amount", "recipient_amount", "sender_refund")


def make_events(rng, n, keys, scale, ordered=False, hot=0.0, failing=0.1, replays=0.2):
    events = []
    for i in range(n):
        kind = rng.choices(["created", "withdrawn", "cancelled"], [2, 6, 1])[0]
        ledger = i if ordered else rng.randrange(n)
        key = 0 if rng.random() < hot else rng.randrange(keys)
        e = dict.fromkeys(event_schema().fieldNames())
        e.update(
            page_seq=i // 7,
            pos=i % 7,
            event_id=f"{ledger:08d}-{rng.randrange(3) if not ordered else 0}",
            kind=kind,
            stream_id=key,
            ledger=ledger,
            closed_at=1000 + ledger,
            tx_hash="x",
            error="broken" if rng.random() < failing else None,
        )
        if kind == "created":
            e.update(sender=f"s{i}", recipient=f"r{i}", token="t", total_amount=rng.randrange(scale), start_time=i, end_time=i + 9, cliff_time=i)
        elif kind == "withdrawn":
            e.update(recipient="r", amount=rng.randrange(scale))
        else:
            e.update(sender="s", recipient_amount=rng.randrange(scale), sender_refund=1)
        events.append(e)
    for i in range(int(n * replays)):
        copy = dict(rng.choice(events))
        copy.update(page_seq=n + i // 5, pos=i % 5)
        events.append(copy)
    return events


def make_rows(rng, keys, share, scale, stored):
    rows = {}
    for key in range(keys):
        if rng.random() < share:
            rows[key] = dict(
                sender=f"S{key}", recipient=f"R{key}", token="T", total_amount=rng.randrange(scale),
                withdrawn=rng.randrange(scale), start_time=key, end_time=key + 5, cliff_time=key, cancelled=rng.random() < 0.2,
            )
            some_id = f"{rng.randrange(400):08d}-1" if rng.random() < 0.5 else None
            if stored:
                rows[key].update(created_ledger=1, updated_ledger=2, last_event_id=some_id)
            else:
                rows[key].update(as_of_event_id=some_id)
    return rows


def frame(spark, rows, schema, lane):
    def fit(name, value):
        return str(value) if lane == "text" and name in AMOUNTS and value is not None else value

    names = schema.fieldNames()
    data = [tuple(fit(n, r.get(n)) for n in names) for r in rows]
    return spark.createDataFrame(data, schema).repartition(3)


def frames(spark, events, mirror, snapshot, lane):
    kind = LANES[lane]
    log = frame(spark, events, event_schema(kind, T.LongType()), lane)
    stored = known = None
    if mirror is not None:
        rows = [{"stream_id": k, **v} for k, v in mirror.items()]
        stored = frame(spark, rows, stream_schema(kind, T.LongType()), lane)
    if snapshot is not None:
        rows = [{"stream_id": k, **v} for k, v in snapshot.items()]
        known = frame(spark, rows, snapshot_schema(kind, T.LongType()), lane)
    return log, stored, known


def rows_of(state):
    return {
        r.stream_id: {
            n: int(v) if n in AMOUNTS else v for n, v in r.asDict().items() if n != "stream_id"
        }
        for r in state.collect()
    }


@pytest.fixture
def hot_limit(spark):
    def limit(n):
        spark.conf.set(HOT_ROWS_SETTING, str(n))
        spark.conf.set(PAGES_SETTING, "13")

    yield limit
    spark.conf.unset(HOT_ROWS_SETTING)
    spark.conf.unset(PAGES_SETTING)


@pytest.mark.parametrize("lane,seeded,hot", [
    ("number", False, False), ("number", True, False), ("text", True, False),
    ("number", True, True), ("text", True, True),
])
def test_matches_the_model(spark, hot_limit, lane, seeded, hot):
    rng = random.Random(f"{lane}{seeded}{hot}")
    scale = 2**127 if lane == "text" else 10**12
    events = make_events(rng, 1500, 60, scale, hot=0.4 if hot else 0.0)
    mirror = make_rows(rng, 60, 0.3, scale, True) if seeded else None
    snapshot = make_rows(rng, 60, 0.4, scale, False) if seeded else None
    if hot:
        hot_limit(40)
        # The hot stream must find its seed by itself, somewhere inside its ranges.
        mirror.pop(0, None)
        snapshot.pop(0, None)
        created = [e for e in events if e["stream_id"] == 0 and e["kind"] == "created"]
        for e in created[: len(created) // 2]:
            e["error"] = "broken"
    outcomes, rows = apply_all(events, mirror, snapshot)
    folded = fold(*frames(spark, events, mirror, snapshot, lane))
    assert {(r.page_seq, r.pos): r.outcome for r in folded.outcomes.collect()} == outcomes
    assert rows_of(folded.state) == rows


@pytest.mark.parametrize("known", ["stored", "snapshot"])
def test_hot_stream_with_a_base(spark, hot_limit, known):
    rng = random.Random(known)
    events = make_events(rng, 800, 5, 10**9, hot=0.5)
    mirror = make_rows(rng, 5, 1.0, 10**9, True) if known == "stored" else None
    snapshot = make_rows(rng, 5, 1.0, 10**9, False) if known == "snapshot" else None
    hot_limit(30)
    outcomes, rows = apply_all(events, mirror, snapshot)
    folded = fold(*frames(spark, events, mirror, snapshot, "number"))
    assert {(r.page_seq, r.pos): r.outcome for r in folded.outcomes.collect()} == outcomes
    assert rows_of(folded.state) == rows


def test_two_batches_equal_one(spark):
    rng = random.Random(5)
    events = make_events(rng, 900, 40, 10**9)
    snapshot = make_rows(rng, 40, 0.3, 10**9, False)
    log, _, known = frames(spark, events, None, snapshot, "number")
    whole = rows_of(fold(log, None, known).state)
    first = fold(log.where("page_seq < 60"), None, known).state
    second = fold(log.where("page_seq >= 60"), first, known).state
    assert rows_of(second) == whole


def test_replaying_everything_changes_nothing(spark):
    rng = random.Random(6)
    # In chain order: out of it, an event that was missing at first may rightly apply later.
    events = make_events(rng, 600, 30, 10**9, ordered=True, failing=0.0)
    log, _, _ = frames(spark, events, None, None, "number")
    once = rows_of(fold(log).state)
    again = log.withColumn("page_seq", F.col("page_seq") + 10_000)
    assert rows_of(fold(log.unionByName(again)).state) == once


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("lane", ["number", "text"])
def test_backfill_equals_the_model_on_an_ordered_log(spark, hot_limit, lane, hot):
    rng = random.Random(7)
    scale = 2**127 if lane == "text" else 10**12
    events = make_events(rng, 900, 40, scale, ordered=True, hot=0.3)
    # A failed attempt whose copy succeeds later would break the order that a backfill promises.
    bad = {e["event_id"] for e in events if e["error"]}
    events = [e for e in events if e["event_id"] not in bad]
    snapshot = make_rows(rng, 40, 0.3, scale, False)
    if hot:
        hot_limit(30)
    _, rows = apply_all([e for e in events if e["page_seq"] < 900], None, snapshot)
    log, _, known = frames(spark, events, None, snapshot, lane)
    assert rows_of(fold_backfill(log, known)) == rows


def test_building_the_plan_starts_no_job(spark):
    rng = random.Random(9)
    log, _, known = frames(spark, make_events(rng, 100, 5, 10**9), None, make_rows(rng, 5, 0.5, 10**9, False), "number")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        folded = fold(log, None, known)
        folded.state.explain(True)
        assert tracker.getJobIdsForGroup("building") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert folded.state.count() > 0


def test_events_are_shuffled_narrow_and_sorted_once(spark):
    """The state asks for no second place in the page and no parts of amounts from the shuffle, and no join sorts the events."""
    rng = random.Random(11)
    events = make_events(rng, 900, 40, 10**9)
    for e in events:
        e["event_id"] = f"{e['event_id']}-{e['page_seq']:06d}-{e['pos']:06d}"
    snapshot = make_rows(rng, 40, 0.3, 10**9, False)
    log, _, known = frames(spark, events, None, snapshot, "number")
    log = log.withColumn("pos", F.col("event_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = fold(log.drop("pos"), None, known, tasks=7)
        plan = folded.state._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [stream_id" in plan
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(stream_id" in line and "page_seq" in line]
        assert all("recipient" not in line and "step_n" not in line for line in dealt)
        whole = fold(log, None, known)
        assert rows_of(folded.state) == rows_of(whole.state)
        assert sorted(folded.outcomes.collect()) == sorted(whole.outcomes.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    _, rows = apply_all([{**e, "pos": e["event_id"]} for e in events], None, snapshot)
    assert rows_of(folded.state) == rows
