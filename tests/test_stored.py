"""Stored layouts: same answers as plain frames, one bucket read, no shuffle of the stored side."""

import random
import re

import pytest

from rivulet.operators import reads
from rivulet.operators.fold import fold
from rivulet.schemas import stream_schema
from rivulet.sources.stored import BUCKETS, RANGES, ROWS_PER_BUCKET, SLOTS, StoredStreams, sizes
from tests.model import apply_all
from tests.test_fold import frames, make_events, make_rows, rows_of


def table(spark, n=150):
    rng = random.Random(2)
    ids = rng.sample(range(2**64 - 10**6, 2**64), n)
    rows = [(i, "hot" if k % 3 == 0 else f"s{k % 5}", f"r{k % 4}", f"t{k % 2}", "1000", "10", 0, 10, 0, False, 1, 1, "e") for k, i in enumerate(ids)]
    from decimal import Decimal

    return spark.createDataFrame([(Decimal(r[0]), *r[1:]) for r in rows], stream_schema())


PARTIES = [{}, {"sender": "hot"}, {"recipient": "r1"}, {"token": "t0"}, {"sender": "hot", "token": "t1"}, {"sender": "s1", "recipient": "r2", "token": "t0"}, {"sender": "nobody"}, {"sender": ""}]


@pytest.fixture(scope="module")
def both(spark):
    plain = table(spark).cache()
    return plain, StoredStreams.write(plain, buckets=8, ranges=5)


@pytest.mark.parametrize("parties", PARTIES)
def test_same_answers(both, parties):
    plain, stored = both
    for limit, offset in ((7, 0), (100, 3), (5, 40), (5, 1000)):
        assert stored.listed(limit, offset, **parties).collect() == reads.list_streams(plain, limit, offset, **parties).collect()
    assert stored.count(**parties).first().total == reads.count_streams(plain, **parties).first().total
    assert stored.page(5, 4, 2, **parties).collect() == reads.stream_page(plain, 5, 4, 2, **parties).collect()


def test_by_id(both):
    plain, stored = both
    some = plain.first()
    assert stored.by_id(str(some.stream_id)).collect() == [some]
    assert stored.by_id("7").count() == 0
    with pytest.raises(ValueError):
        stored.by_id("x")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_look_up_reads_its_buckets_alone(spark, both):
    plain, stored = both
    some = plain.first()
    # The plan names the buckets where a scan keeps them apart; their files are chosen alike where it does not.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in _formatted(stored.by_id(str(some.stream_id)))
        found = re.search(r"SelectedBucketsCount: (\d+) out of 8", _formatted(stored.matching(sender="hot")))
        assert int(found[1]) <= SLOTS
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    page = _plan(stored.listed(5, 5))
    assert "dynamicpruning" in page.lower() and f"{stored.name}_newest" in page  # other ranges are not opened
    assert f"{stored.name}_streams" not in _plan(stored.count(sender="hot"))


def _formatted(frame):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_layouts_grow_with_the_streams():
    assert sizes(0) == sizes(9_000) == {"buckets": BUCKETS, "ranges": RANGES}
    for rows in (10**7, 54 * 10**6, 10**9):
        assert all(rows / n <= ROWS_PER_BUCKET for n in sizes(rows).values())


def test_empty(spark):
    stored = StoredStreams.write(table(spark).limit(0), buckets=2, ranges=2)
    assert stored.listed().collect() == [] and stored.count().first().total == 0 and stored.by_id("1").collect() == []


def test_batches_join_the_stored_rows_without_shuffling_them(spark):
    rng = random.Random(5)
    events = make_events(rng, 600, 40, 10**9)
    snapshot = make_rows(rng, 40, 0.3, 10**9, False)
    log, _, known = frames(spark, events, None, snapshot, "number")
    _, whole = apply_all(events, None, snapshot)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = StoredStreams.write(fold(log.where("page_seq < 40"), None, known).state, buckets=8)
        state = fold(log.where("page_seq >= 40"), first.streams, known).state
        second = StoredStreams.write(state, buckets=8, before=first)
        assert rows_of(second.streams) == whole
        plan = _plan(state).split("Initial Plan")[-1]
        scans = [m.start() for m in re.finditer(rf"FileScan parquet [^\n]*{first.name}_streams", plan)]
        lines = plan.splitlines()
        at = [i for i, x in enumerate(lines) if f"{first.name}_streams" in x]
        assert at and scans
        for i in at:  # what stands above the scan, up to its join, has no exchange
            depth = len(re.match(r"[\s:|+\-*()\d]*", lines[i])[0])
            above = []
            for j in range(i - 1, -1, -1):
                own = len(re.match(r"[\s:|+\-*()\d]*", lines[j])[0])
                if own < depth:
                    above.append(lines[j])
                    depth = own
                    if "Join" in lines[j]:
                        break
            assert not any("Exchange" in x for x in above), above
        counted = {(r.role, r.party): r.n for r in second.table("counts").collect()}
        assert counted[("", "")] == len(whole)
        for role in ("sender", "recipient", "token"):
            for party in {v[role] for v in whole.values()}:
                assert counted[(role, party)] == sum(v[role] == party for v in whole.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
