"""Failures, position, reads and metrics on small hand-made inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.operators import failures, metrics, position, reads, skew
from rivulet.operators.skew import HOT_ROWS_SETTING
from rivulet.sources import tables
from rivulet.sources.stored import StoredStreams
from rivulet.schemas import event_schema, stream_schema

EVENTS = "page_seq long, pos int, event_id string, kind string, stream_id long, ledger long, error string"


def events(spark, *rows):
    return spark.createDataFrame(rows, EVENTS)


# -- failures -------------------------------------------------------------------------------------


def attempts(spark):
    return events(
        spark,
        (0, 0, "a", "withdrawn", 1, 5, "first"),
        (1, 0, "a", "withdrawn", 1, 5, "second"),
        (0, 1, "b", "cancelled", 2, 4, "once"),
        (1, 1, "b", "cancelled", 2, 4, None),
        (0, 2, "c", "withdrawn", 3, 3, "before"),
        (1, 2, "c", "withdrawn", 3, 3, None),
        (2, 2, "c", "withdrawn", 3, 3, "after"),
        (0, 3, "d", "created", 4, 1, None),
    )


def as_dict(frame):
    return {r.event_id: (r.kind, r.stream_id, r.ledger, r.error, r.failure_count) for r in frame.collect()}


def test_failures_count_and_keep_the_newest_error(spark):
    recorded = failures.record_failures(failures.attempts_failed(attempts(spark)))
    assert as_dict(recorded)["a"] == ("withdrawn", "1", 5, "second", 2)


@pytest.mark.parametrize("limit", [None, 1])
def test_a_success_clears_and_later_failures_start_again(spark, limit):
    if limit:
        spark.conf.set(HOT_ROWS_SETTING, str(limit))
    try:
        assert as_dict(failures.open_failures(attempts(spark))) == {
            "a": ("withdrawn", "1", 5, "second", 2),
            "c": ("withdrawn", "3", 3, "after", 1),
        }
    finally:
        spark.conf.unset(HOT_ROWS_SETTING)


def test_failures_in_two_batches_equal_one(spark):
    whole = attempts(spark)
    first = failures.open_failures(whole.where("page_seq = 0"))
    second = failures.open_failures(whole.where("page_seq > 0"), first)
    assert as_dict(second) == as_dict(failures.open_failures(whole))


def test_oldest_failures_first(spark):
    listed = failures.oldest_failures(failures.open_failures(attempts(spark)), 1).collect()
    assert [r.event_id for r in listed] == ["c"]


# -- position -------------------------------------------------------------------------------------

HEAD, START = 56999999, 56000000
GOLDEN = [(0, 0, "e1", "created", 1, 56123890, None), (0, 1, "e2", "withdrawn", 1, 56201455, None),
          (0, 2, "e3", "cancelled", 1, 56290012, None), (0, 3, "e4", "created", 2, 56290013, None)]


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_seq long, latest_ledger long, cursor string")


def test_start_positions(spark):
    def start(saved, ledger):
        rows = spark.createDataFrame(saved, "last_ledger long, cursor string")
        return tuple(position.start_of(rows, ledger, HEAD).first())

    assert start([(7, "c")], START) == (7, "c", None)
    assert start([], START) == (START - 1, None, START)
    assert start([(7, None)], 0) == (HEAD, None, HEAD)
    assert start([(7, "")], START) == (START - 1, None, START)


@pytest.mark.parametrize("rows,expected", [
    (GOLDEN, 56290013),
    ([], START - 1),
    (GOLDEN[:3] + [(*GOLDEN[3][:6], "broken")], 56290012),
])
def test_position_after_one_page(spark, rows, expected):
    log = events(spark, *rows) if rows else spark.createDataFrame([], EVENTS)
    row = position.position(position.page_progress(log, pages(spark, (0, HEAD, "cur"))), START - 1).first()
    assert tuple(row) == (expected, HEAD, "cur")


@pytest.mark.parametrize("saved,report", [
    ([(56290013, 56999999, "c")], (True, 56290013, "c", 56999999, 709986)),
    ([(56999999, 56999999, "c")], (True, 56999999, "c", 56999999, 0)),
    ([(57000005, 56999999, None)], (True, 57000005, None, 56999999, 0)),
    ([], (False, 0, None, 0, None)),
])
def test_status(spark, saved, report):
    frame = spark.createDataFrame(saved, "last_ledger long, chain_ledger long, cursor string")
    assert tuple(position.status_report(frame).first()) == report


def test_history_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(position, "PAGES_PER_BLOCK", 2)
    progress = spark.createDataFrame(
        [(0, 90, "a", 5), (1, 91, "b", None), (2, 92, "c", 3), (3, 93, "d", 9), (4, 94, "e", None)],
        "page_seq long, latest_ledger long, cursor string, done_ledger long",
    )
    rows = position.position_history(progress, 2).orderBy("page_seq").collect()
    assert [r.last_ledger for r in rows] == [5, 5, 5, 9, 9]
    assert [r.lag_ledgers for r in rows] == [85, 86, 87, 84, 85]


# -- reads ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw,limit", [
    (None, 50), ("", 50), ("abc", 50), ("0", 50), ("-3", 50), ("7", 7), ("7.9", 7), ("0.5", 0), ("1e1", 10),
    ("1000", 100), ("Infinity", 50), ("1_0", 50), ("0x10", 16), (" 8 ", 8),
])
def test_limits(raw, limit):
    assert reads.parse_limit(raw) == limit


@pytest.mark.parametrize("raw,offset", [(None, 0), ("", 0), ("x", 0), ("-1", 0), ("3.7", 3), ("250", 250), ("NaN", 0)])
def test_offsets(raw, offset):
    assert reads.parse_offset(raw) == offset


def streams(spark, n=40):
    rows = [
        (i, f"s{i % 3}", f"r{i % 2}", "t", "1000", "10", 0, 10, 0, False, 1, 1, "e") for i in range(n)
    ]
    return spark.createDataFrame(rows, stream_schema(stream_id=event_schema().fields[0].dataType))


def test_lists_pages_and_counts(spark):
    table = streams(spark)
    ids = [r.stream_id for r in reads.list_streams(table, limit="3", offset="2", sender="s1", recipient="").collect()]
    assert ids == [31, 28, 25]
    assert reads.count_streams(table, sender="s1").first().total == 13
    (page,) = reads.stream_page(table, 5, limit=2, offset=1, sender="s1").collect()
    assert ([s.id for s in page.streams], page.total, page.limit, page.offset) == (["34", "31"], 13, 2, 1)
    assert page.streams[0].vested == "500"
    (empty,) = reads.stream_page(table, 5, sender="nobody").collect()
    assert (empty.streams, empty.total) == ([], 0)


def test_deep_pages(spark):
    table = streams(spark, 200).where("stream_id % 7 <> 3")
    every = [r.stream_id for r in table.orderBy(F.desc("stream_id")).collect()]
    stored = StoredStreams.write(table, buckets=4, ranges=9)
    for skip in (0, 5, 17, 100, len(every) - 2, len(every), 5000):
        got = [r.stream_id for r in reads.list_streams(table, 10, skip).collect()]
        assert got == every[skip : skip + 10]
        assert [r.stream_id for r in stored.listed(10, skip).collect()] == got


def test_by_id(spark):
    table = streams(spark)
    assert reads.stream_by_id(table, "7").first().stream_id == 7
    assert reads.stream_by_id(table, "400").count() == 0
    assert reads.stream_by_id(table, str(2**64)).count() == 0
    for bad in ("", "x", "0x2a", "-1", " 7", "1.0"):
        with pytest.raises(ValueError):
            reads.stream_by_id(table, bad)


# -- metrics --------------------------------------------------------------------------------------


def test_exposition_text(spark, tmp_path):
    log = spark.createDataFrame(
        [("GET", 'a"b\\c\nd', 4.0), ("GET", 'a"b\\c\nd', 5.0), ("GET", "x", 7000.5)], "method string, route string, ms double"
    )
    labels = ["method", "route"]
    exact = log.withColumn("ms", F.col("ms").cast("decimal(18,2)"))
    none = log.where("ms < 0").groupBy().count().where("count > 0").withColumnRenamed("count", "value")
    lines = metrics.exposition([
        metrics.Metric("hits", "Hits.", "counter", metrics.counter(log, labels), labels),
        metrics.Metric("all_total", "All.", "counter", metrics.counter(log, [])),
        metrics.Metric("lag", "Lag.", "gauge", none),
        metrics.Metric("ms", "Time.", "histogram", metrics.histogram(exact, labels, "ms", (10, 5)), labels, (10, 5)),
        metrics.Metric("idle", "Idle.", "histogram", metrics.histogram(exact.where("ms < 0"), labels, "ms", (5,)), labels, (5,)),
    ])
    metrics.write_exposition(lines, str(tmp_path / "text"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*")))
    odd = 'method="GET",route="a\\"b\\\\c\\nd"'
    assert text.splitlines() == [
        "# HELP hits Hits.", "# TYPE hits counter", f"hits_total{{{odd}}} 2", 'hits_total{method="GET",route="x"} 1',
        "# HELP all_total All.", "# TYPE all_total counter", "all_total 3",
        "# HELP lag Lag.", "# TYPE lag gauge", "lag 0",
        "# HELP ms Time.", "# TYPE ms histogram",
        f'ms_bucket{{{odd},le="5"}} 2', f'ms_bucket{{{odd},le="10"}} 2', f'ms_bucket{{{odd},le="+Inf"}} 2',
        f"ms_sum{{{odd}}} 9", f"ms_count{{{odd}}} 2",
        'ms_bucket{method="GET",route="x",le="5"} 0', 'ms_bucket{method="GET",route="x",le="10"} 0',
        'ms_bucket{method="GET",route="x",le="+Inf"} 1', 'ms_sum{method="GET",route="x"} 7000.5',
        'ms_count{method="GET",route="x"} 1',
        "# HELP idle Idle.", "# TYPE idle histogram", 'idle_bucket{le="5"} 0', 'idle_bucket{le="+Inf"} 0', "idle_sum 0", "idle_count 0",
    ]


def test_gauge_takes_the_last_value(spark):
    log = spark.createDataFrame([("a", 1, 9.0), ("a", 3, 2.0), ("b", 1, 5.0), ("a", 2, 7.0)], "who string, at int, v double")
    assert {r.who: r.value for r in metrics.gauge(log, ["who"], "v", ["at"]).collect()} == {"a": 2.0, "b": 5.0}


def test_counter_sums_amounts(spark):
    log = spark.createDataFrame([("a", 2), ("a", 3)], "who string, n long")
    assert metrics.counter(log, ["who"], F.col("n")).first().value == 5


def test_numbers_are_written_without_exponents(spark):
    from rivulet.functions.labels import number_text

    rows = [(1e7, "10000000"), (1e10, "10000000000"), (1e20, "100000000000000000000"), (0.1, "0.1"), (2.5e-5, "0.000025"), (1234567.25, "1234567.25"), (1e30, "1.0E30"), (0.0, "0"), (-1e10, "-10000000000"), (100.0, "100"), (None, None)]
    got = spark.createDataFrame(rows, "value double, wanted string").select(number_text(F.col("value")).alias("text"), "wanted").collect()
    assert [r.text for r in got] == [r.wanted for r in got]


def test_small_numbers_keep_their_digits(spark):
    from rivulet.functions.labels import number_text

    values = [1.2345678901234567e-4, -1.2345678901234567e-6, 9.876543210987654e-4, 2.5e-5, 1.5e20]
    got = spark.createDataFrame([(v,) for v in values], "value double").select("value", number_text(F.col("value")).alias("text")).collect()
    # digits that read back as the same number
    assert all("E" not in r.text and float(r.text) == r.value for r in got) and len(got) == 5


def test_summaries_of_parts_merge_to_that_of_the_whole(spark):
    rows = [(f"l{i % 3}", (i * 37 % 6000) / 4, i % 50, i) for i in range(400)]
    log = spark.createDataFrame(rows, "label string, ms double, ts long, id long").withColumn("ms", F.col("ms").cast("decimal(18,2)"))
    labels, order = ["label"], ["ts", "id"]
    kept = None
    for part in range(4):
        fresh = metrics.summary(log.where(F.col("id") % 4 == part), labels, "ms", order)
        kept = fresh if kept is None else metrics.merge(labels, kept, fresh)
    by = lambda frame: sorted(map(tuple, frame.collect()))
    assert by(metrics.histogram_of(kept, labels)) == by(metrics.histogram(log, labels, "ms"))
    assert by(metrics.counter_of(kept, labels)) == by(metrics.counter(log, labels))
    assert by(metrics.gauge_of(kept, labels)) == by(metrics.gauge(log, labels, "ms", order))
    nothing = metrics.summary(log.limit(0), labels, "ms", order)
    assert by(metrics.merge(labels, nothing, kept)) == by(kept)


def test_hot_keys_are_counted_only_where_a_group_of_keys_is_full(spark, monkeypatch):
    rows = spark.createDataFrame([(k,) for k, n in ((1, 5), (2, 4), (3, 3), (None, 9)) for _ in range(n)], "k long")
    spark.conf.set(skew.HOT_ROWS_SETTING, "3")
    try:
        for groups in (1, 2, skew.GROUPS):
            monkeypatch.setattr(skew, "GROUPS", groups)
            assert sorted(r.k for r in skew.hot_keys(rows, "k").collect()) == [1, 2]
    finally:
        spark.conf.unset(skew.HOT_ROWS_SETTING)


def test_counting_the_log_builds_no_events(spark, tmp_path):
    orders = [(k, 7, "F" if k % 8 else "O", 10.5, datetime.datetime(1995, 1, k), "1-URGENT") for k in range(1, 10)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1, 2, 57, 3.5, datetime.datetime(1995, 2, 1))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    log = tables.event_log(spark, str(tmp_path), (0,))
    kinds = sorted((r.kind, r.stream_id) for r in log.collect())
    assert kinds == [("cancelled", 4), *(("created", k) for k in range(1, 10) if k != 3), ("withdrawn", 1)]
    plan = log.groupBy("stream_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "lpad" not in plan and "concat" not in plan
