"""The live path: drained in several runs it ends where one batch fold ends."""

import datetime
import json
import pathlib
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.decode import decode_events
from rivulet.operators.fold import fold
from rivulet.plans import queries
from rivulet.session import shuffles_dropped
from rivulet.sources import pages, tables
from rivulet.sources.mirror import MirrorStore
from rivulet.streaming import live

PAGE = pathlib.Path(__file__).parent / "fixtures" / "event_page.json"


def landing(tmp_path, number, positions, twice=False):
    page = json.loads(PAGE.read_text())
    events = page["result"]["events"]
    page["page_seq"] = number
    page["result"]["events"] = [events[i] for i in positions]
    page["result"]["cursor"] = events[positions[-1]]["id"] if positions else "none"
    folder = tmp_path / "pages"
    folder.mkdir(exist_ok=True)
    (folder / f"{number:06d}{'-again' if twice else ''}.json").write_text(json.dumps(page))


def run(spark, tmp_path, store, **options):
    return live.drain(
        spark, str(tmp_path / "pages"), str(tmp_path / "log"), str(tmp_path / "checkpoint"), store, files_per_batch=1, **options
    )


def test_several_drains_equal_one_fold(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=4)
    assert store.position().count() == 0
    landing(tmp_path, 0, [0, 4])
    first = run(spark, tmp_path, store)
    assert (first.number, first.high_page, first.last_ledger) == (1, 0, 56123890)
    assert run(spark, tmp_path, store) == first  # nothing new, nothing written

    landing(tmp_path, 2, [2, 5])  # page 1 has not arrived
    assert run(spark, tmp_path, store) == first

    landing(tmp_path, 1, [1, 3])
    landing(tmp_path, 3, [])
    landing(tmp_path, 1, [1, 3], twice=True)
    last = run(spark, tmp_path, store)
    assert (last.number, last.high_page, last.last_ledger, last.chain_ledger) == (2, 3, 56290013, 56290021)

    whole = decode_events(pages.page_events(pages.read_pages(spark, str(PAGE), multi_line=True)))
    expected = sorted(map(tuple, fold(whole).state.collect()))
    assert sorted(map(tuple, store.streams().collect())) == expected
    assert store.stream("42").first().withdrawn == "55000000000000"
    assert store.stream(str(2**64 - 1)).count() == 1
    assert store.stream("43").count() == 0 and store.stream(str(2**64)).count() == 0
    counts = {(r.kind, r.outcome): r.n for r in store.outcomes().groupBy("kind", "outcome").agg(F.count("*").alias("n")).collect()}
    assert counts == {
        ("created", "applied"): 2, ("created", "duplicate"): 1,
        ("withdrawn", "applied"): 1, ("withdrawn", "duplicate"): 1, ("cancelled", "applied"): 1,
    }
    assert {(r.kind, r.outcome): r.value for r in store.counters().collect()} == counts


def test_a_version_without_its_manifest_does_not_exist(spark, tmp_path, monkeypatch):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=4)
    landing(tmp_path, 0, [0, 1])
    write = MirrorStore._write

    def dies(self, frame, kind, number):
        if kind == "manifest":
            raise RuntimeError("lost")
        write(self, frame, kind, number)

    monkeypatch.setattr(MirrorStore, "_write", dies)
    with pytest.raises(RuntimeError):
        run(spark, tmp_path, store)
    assert store.current().number == 0
    monkeypatch.undo()
    run(spark, tmp_path, store)
    assert [r.withdrawn for r in store.streams().collect()] == ["25000000000000"]


def test_broken_events_reach_the_dead_letters_and_leave_when_they_succeed(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0, 1])
    path = tmp_path / "pages" / "000000.json"
    page = json.loads(path.read_text())
    good = page["result"]["events"][1]["value"]
    page["result"]["events"][1]["value"] = "AAAABQAAAABpFprn"
    path.write_text(json.dumps(page))
    run(spark, tmp_path, store)
    (letter,) = store.failures().collect()
    assert (letter.kind, letter.failure_count) == ("unknown", 1)

    for number in (1, 2):
        page["page_seq"] = number
        if number == 2:
            page["result"]["events"][1]["value"] = good
        (tmp_path / "pages" / f"00000{number}.json").write_text(json.dumps(page))
        run(spark, tmp_path, store)
        counts = [r.failure_count for r in store.failures().collect()]
        assert counts == ([2] if number == 1 else [])
    assert [r.withdrawn for r in store.streams().collect()] == ["25000000000000"]


def test_gaps_are_found_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(live, "PAGES_PER_BLOCK", 4)
    for numbers, high, upto in [
        (range(10), -1, 9),
        ([0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11], -1, 2),
        ([*range(8), *range(12, 16)], -1, 7),
        ([*range(8), 9, 10], -1, 7),
        ([5, 6, 7], 4, 7),
        ([6, 7], 4, 4),
        ([], 3, 3),
    ]:
        frame = spark.createDataFrame([(n,) for n in numbers], "page_seq long")
        assert live.last_without_gap(frame, high) == upto


def test_a_store_keeps_its_bucket_count(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=16)
    landing(tmp_path, 0, [0, 1])
    run(spark, tmp_path, store)
    again = MirrorStore(spark, str(tmp_path / "mirror"))
    assert again.buckets == 16 and again.stream("42").count() == 1
    with pytest.raises(ValueError):
        MirrorStore(spark, str(tmp_path / "mirror"), buckets=64)


def rows(store):
    return [(r.withdrawn, r.cancelled) for r in store.streams().orderBy("stream_id").collect()]


def test_a_late_page_below_the_high_page_is_folded(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0])
    landing(tmp_path, 5, [])
    first = run(spark, tmp_path, store, hold_back_gaps=False)
    assert (first.high_page, rows(store)) == (5, [("0", False)])
    landing(tmp_path, 3, [1])
    last = run(spark, tmp_path, store, hold_back_gaps=False)
    assert (last.number, last.high_page, last.cursor, rows(store)) == (2, 5, "none", [("25000000000000", False)])
    assert run(spark, tmp_path, store, hold_back_gaps=False) == last


def test_a_page_that_lands_again_retries_what_failed(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0])
    landing(tmp_path, 1, [1])
    path = tmp_path / "pages" / "000001.json"
    page = json.loads(path.read_text())
    good = page["result"]["events"][0]["value"]
    page["result"]["events"][0]["value"] = "AAAABQAAAABpFprn"
    path.write_text(json.dumps(page))
    run(spark, tmp_path, store)
    assert rows(store) == [("0", False)] and [r.failure_count for r in store.failures().collect()] == [1]
    page["result"]["events"][0]["value"] = good
    (tmp_path / "pages" / "000001-again.json").write_text(json.dumps(page))
    again = run(spark, tmp_path, store)
    assert (again.number, again.high_page) == (2, 1)
    assert rows(store) == [("25000000000000", False)] and store.failures().count() == 0
    (tmp_path / "pages" / "000001-once-more.json").write_text(json.dumps(page))
    run(spark, tmp_path, store)  # now a duplicate
    assert rows(store) == [("25000000000000", False)]
    assert [(r.page_seq, r.last_ledger) for r in store.positions().where("version = 1").orderBy("page_seq").collect()] == [(0, 56123890), (1, 56123890)]


def test_pages_that_waited_behind_a_gap_are_folded_later(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0])
    landing(tmp_path, 2, [1])
    first = run(spark, tmp_path, store)
    assert first.high_page == 0 and first.waiting_since
    landing(tmp_path, 1, [])
    last = run(spark, tmp_path, store)
    assert (last.high_page, last.waiting_since, rows(store)) == (2, None, [("25000000000000", False)])


def test_a_broken_line_is_kept_and_counted(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0, 1])
    (tmp_path / "pages" / "bad.json").write_text('{"page_seq": 7, "result": {"events": [\nno page at all\n{"result": {"cursor": "x"}}\n')
    run(spark, tmp_path, store)
    letters = store.failures().orderBy("error").collect()
    assert len(letters) == 3 and {r.kind for r in letters} == {"unknown"} and all(r.failure_count == 1 for r in letters)
    assert any("no page at all" in r.error for r in letters)
    assert rows(store) == [("25000000000000", False)]
    assert pages.broken_pages(spark, str(tmp_path / "pages")).count() == 2
    assert pages.read_pages(spark, str(tmp_path / "pages")).where("page_seq is not null").count() == 1


@pytest.mark.parametrize("start,floor,outcome", [(56201455, 56201455, "missing"), (56123890, 56201455, "applied"), (0, 56290021, None)])
def test_where_a_new_store_starts(spark, tmp_path, start, floor, outcome):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0, 1])
    version = run(spark, tmp_path, store, start_ledger=start)
    assert version.last_ledger == floor
    done = {r.kind: r.outcome for r in store.outcomes().collect()}
    assert done.get("withdrawn") == outcome and ("created" in done) == (outcome == "applied")


def small_tables(spark, folder):
    """Orders and line items of three streams with gaps in their ids, one of them replayed."""
    day = datetime.datetime(1995, 3, 1)
    orders = [(k, 7, "F", 100.0 + k, day, "5-LOW") for k in (10, 12, 20, 23)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    items = [(k, n, 3 * k + n, 7 if n == 2 else 8, 9.0 + n, day + datetime.timedelta(days=20 * n)) for k in (10, 12, 20, 23) for n in (1, 2, 3)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")


def test_encoded_pages_go_once_all_of_them_have_landed(spark, tmp_path):
    small_tables(spark, tmp_path)
    encoded, folder = tmp_path / "live" / "encoded", str(tmp_path / "live")
    there = [encoded.exists() for _ in queries._land_in_turns(spark, str(tmp_path), folder)]
    assert there == [True] * (queries.LANDINGS - 1) + [False]
    landed = pages.read_pages(spark, f"{folder}/pages")
    log = tables.event_log(spark, str(tmp_path))
    assert landed.select(F.explode("result.events.id")).count() == log.count() > 20


def test_landed_files_go_once_the_log_has_them(spark, tmp_path):
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0])
    run(spark, tmp_path, store, remove_landed=True)
    landing(tmp_path, 1, [1])
    run(spark, tmp_path, store, remove_landed=True)  # files are removed beside the next micro-batch
    deadline = time.monotonic() + 20
    while (tmp_path / "pages" / "000000.json").exists() and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not (tmp_path / "pages" / "000000.json").exists() and (tmp_path / "pages" / "000001.json").exists()
    assert rows(store) == [("25000000000000", False)]
    assert live.read_log(spark, str(tmp_path / "log")).count() == 2


def test_what_is_stored_is_compressed_well_and_not_kept_in_a_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("a cache that the state cannot use"))
    store = MirrorStore(spark, str(tmp_path / "mirror"), buckets=2)
    landing(tmp_path, 0, [0, 1])
    run(spark, tmp_path, store)
    files = [*(tmp_path / "log").rglob("part-*.parquet"), *(tmp_path / "mirror").rglob("part-*.parquet")]
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_shuffle_files_go_with_their_query(spark):
    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting, None), shuffle_files()
    with pytest.raises(RuntimeError), shuffles_dropped(spark):
        assert spark.range(1000).repartition(7).selectExpr("id % 5 AS k").groupBy("k").count().count() == 5
        deadline = time.monotonic() + 20
        while shuffle_files() - before and time.monotonic() < deadline:
            time.sleep(0.2)
        assert not shuffle_files() - before
        raise RuntimeError
    assert spark.conf.get(setting, None) == was
