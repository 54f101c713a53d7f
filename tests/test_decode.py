"""Decoding against a golden page of six raw events.

The page is fixed data, kept byte for byte, because the wire form itself is what is tested.
"""

import base64
import json
import pathlib

from pyspark.sql import functions as F

from rivulet.operators.decode import decode_events
from rivulet.operators.fold import fold
from rivulet.sources import pages

PAGE = str(pathlib.Path(__file__).parent / "fixtures" / "event_page.json")
SENDER = "GA5ZSEJYB37JRC5AVCIA5MOP4RHTM335X2KGX3IHOJAPP5RE34K4KZVN"
RECIPIENT = "GBRPYHIL2CI3FNQ4BXLFMNDLFJUNPU2HY3ZMFSHONUCEOASW7QC7OX2H"
TREASURY = "CAXZU7AE4GZVRVSHBLURFROY6MDBUS7JPUQDQ3HVDFFH3YFTYYUBLERT"
TOKEN = "CBFS2HT4TIHTMWA5ZND6FEC27BRRA4V6JWOD7JIIDZVSPVAM7EJ2LZS7"


def decoded(spark):
    raw = pages.page_events(pages.read_pages(spark, PAGE, multi_line=True))
    return decode_events(raw).orderBy("pos").collect()


def test_golden_rows(spark):
    rows = decoded(spark)
    assert [r.kind for r in rows] == ["created", "withdrawn", "cancelled", "created"]
    assert [r.ledger for r in rows] == [56123890, 56201455, 56290012, 56290013]
    assert [r.closed_at for r in rows] == [1762161262, 1762623665, 1763089117, 1763089122]
    assert all(r.error is None for r in rows)
    first, second, third, fourth = rows
    assert (first.event_id, int(first.stream_id)) == ("0241050272077447168-0000000001", 42)
    assert (first.sender, first.recipient, first.token) == (SENDER, RECIPIENT, TOKEN)
    assert first.total_amount == "100000000000000"
    assert (first.start_time, first.end_time, first.cliff_time) == (1735689600, 1767225600, 1740000000)
    assert first.tx_hash.startswith("9f2a1c7b")
    assert (second.recipient, second.amount, int(second.stream_id)) == (RECIPIENT, "25000000000000", 42)
    assert (third.sender, third.recipient_amount, third.sender_refund) == (SENDER, "30000000000000", "70000000000000")
    assert (int(fourth.stream_id), fourth.sender) == (18446744073709551615, TREASURY)
    assert fourth.total_amount == str(2**127 - 1)
    assert (fourth.start_time, fourth.end_time, fourth.cliff_time) == (0, 1, 0)


def test_folding_the_page_freezes_the_stream(spark):
    raw = pages.page_events(pages.read_pages(spark, PAGE, multi_line=True))
    state = {int(r.stream_id): r for r in fold(decode_events(raw)).state.collect()}
    row = state[42]
    assert (row.withdrawn, row.total_amount, row.end_time, row.cancelled) == (
        "55000000000000",
        "55000000000000",
        1763089117,
        True,
    )
    assert state[2**64 - 1].total_amount == str(2**127 - 1)


def test_contract_filter_and_positions(spark):
    df = pages.read_pages(spark, PAGE, multi_line=True)
    assert pages.page_events(df, "CDMB62RVYAXJJNYYH7K442SHSAJIXTZ6K7JANGSMQF2T7MHCTVSK75SW").count() == 6
    assert pages.page_events(df, "other").count() == 0
    row = pages.page_positions(df).first()
    assert (row.latest_ledger, row.cursor, row.events) == (56290021, "0241763773516349440-0000000001", 6)


def edited(spark, change):
    page = json.load(open(PAGE))
    change(page["result"]["events"])
    return pages.parse_pages(spark.createDataFrame([(json.dumps(page),)], "value string"))


def test_no_topics_is_skipped(spark):
    def change(events):
        events[0]["topic"] = []

    rows = decode_events(pages.page_events(edited(spark, change)))
    assert rows.count() == 3


def test_broken_known_event_becomes_a_dead_letter(spark):
    def change(events):
        events[0]["value"] = events[4]["value"]  # a scalar where a map is due
        events[1]["value"] = "not base64!"
        events[2]["topic"] = events[2]["topic"][:1]
        raw = base64.b64decode(events[3]["value"])
        events[3]["value"] = base64.b64encode(raw[:-8]).decode()

    rows = decode_events(pages.page_events(edited(spark, change))).orderBy("pos").collect()
    assert [r.kind for r in rows] == ["unknown"] * 4
    assert [r.error.split()[1] for r in rows] == ["stream_id", "stream_id", "sender", "total_amount"]


def test_extra_fields_and_negative_amounts(spark):
    def change(events):
        raw = bytearray(base64.b64decode(events[1]["value"]))
        raw[8:12] = (3).to_bytes(4, "big")
        extra = b"\0\0\0\x0f\0\0\0\x01a\0\0\0" + b"\0\0\0\x0e\0\0\0\x05hello\0\0\0"
        raw[12:12] = extra
        at = raw.index(b"amount") + 8 + 4
        raw[at : at + 16] = (-5 * 10**30 - 1).to_bytes(16, "big", signed=True)
        events[1]["value"] = base64.b64encode(bytes(raw)).decode()

    row = decode_events(pages.page_events(edited(spark, change))).where(F.col("pos") == 1).first()
    assert (row.amount, int(row.stream_id), row.error) == (str(-5 * 10**30 - 1), 42, None)


def _u32(number):
    return number.to_bytes(4, "big")


def _name(text):
    return _u32(15) + _u32(len(text)) + text.encode() + b"\0" * (-len(text) % 4)


NUMBER = _u32(3) + _u32(7)
VECTOR = _u32(16) + _u32(1) + _u32(2) + NUMBER + _name("amount")
EXTRAS = {
    "number": _name("a") + NUMBER,
    "map": _name("a") + _u32(17) + _u32(1) + _u32(1) + _name("amount") + NUMBER,
    "vector": _name("a") + VECTOR,
    "nested twice": _name("a") + _u32(17) + _u32(1) + _u32(1) + _name("b") + VECTOR,
    "empty map": _name("a") + _u32(17) + _u32(1) + _u32(0),
    "absent vector": _name("a") + _u32(16) + _u32(0),
    "long key": _name("k" * 300) + NUMBER,
    "number as key": NUMBER + NUMBER,
    "vector as key": VECTOR + NUMBER,
    "address with a number": _name("a") + _u32(18) + _u32(2) + b"\1" * 40,
    "pool": _name("a") + _u32(18) + _u32(4) + b"\1" * 32,
    "error": _name("a") + _u32(2) + _u32(1) + _u32(4),
}


def test_values_with_any_other_entry_are_decoded(spark):
    def change(events):
        plain = events[1]
        raw = base64.b64decode(plain["value"])
        events[:] = [
            {**plain, "value": base64.b64encode(raw[:8] + _u32(3) + extra + raw[12:]).decode()} for extra in EXTRAS.values()
        ]

    rows = decode_events(pages.page_events(edited(spark, change))).orderBy("pos").collect()
    got = {name: (r.kind, r.amount, int(r.stream_id or 0), r.error) for name, r in zip(EXTRAS, rows, strict=True)}
    assert got == {name: ("withdrawn", "25000000000000", 42, None) for name in EXTRAS}


def test_times_keep_all_64_bits(spark):
    top = 2**64 - 1

    def change(events):
        raw = base64.b64decode(events[0]["value"])
        for name, value in (("end_time", top), ("cliff_time", 2**63)):
            at = raw.index(name.encode()) + len(name) + -len(name) % 4 + 4
            raw = raw[:at] + value.to_bytes(8, "big") + raw[at + 8 :]
        events[0]["value"] = base64.b64encode(raw).decode()

    events = decode_events(pages.page_events(edited(spark, change)))
    row = events.where("pos = 0").first()
    assert (row.error, row.start_time, row.end_time, row.cliff_time) == (None, 1735689600, top, 2**63)
    (state,) = fold(events.where("pos = 0")).state.collect()
    assert (state.end_time, state.cliff_time) == (top, 2**63)
    from rivulet.functions.vesting import view

    shown = view(fold(events.where("pos = 0")).state, 1735689600 + 1).first()
    assert (shown.end_time, shown.cliff_time, shown.vested, shown.status) == (str(top), str(2**63), "0", "streaming")


def test_pages_are_packed_where_they_stand(spark, tmp_path):
    """Encoded events are sorted once and never shuffled; pages are runs of a partition's rows, landed files small and compressed."""
    rows = [(i // 40, f"{i:06d}", f"{i:06d}", "withdrawn", i, 7 + i, 60 * i, "tx", "S", "R", None, 5) for i in range(1234)]
    names = "page_seq long, pos string, event_id string, kind string, stream_id long, ledger long, closed_at long, tx_hash string, sender string, recipient string, token string, amount long"
    wide = "total_amount", "start_time", "end_time", "cliff_time", "recipient_amount", "sender_refund"
    log = spark.createDataFrame(rows, names).withColumns({n: F.lit(None).cast("bigint") for n in wide})
    encoded = pages.encode_pages(log.repartition(5), "c", rows_per_page=7)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    pages.write_pages(pages.number_pages(encoded), str(tmp_path / "landed"))
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "landed").glob("part-*"))
    got = pages.read_pages(spark, str(tmp_path / "landed")).orderBy("page_seq").collect()
    assert [p.page_seq for p in got] == list(range(len(got)))
    assert [e.id for p in got for e in p.result.events] == [r[2] for r in rows]
    sizes = [len(p.result.events) for p in got]
    parts = encoded.select(F.shiftright("page_seq", 33)).distinct().count()
    assert max(sizes) == 7 and sum(n < 7 for n in sizes) <= parts
    assert all(p.result.cursor == p.result.events[-1].id and p.result.latestLedger == p.result.events[-1].ledger + 10 for p in got)


def test_numbering_pages_shuffles_none_of_them(spark, tmp_path):
    rows = [(part << 33 | slot, "x" * 50) for part in range(3) for slot in range(part + 1)]
    spark.createDataFrame(rows, "page_seq long, result string").write.parquet(str(tmp_path / "stored"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with pages of any size
    try:
        numbered = pages.number_pages(spark.read.parquet(str(tmp_path / "stored")))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert [r.page_seq for r in numbered.orderBy("page_seq").collect()] == list(range(len(rows)))


def test_events_without_a_place_are_placed_by_their_id(spark):
    names = "page_seq long, event_id string, kind string, stream_id long, ledger long, closed_at long, tx_hash string, sender string, recipient string, token string, amount long, error string"
    rows = [(i // 4, f"{i:04d}", "withdrawn", i, 10 + i, 1000 + i, "h", None, "r", None, i, "bad" if i == 3 else None) for i in range(12)]
    wide = "total_amount", "start_time", "end_time", "cliff_time", "recipient_amount", "sender_refund"
    log = spark.createDataFrame(rows[::-1], names).withColumns({n: F.lit(None).cast("bigint") for n in wide})
    encoded = pages.encode_pages(log, "c", rows_per_page=5).orderBy("page_seq").collect()
    assert [e.id for p in encoded for e in p.result.events] == [r[1] for r in rows]
    placed = pages.encode_pages(log.withColumn("pos", F.col("event_id")), "c", rows_per_page=5).orderBy("page_seq").collect()
    assert [e for p in placed for e in p.result.events] == [e for p in encoded for e in p.result.events]
