"""Valuation against a table of known cases and against Python integers."""

import random

from pyspark.sql import functions as F

from rivulet.functions import vesting

MAX = 2**127 - 1

# total, start, end, cliff, now, vested
CASES = [
    (1000, 100, 1100, 100, 50, 0),
    (1000, 100, 1100, 600, 300, 0),
    (1000, 100, 1100, 100, 600, 500),
    (1000, 100, 1100, 100, 350, 250),
    (1000, 100, 1100, 100, 1100, 1000),
    (1000, 100, 1100, 100, 9999, 1000),
    (1000, 100, 1100, 600, 600, 500),
    (10, 0, 3, 0, 1, 3),
    (12345678901234567890, 0, 10, 0, 3, 3703703670370370367),
    (MAX, 0, 2, 0, 1, MAX // 2),
    (MAX, 0, 2, 0, 2, MAX),
    (1000, 100, 1100, 100, 100, 0),
    (0, 100, 1100, 100, 600, 0),
    (1000, 100, 1100, 2000, 1500, 0),
    (1000, 100, 1100, 2000, 2000, 1000),
    (500, 100, 600, 100, 5000, 500),
    ("0" * 30, 100, 1100, 100, 600, 0),
    ("0" * 30 + "70", 0, 10, 0, 3, 21),
    (700, 100, 100, 100, 100, 700),
    (700, 100, 100, 100, 99, 0),
]

SCHEMA = "n int, total_amount string, withdrawn string, start_time long, end_time long, cliff_time long, cancelled boolean, now long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_known_cases(spark):
    rows = [(i, str(t), "0", s, e, c, False, now) for i, (t, s, e, c, now, _) in enumerate(CASES)]
    got = vesting.with_valuation(frame(spark, rows), F.col("now")).orderBy("n").collect()
    assert [r.vested for r in got] == [str(case[-1]) for case in CASES]


def test_withdrawable_cases(spark):
    cases = [
        (500, 200, 300),
        (200, 500, 0),
        (300, 300, 0),
        (12345678901234567890, 345678901234567890, 12000000000000000000),
    ]
    rows = [(i, str(v), str(w), 0, 1, 0, False, 5) for i, (v, w, _) in enumerate(cases)]
    got = vesting.with_valuation(frame(spark, rows), F.col("now")).orderBy("n").collect()
    assert [r.withdrawable for r in got] == [str(c[-1]) for c in cases]


def model(total, drawn, start, end, cliff, now):
    if now < cliff or now < start:
        vested = 0
    elif now >= end:
        vested = total
    else:
        vested = total * (now - start) // (end - start)
    progress = 10000 if total == 0 else vested * 10000 // total
    return str(vested), str(max(0, vested - drawn)), str(total - vested), progress


def test_random_widths_match_python_integers(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        total = rng.choice([0, MAX, rng.randrange(10 ** rng.randint(1, 38)), 10 ** rng.randint(0, 38), MAX - rng.randrange(9)])
        drawn = rng.randrange(total + 1) if rng.random() < 0.8 else min(MAX, total + rng.randrange(1000))
        start = rng.randrange(2 ** rng.randint(1, 61))
        end = start + 1 + rng.randrange(2 ** rng.randint(1, 61))
        now = rng.choice([start, end, end - 1, rng.randrange(start, end), start - 1])
        cliff = rng.choice([start, start, now, now + 1])
        rows.append((i, str(total), str(drawn), start, end, cliff, False, now))
    got = vesting.with_valuation(frame(spark, rows), F.col("now")).orderBy("n").collect()
    for row, r in zip(rows, got):
        expected = model(int(row[1]), int(row[2]), row[3], row[4], row[5], row[7])
        assert (r.vested, r.withdrawable, r.locked, r.progress) == expected, row


def test_status_ignores_the_cliff(spark):
    rows = [
        (0, "1", "0", 100, 200, 500, False, 99),
        (1, "1", "0", 100, 200, 500, False, 100),
        (2, "1", "0", 100, 200, 500, False, 200),
        (3, "1", "0", 100, 200, 500, True, 99),
    ]
    got = vesting.with_valuation(frame(spark, rows), F.col("now")).orderBy("n").collect()
    assert [r.status for r in got] == ["pending", "streaming", "completed", "cancelled"]
    assert got[2].vested == "0"


def test_number_columns_are_accepted(spark):
    df = frame(spark, [(0, "1000", "10", 0, 10, 0, False, 5)])
    typed = df.withColumn("total_amount", F.col("total_amount").cast("decimal(38,0)")).withColumn(
        "withdrawn", F.col("withdrawn").cast("bigint")
    )
    row = vesting.view(typed.withColumn("stream_id", F.lit(7)).withColumns({c: F.lit("x") for c in ("sender", "recipient", "token")}), F.col("now")).first()
    assert (row.id, row.vested, row.withdrawable, row.locked, row.progress) == ("7", "500", "490", "500", 5000)


def test_unsigned_64_bit_times_match_python_integers(spark):
    from decimal import Decimal

    rng = random.Random(12)
    top = 2**64 - 1
    rows = []
    for i in range(600):
        total = rng.choice([MAX, rng.randrange(10 ** rng.randint(1, 38)), 10 ** rng.randint(0, 38)])
        start = rng.choice([0, rng.randrange(2**63), rng.randrange(2**64)])
        end = rng.choice([top, rng.randrange(2**64), start])
        now = rng.choice([2**63 - 1, rng.randrange(2**63), min(start, 2**63 - 1)])
        cliff = rng.choice([start, 0, top])
        rows.append((i, str(total), "0", start, end, cliff, False, now))
    typed = [(*r[:3], *map(Decimal, r[3:6]), *r[6:]) for r in rows]
    df = spark.createDataFrame(typed, SCHEMA.replace("_time long", "_time decimal(20,0)"))
    got = vesting.with_valuation(df, F.col("now")).orderBy("n").collect()
    for row, r in zip(rows, got, strict=True):
        assert (r.vested, r.withdrawable, r.locked, r.progress) == model(int(row[1]), 0, row[3], row[4], row[5], row[7]), row


def test_the_default_clock_is_the_current_second(spark):
    import time

    df = frame(spark, [(0, "1000", "0", 0, 2**40, 0, False, 0)])
    before = int(time.time())
    got = int(vesting.with_vested(df).first().vested)
    assert 1000 * before // 2**40 <= got <= 1000 * (int(time.time()) + 1) // 2**40
    assert df.select((vesting.clock(None) - F.lit(before)).alias("d")).first().d in range(120)
