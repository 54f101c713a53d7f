"""As-of valuation of payment streams: linear vesting in exact integers.

Amounts may be ``BIGINT``, ``DECIMAL`` or decimal text; results are decimal text, because a 128-bit
integer has no Spark number type. A row whose amounts have at most 18 digits is computed with plain
decimals. Only the others take the long-division path, where a total is three limbs, the lower two
of 13 digits each, the upper of 13 for any 128-bit value and never over 18.
The steps are stacked projections, so each intermediate is computed once and all of it stays in
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.amounts import BASE, BASE_DIGITS, TextLane
from rivulet.functions.stage import settle

SMALL_DIGITS = 18
FULL_PROGRESS = 10_000  # basis points

VIEW_COLUMNS = [
    "id",
    "sender",
    "recipient",
    "token",
    "total_amount",
    "withdrawn",
    "vested",
    "withdrawable",
    "locked",
    "progress",
    "start_time",
    "end_time",
    "cliff_time",
    "cancelled",
    "status",
]


def clock(as_of: int | Column | None) -> Column:
    """One instant for the whole query: the one given, or the session's current second."""
    if as_of is None:
        return F.unix_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("bigint")


def status_of(now: Column) -> Column:
    return (
        F.when(F.col("cancelled"), "cancelled")
        .when(now < F.col("start_time"), "pending")
        .when(now >= F.col("end_time"), "completed")
        .otherwise("streaming")
    )


def amount_text(frame: DataFrame, column: str) -> Column:
    """An amount of any type as text without leading zeros."""
    if isinstance(frame.schema[column].dataType, T.StringType):
        return strip_zeros(F.col(column))
    return F.col(column).cast("string")


def with_vested(streams: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """Add ``vested`` as decimal text."""
    now = clock(as_of)
    total = amount_text(streams, "total_amount")
    nothing = (now < F.col("cliff_time")) | (now < F.col("start_time"))
    staged = streams.withColumns(
        {
            "_total": total,
            "_partly": ~nothing & (now < F.col("end_time")),
        }
    ).withColumns(
        {
            # Of rows that are partly vested alone: there the duration is above the elapsed time, which is below 2^63.
            "_elapsed": F.when(F.col("_partly"), now - F.col("start_time")).cast("decimal(19,0)"),
            "_duration": F.when(F.col("_partly"), F.col("end_time") - F.col("start_time")).cast("decimal(20,0)"),
            "_short": F.expr(
                f"CASE WHEN _partly AND length(_total) <= {SMALL_DIGITS} THEN cast(_total AS decimal(18,0)) END"
            ),
            "_limbs": F.expr(f"CASE WHEN _partly AND length(_total) > {SMALL_DIGITS} THEN lpad(_total, greatest(length(_total), {3 * BASE_DIGITS}), '0') END"),
        }
    )
    staged = _long_product(staged)
    vested = (
        F.when(nothing, "0")
        .when(~F.col("_partly"), F.col("_total"))
        .when(
            F.col("_short").isNotNull(),
            F.expr("cast((_short * _elapsed) div _duration AS string)"),
        )
        .otherwise(F.col("_product"))
    )
    return settle(staged.withColumn("vested", vested).select(*streams.columns, "vested"), ["vested"])


def _long_product(staged: DataFrame) -> DataFrame:
    """``_product`` = text of floor(total * elapsed / duration) for rows that have ``_limbs``.

    With total = quotient * duration + rest, the product is quotient * elapsed plus the small
    floor(rest * elapsed / duration), in which elapsed is taken in two parts, since rest may have 20 digits
    and elapsed 19. Every ``div`` below has a result under 2^63, as it must.
    """
    limb, part = f"cast({BASE} AS decimal(14,0))", "cast(1000000000 AS decimal(10,0))"

    def next_limb(rest: str, value: str) -> str:
        return f"({rest} * {limb} + cast({value} AS decimal(13,0)))"

    def rest(value: str) -> str:
        return f"cast({value} % _duration AS decimal(20,0))"

    steps = [
        {
            "_l0": f"cast(left(_limbs, length(_limbs) - {2 * BASE_DIGITS}) AS decimal(18,0))",
            "_l1": f"cast(substring(_limbs, -{2 * BASE_DIGITS}, {BASE_DIGITS}) AS bigint)",
            "_l2": f"cast(right(_limbs, {BASE_DIGITS}) AS bigint)",
            "_e1": f"cast(_elapsed div {part} AS decimal(10,0))",
            "_e0": f"cast(_elapsed % {part} AS decimal(9,0))",
        },
        {"_q0": "_l0 div _duration", "_r0": rest("_l0")},
        {"_n1": next_limb("_r0", "_l1")},
        {"_q1": "_n1 div _duration", "_r1": rest("_n1")},
        {"_n2": next_limb("_r1", "_l2")},
        {"_q2": "_n2 div _duration", "_r2": rest("_n2")},
        {"_m1": "_r2 * _e1"},
        {"_g1": "_m1 div _duration", "_h1": rest("_m1")},
        {"_g0": f"(_h1 * {part} + _r2 * _e0) div _duration"},
        {"_p2": f"cast(_q2 AS decimal(13,0)) * _elapsed + cast(_g1 AS decimal(10,0)) * {part} + cast(_g0 AS decimal(10,0))"},
        {"_p1": f"cast(_q1 AS decimal(13,0)) * _elapsed + (_p2 div {limb})"},
        {"_p0": f"cast(_q0 AS decimal(18,0)) * _elapsed + (_p1 div {limb})"},
    ]
    for step in steps:
        staged = staged.withColumns({name: F.expr(text) for name, text in step.items()})
    tail = ", ".join(f"lpad(cast(cast({p} % {limb} AS bigint) AS string), {BASE_DIGITS}, '0')" for p in ("_p1", "_p2"))
    text = F.expr(f"concat(cast(cast(_p0 AS bigint) AS string), {tail})")
    return staged.withColumn("_product", strip_zeros(text))


def strip_zeros(digits: Column) -> Column:
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def _parts(frame: DataFrame, columns: dict[str, str], when: Column) -> DataFrame:
    """Add ``_<name>_hi`` and ``_<name>_lo`` of text columns, null where not asked for."""
    lane = TextLane()
    pieces = {}
    for name, column in columns.items():
        for part, value in zip(lane.names, lane.split(F.when(when, F.col(column)))):
            pieces[f"_{name}_{part}"] = value
    return frame.withColumns(pieces)


def _minus(frame: DataFrame, out: str, left: str, right: str) -> DataFrame:
    """Add text column ``out`` = left - right of two columns of parts, 0 when negative."""
    base = f"cast({BASE} AS decimal(14,0))"
    for name, text in [
        ("_low", f"_{left}_lo - _{right}_lo"),
        ("_rest", f"pmod(_low, {base})"),
        ("_high", f"_{left}_hi - _{right}_hi + cast((_low - _rest) / {base} AS decimal(38,0))"),
    ]:
        frame = frame.withColumn(name, F.expr(text))
    text = F.expr(f"concat(cast(_high AS string), lpad(cast(_rest AS string), {BASE_DIGITS}, '0'))")
    return frame.withColumn(out, F.when(F.col("_high") < 0, "0").otherwise(strip_zeros(text)))


def with_withdrawable(valued: DataFrame) -> DataFrame:
    """Add ``withdrawable`` = max(0, vested - withdrawn) and ``locked`` = total - vested."""
    staged = valued.withColumns(
        {"_total": amount_text(valued, "total_amount"), "_drawn": amount_text(valued, "withdrawn")}
    ).withColumn("_short", (F.length("_total") <= SMALL_DIGITS) & (F.length("_drawn") <= SMALL_DIGITS))
    staged = _parts(staged, {"v": "vested", "w": "_drawn", "t": "_total"}, ~F.col("_short"))
    staged = _minus(_minus(staged, "_free", "v", "w"), "_fixed", "t", "v")
    short = {
        "withdrawable": "cast(greatest(0L, cast(vested AS bigint) - cast(_drawn AS bigint)) AS string)",
        "locked": "cast(cast(_total AS bigint) - cast(vested AS bigint) AS string)",
    }
    wide = {"withdrawable": "_free", "locked": "_fixed"}
    staged = staged.withColumns({n: F.when(F.col("_short"), F.expr(short[n])).otherwise(F.col(wide[n])) for n in short})
    return settle(staged.select(*valued.columns, *short), list(short))


def with_progress(valued: DataFrame) -> DataFrame:
    """Add ``progress`` = floor(vested * 10000 / total) in basis points, 10000 for an empty total.

    For amounts past 18 digits a floating-point estimate is corrected by the sign of the exact
    remainder, taken from the parts of ``vested * 10000 - estimate * total``.
    """
    base = f"cast({BASE} AS decimal(14,0))"
    staged = valued.withColumn("_total", amount_text(valued, "total_amount"))
    staged = staged.withColumn("_long", F.length("_total") > SMALL_DIGITS)
    long = F.col("_long")
    ratio = F.col("vested").cast("double") * FULL_PROGRESS / F.col("_total").cast("double")
    staged = _parts(staged, {"v": "vested", "t": "_total"}, long).withColumn(
        "_guess", F.when(long, F.floor(ratio)).cast("decimal(5,0)")
    )
    for name, text in [
        ("_low", f"cast(_v_lo AS decimal(13,0)) * {FULL_PROGRESS} - _guess * cast(_t_lo AS decimal(13,0))"),
        ("_rest", f"pmod(_low, {base})"),
        (
            "_high",
            f"cast(_v_hi AS decimal(32,0)) * {FULL_PROGRESS} - _guess * cast(_t_hi AS decimal(32,0))"
            f" + cast((_low - _rest) / {base} AS decimal(13,0))",
        ),
        ("_over", "_high > _t_hi OR (_high = _t_hi AND _rest >= _t_lo)"),
    ]:
        staged = staged.withColumn(name, F.expr(text))
    progress = (
        F.when(F.col("_total") == "0", F.lit(FULL_PROGRESS).cast("bigint"))
        .when(
            ~long,
            F.expr(f"(cast(vested AS decimal(18,0)) * {FULL_PROGRESS}) div cast(_total AS decimal(18,0))"),
        )
        .otherwise(
            F.col("_guess").cast("bigint")
            + F.when(F.col("_high") < 0, -1).when(F.col("_over"), 1).otherwise(0)
        )
    )
    return settle(staged.withColumn("progress", progress).select(*valued.columns, "progress"), ["progress"])


def with_valuation(streams: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """Add vested, withdrawable, locked, progress and status."""
    valued = with_progress(with_withdrawable(with_vested(streams, as_of)))
    return valued.withColumn("status", status_of(clock(as_of)))


def view(streams: DataFrame, as_of: int | Column | None = None) -> DataFrame:
    """The public row of a stream: 15 fields, every big number as decimal text."""
    texts = ("total_amount", "withdrawn", "start_time", "end_time", "cliff_time")
    return (
        with_valuation(streams, as_of)
        .withColumn("id", F.col("stream_id").cast("string"))
        .withColumns({name: F.col(name).cast("string") for name in texts})
        .select(*VIEW_COLUMNS)
    )
