"""Stored stream rows in layouts for look-ups, so that a read touches the files it needs and folds nothing.

    streams      bucketed and sorted by stream id: look-ups by id, and joins with batches of events on the stream id
    by_sender    bucketed by party and slot, sorted by stream id: the streams of a party, and how many they are
    by_recipient the same
    newest       cut into ranges of falling stream ids, about equally long: pages of the list of all streams
    ranges       rows per range, the order statistics of ``newest``
    counts       streams per party of each role, and in all

A party's streams are spread over ``SLOTS`` buckets, so a party that holds a large part of all streams is no bucket of its own. The
parties of a stream never change, so counts only grow by the streams that are new in a version (``grown``).
Tables are external ones in the shared folder, known to the session by their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.functions.vesting import VIEW_COLUMNS, view
from rivulet.operators import reads
from rivulet.schemas import STREAM_COLUMNS
from rivulet.session import fresh_folder

SLOTS, BUCKETS, RANGES = 4, 16, 64
ROWS_PER_BUCKET = 500_000  # about 150 MB of rows in a sort
ROLES = ("sender", "recipient", "token")
LAYOUTS = {"sender": "by_sender", "recipient": "by_recipient"}  # as many as the look-ups by party have


def _slotted(party: Column, slot: Column) -> Column:
    return F.concat(party, F.lit("#"), slot.cast("string"))


def _slot_of(stream_id: Column) -> Column:
    return F.pmod(F.xxhash64(stream_id.cast("decimal(20,0)")), F.lit(SLOTS))


def sizes(rows: int) -> dict[str, int]:
    """Buckets and ranges for about so many streams: a task of ``StoredStreams.write`` sorts the rows of one of them."""
    wanted = -(-rows // ROWS_PER_BUCKET)
    return {"buckets": max(BUCKETS, wanted), "ranges": max(RANGES, wanted)}


def party_counts(streams: DataFrame) -> DataFrame:
    """role, party, n: how many streams each party has in each role; role '' counts all."""
    each = F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("party")), *(F.struct(F.lit(r).alias("role"), F.col(r).alias("party")) for r in ROLES))
    return streams.select(F.explode(each).alias("of")).groupBy("of.role", "of.party").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class StoredStreams:
    """One version of the stored rows. ``sizes`` says how many buckets and ranges it should have."""

    spark: SparkSession
    name: str

    def table(self, layout: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{layout}")

    @property
    def streams(self) -> DataFrame:
        return self.table("streams")

    @staticmethod
    def write(state: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES, before: StoredStreams | None = None, lookups: bool = True) -> StoredStreams:
        """Store a state as a new version. before: the version it grew out of, whose counts are carried on.

        Without lookups only ``streams`` is written, which is what the next fold needs.
        """
        spark = state.sparkSession
        folder = fresh_folder(spark, "stored")
        stored = StoredStreams(spark, f"stored_{uuid.uuid4().hex}")

        def save(frame: DataFrame, layout: str, by: str | None = None, order: list[str] | None = None, split: str | None = None) -> None:
            writer = frame.write.format("parquet").option("path", f"{folder}/{layout}")
            writer = writer.bucketBy(buckets, by).sortBy(*order) if by else writer
            (writer.partitionBy(split) if split else writer).saveAsTable(f"{stored.name}_{layout}")

        save(state.select(*STREAM_COLUMNS).repartition(buckets, "stream_id"), "streams", "stream_id", ["stream_id"])
        if not lookups:
            return stored
        rows = stored.streams
        for role, layout in LAYOUTS.items():
            keyed = rows.where(F.col(role).isNotNull()).withColumn("party_slot", _slotted(F.col(role), _slot_of(F.col("stream_id"))))
            save(keyed.repartition(buckets, "party_slot"), layout, "party_slot", ["party_slot", "stream_id"])
        ranged = rows.repartitionByRange(ranges, F.desc("stream_id")).withColumn("range_no", F.spark_partition_id())
        save(ranged.sortWithinPartitions(F.desc("stream_id")), "newest", split="range_no")
        # The range of a row is what was written; the counts are taken from there.
        save(stored.table("newest").groupBy("range_no").agg(F.count(F.lit(1)).alias("n")), "ranges")
        save(party_counts(rows) if before is None else stored.grown(before), "counts")
        return stored

    def grown(self, before: StoredStreams) -> DataFrame:
        """The counts of ``before`` and of the streams that are new since; both sides of the join are bucketed alike."""
        fresh = self.streams.join(before.streams.select("stream_id"), "stream_id", "left_anti")
        both = before.table("counts").unionByName(party_counts(fresh))
        return both.groupBy("role", "party").agg(F.sum("n").alias("n"))

    def _of_party(self, role: str, party: str) -> DataFrame:
        keys = [f"{party}#{slot}" for slot in range(SLOTS)]
        return self.table(LAYOUTS[role]).where(F.col("party_slot").isin(keys) & (F.col(role) == party))

    def matching(self, **parties: str | None) -> DataFrame:
        """The streams of all the given parties, from the layout of one of them."""
        role = next((r for r in LAYOUTS if parties.get(r)), None)
        rows = self.streams if role is None else self._of_party(role, parties[role])
        return reads.filter_streams(rows, **parties).select(*STREAM_COLUMNS)

    def by_id(self, raw: str | int) -> DataFrame:
        """The stream with this id from its own bucket; ``ValueError`` when it is not an id."""
        return reads.stream_by_id(self.streams, raw)

    def listed(self, limit=None, offset=None, **parties: str | None) -> DataFrame:
        """One page of matching streams, newest id first."""
        if any(parties.values()):
            return reads.list_streams(self.matching(**parties), limit, offset)
        return self._of_all(reads.parse_limit(limit), reads.parse_offset(offset))

    def _of_all(self, take: int, skip: int) -> DataFrame:
        """A page of the list of all streams: the ranges that hold it are chosen by their counts, and no other file is opened."""
        upto = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per range
        ends = self.table("ranges").withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
        wanted = ends.where((F.col("start") < skip + take) & (F.col("end") > skip)).select("range_no", "start")
        place = F.col("start") + F.row_number().over(Window.partitionBy("range_no").orderBy(F.desc("stream_id")))
        rows = self.table("newest").join(F.broadcast(wanted), "range_no").withColumn("place", place)
        return rows.where((F.col("place") > skip) & (F.col("place") <= skip + take)).orderBy(F.desc("stream_id")).select(*STREAM_COLUMNS)

    def count(self, **parties: str | None) -> DataFrame:
        """How many streams match: kept counts for one party or none, else the rows of one of the parties."""
        given = {r: p for r, p in parties.items() if p}
        if len(given) > 1:
            return reads.count_streams(self.matching(**parties))
        role, party = next(iter(given.items()), ("", ""))
        kept = self.table("counts").where((F.col("role") == role) & (F.col("party") == party))
        return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page(self, as_of=None, limit=None, offset=None, **parties: str | None) -> DataFrame:
        """The whole answer as one row: views of the page, total, limit and offset, all from one version."""
        views = view(self.listed(limit, offset, **parties), as_of).select(F.struct(*VIEW_COLUMNS).alias("view"))
        return reads.envelope(views, self.count(**parties), limit, offset)
