"""The stored mirror: versioned, hash-bucketed Parquet, with its dead letters and position.

A batch rewrites only the buckets it touches. Everything a batch writes goes under its own version
number, and the one-file manifest of that version comes last: until it is there the version does not
exist, so a batch that dies is simply run again.

    data/version=7/bucket=12/...     stream rows; a bucket stays valid until a later version rewrites it
    events/version=7/...             the decoded events of the batch
    outcomes/version=7/...           what each event of the batch did
    failures/version=7/...           dead letters open after the batch
    counters/version=7/...           events by kind and outcome, of all batches up to it
    positions/version=7/...          the position after every page of the batch
    manifest/version=7/...           bucket -> version of its data, last page, position
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import failures as dead
from rivulet.operators import position as pos
from rivulet.operators.fold import KINDS, fold
from rivulet.operators.reads import parse_stream_id, stream_by_id
from rivulet.schemas import EVENT_COLUMNS, OUTCOME_COLUMNS, STREAM_COLUMNS, TIME, event_schema, stream_schema

MANIFEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("data_version", T.LongType()),
        T.StructField("high_page", T.LongType()),
        T.StructField("last_ledger", T.LongType()),
        T.StructField("chain_ledger", T.LongType()),
        T.StructField("cursor", T.StringType()),
        T.StructField("bucket_count", T.IntegerType()),
        T.StructField("seen_at", T.LongType()),
        T.StructField("waiting_since", T.LongType()),
    ]
)
POSITIONS = "page_seq bigint, last_ledger bigint, chain_ledger bigint, cursor string, lag_ledgers bigint"
FAILURES = "event_id string, kind string, stream_id string, ledger bigint, error string, failure_count bigint"
COUNTERS = "kind string, outcome string, value bigint"
COUNTED = [(k, o) for k in (*KINDS, "unknown") for o in ("applied", "duplicate", "reconciled", "missing", "failed")]
NO_BUCKET = -1
COMPRESSION = "zstd"  # ids, hashes and addresses take much less room than with the default
DEFAULT_BUCKETS = 64


@dataclass(frozen=True)
class Version:
    """A committed state of the store. ``buckets`` maps a bucket to the version of its data.

    ``high_page``, ``seen_at`` and ``waiting_since`` (the oldest arrival behind a gap) say which pages have been folded.
    """

    number: int
    buckets: dict[int, int]
    high_page: int
    last_ledger: int | None
    chain_ledger: int | None
    cursor: str | None
    seen_at: int = 0
    waiting_since: int | None = None


class MirrorStore:
    """``buckets`` is fixed for the life of a store; about one per 128 MB of stream rows is right.

    The count is part of the manifest: a store is opened with its own, and another one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, first_page: int = 0):
        self.spark = spark
        self.path = path.rstrip("/")
        stored = self._stored_buckets()
        if buckets and stored and buckets != stored:
            raise ValueError(f"the store at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or DEFAULT_BUCKETS
        self.first_page = first_page
        self.schema = stream_schema(time=TIME)

    def bucket_of(self, stream_id: Column) -> Column:
        """Null for a null id, which no stream has."""
        placed = F.pmod(F.xxhash64(stream_id.cast("decimal(20,0)")), F.lit(self.buckets)).cast("int")
        return F.when(stream_id.isNotNull(), placed)

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _stored_buckets(self) -> int | None:
        manifest = self._manifest()
        return None if manifest is None else manifest.agg(F.max("bucket_count")).first()[0]

    def current(self) -> Version:
        """The newest committed version. Its manifest has one row per bucket."""
        manifest = self._manifest()
        if manifest is None:
            return Version(0, {}, self.first_page - 1, None, None, None)
        number = manifest.agg(F.max("version")).first()[0]
        rows = manifest.where(F.col("version") == number).collect()
        head = rows[0]
        kept = {r.bucket: r.data_version for r in rows if r.bucket != NO_BUCKET}
        return Version(number, kept, head.high_page, head.last_ledger, head.chain_ledger, head.cursor, head.seen_at or 0, head.waiting_since)

    def streams(self, version: Version | None = None, only: list[int] | None = None) -> DataFrame:
        """All stream rows, or those of some buckets."""
        version = version or self.current()
        wanted = version.buckets if only is None else {b: v for b, v in version.buckets.items() if b in only}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def stream(self, raw_id: str | int) -> DataFrame:
        """The row of one stream, from its own bucket alone; empty when there is none."""
        wanted = F.lit(str(parse_stream_id(raw_id))).cast("decimal(38,0)").try_cast("decimal(20,0)")
        bucket = self.spark.range(1).select(self.bucket_of(wanted)).first()[0]
        return stream_by_id(self.streams(only=[bucket]), raw_id)

    def failures(self, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if version.number == 0:
            return self.spark.createDataFrame([], FAILURES)
        return self.spark.read.schema(FAILURES).parquet(f"{self.path}/failures/version={version.number}")

    def counters(self, version: Version | None = None) -> DataFrame:
        """kind, outcome, value: events of all committed versions, kept from drain to drain."""
        version = version or self.current()
        if version.number == 0:
            return self.spark.createDataFrame([], COUNTERS)
        return self.spark.read.schema(COUNTERS).parquet(f"{self.path}/counters/version={version.number}")

    def outcomes(self) -> DataFrame:
        """The outcome log of all committed versions."""
        last = self.current().number
        return self.spark.read.parquet(f"{self.path}/outcomes").where(F.col("version") <= last).drop("version")

    def position(self) -> DataFrame:
        """One row once something has been committed, none before."""
        version = self.current()
        rows = [] if version.number == 0 else [(version.last_ledger, version.chain_ledger, version.cursor)]
        return self.spark.createDataFrame(rows, "last_ledger bigint, chain_ledger bigint, cursor string")

    def positions(self) -> DataFrame:
        """The position as saved after every page of all committed versions."""
        last = self.current().number
        return self.spark.read.parquet(f"{self.path}/positions").where(F.col("version") <= last)

    def apply(self, events: DataFrame, pages: DataFrame, high_page: int, snapshot=None, floor: int = 0, seen_at: int = 0, waiting_since: int | None = None, broken: DataFrame | None = None) -> Version:
        """Fold a batch in and commit it as the next version. broken: failed attempts that are no events."""
        before = self.current()
        number = before.number + 1
        self._write(events.select(*EVENT_COLUMNS), "events", number)  # decoded once, read several times
        events = self.spark.read.schema(event_schema(time=TIME)).parquet(f"{self.path}/events/version={number}")
        touched = [r[0] for r in events.select(self.bucket_of(F.col("stream_id")).alias("b")).distinct().collect()]
        touched = [b for b in touched if b is not None]
        stored = self.streams(before, touched)

        folded = fold(events, stored, snapshot)
        # The counters of the batch are observed while its outcomes are written.
        seen = Observation(f"outcomes-{number}")
        self._write(folded.outcomes.select(*OUTCOME_COLUMNS).observe(seen, *(F.count_if((F.col("kind") == k) & (F.col("outcome") == o)).alias(f"{k} {o}") for k, o in COUNTED)), "outcomes", number)
        placed = folded.state.select(*STREAM_COLUMNS).withColumn("bucket", self.bucket_of(F.col("stream_id")))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/data/version={number}", compression=COMPRESSION
        )
        attempts = events if broken is None else events.unionByName(broken.withColumn("kind", F.lit("unknown")), allowMissingColumns=True)
        self._write(dead.open_failures(attempts, self.failures(before)), "failures", number)

        claimed = floor if before.last_ledger is None else before.last_ledger
        self._write(pos.position_history(pos.page_progress(events, pages), claimed), "positions", number)
        saved = self.spark.read.schema(POSITIONS).parquet(f"{self.path}/positions/version={number}")
        now = pos.last_position(saved, before.high_page, claimed, before.chain_ledger, before.cursor)
        written = self._written_buckets(number)
        moved = {**before.buckets, **{b: number for b in written}} or {NO_BUCKET: number}
        counted = {(r.kind, r.outcome): r.value for r in self.counters(before).collect()}  # one row per kind and outcome
        fresh = seen.get
        added = [(k, o, counted.get((k, o), 0) + fresh[f"{k} {o}"]) for k, o in COUNTED]
        self._write(self.spark.createDataFrame([r for r in added if r[2]], COUNTERS).coalesce(1), "counters", number)
        rows = [(b, v, high_page, *now, self.buckets, seen_at, waiting_since) for b, v in sorted(moved.items())]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        self._write(manifest, "manifest", number)
        return self.current()

    def _written_buckets(self, number: int) -> list[int]:
        """Buckets that got a file; a touched one stays empty when all its events were missing."""
        try:
            data = self.spark.read.parquet(f"{self.path}/data/version={number}")
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        return [r[0] for r in data.select("bucket").distinct().collect()]

    def _write(self, frame: DataFrame, kind: str, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/{kind}/version={number}", compression=COMPRESSION)
