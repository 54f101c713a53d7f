"""WARC archives of pages: records cut into segments, and their reassembly.

Writing: a page is a response record whose block is an HTTP message in chunked transfer coding. A block of
over ``segment_bytes`` is cut; the first segment is the response, the others are continuation records
with its id, their number, and on the last one the block's length. Pages with equal payloads of
``least`` bytes or more become revisits of the one with the smallest page_id.
Reading: whole records pass; segments are grouped by the id of their origin, put in order, checked for
gaps and for the total length, joined, and decoded from the chunked coding.

Equal payloads are found by their digests: a partial minimum per digest, and a join with those that occur
twice; a digest of a third of all rows is one row on the joined side. A null html is an empty payload,
a null page_id is larger than all others and never referred to; rows of the smallest page_id that are
repeated are all responses. An empty table gives an empty archive and no rows. A record that does
not parse raises, since it cannot be skipped over safely.

Archives from elsewhere are read too: records other than responses, revisits and resources are passed over by their type, and a
payload is checked against the SHA-1 or SHA-256 its record names, in hex or base 32; other digests are not checked. Such records
have no page_id, and are known by their url. An archive is unpacked and read record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from datetime import datetime, timezone

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.text import named, pieces
from rivulet.session import fresh_folder

VERSION = b"WARC/1.1"
_RECORD = "record_id string, origin_id string, segment long, total long, page_id long, record_type string, refers_to long, digest string, url string, block binary"
PAGES = ("response", "revisit", "resource")
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def to_chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = stop + 2
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def payload_of(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP message, and the length that its head names (the payload's own if it names none)."""
    if not block.startswith(b"HTTP/"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = from_chunked(body)
    return body, int(fields.get(b"content-length", len(body)))


def record(fields: list[tuple[bytes, object]], block: bytes) -> bytes:
    """A record without the two line breaks that end it."""
    head = b"".join(b"%b: %b\r\n" % (k, v if isinstance(v, bytes) else str(v).encode()) for k, v in fields if v is not None)
    return b"%b\r\n%bContent-Length: %d\r\n\r\n%b" % (VERSION, head, len(block), block)


def digest_of(payload: bytes, said: str | None) -> str:
    """The payload's SHA-256 in hex; raises if the digest that its record names is one of another payload."""
    own = hashlib.sha256(payload).hexdigest()
    kind, _, value = (said or "").partition(":")
    if kind in ("sha1", "sha256"):
        found = hashlib.new(kind, payload).digest()
        if value.lower() != found.hex() and value.rstrip("=") != base64.b32encode(found).decode().rstrip("="):
            raise ValueError("a payload does not match its digest")
    return own


def records(page_id, url, payload: bytes, digest: str, first, segment_bytes: int, date: str):
    """The records of one page."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    dated = [(b"WARC-Date", date)]
    target = re.sub(r"[\r\n]+", " ", url) if url else None
    shared = [(b"WARC-Target-URI", target), (b"WARC-Payload-Digest", "sha256:" + digest), (b"Page-Id", page_id)]
    if first is not None:
        block = _HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([(b"WARC-Type", "revisit"), (b"WARC-Record-ID", own), *dated, *shared, (b"WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"Refers-To-Page-Id", first)], block)
        return
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + to_chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for n, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if n == 1:
            yield record([(b"WARC-Type", "response"), (b"WARC-Record-ID", own), *dated, *shared, *([(b"WARC-Segment-Number", 1)] if len(cuts) > 1 else [])], part)
        else:
            total = len(block) if n == len(cuts) else None
            yield record([(b"WARC-Type", "continuation"), (b"WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *dated, (b"WARC-Segment-Origin-ID", own), (b"WARC-Segment-Number", n), (b"WARC-Segment-Total-Length", total)], part)


def parse(file):
    """(fields, block) of every record of an archive, read from a binary file one after another."""
    while line := file.readline():
        if not line.strip():
            continue  # the line breaks that end a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {file.tell() - len(line)}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields[b"content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block


def write_archive(pages: DataFrame, path: str, *, least: int = 100, segment_bytes: int = 16384, records_per_file: int = 1000, date: str | None = None) -> None:
    """Writes a compressed archive of pages (page_id, url, html) below ``path``. date: when they were fetched, by default now."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = named(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= least
    big, small = rows.where(large), rows.where(~large)  # small ones, all empty pages among them, are not shuffled
    copies = big.groupBy(F.unhex("digest").alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null").select("key", "first")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    joined = big.join(copies, F.unhex(big.digest) == copies.key, "left").select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("first"))
    joined = joined.unionByName(small.withColumn("first", F.lit(None).cast("long")))

    def written(batches):
        for part in pieces(batches, "payload"):
            columns = (part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first"))
            out = [r for row in zip(*columns, strict=True) for r in records(*row, segment_bytes, date)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    lines = joined.mapInArrow(written, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Responses, revisits and resources, and all segments, of the archives below ``path``."""

    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                data, rows, size = data.as_py(), [], 0
                file = io.BytesIO(data)
                for fields, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=file)) if data[:2] == b"\x1f\x8b" else file):
                    text = lambda k, f=fields: f[k].decode("utf-8", "replace") if k in f else None
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    kind = (text(b"warc-type") or "").lower()
                    if kind not in (*PAGES, "continuation") and b"warc-segment-number" not in fields:
                        continue
                    rows.append((text(b"warc-record-id"), text(b"warc-segment-origin-id") or text(b"warc-record-id"), number(b"warc-segment-number"), number(b"warc-segment-total-length"), number(b"page-id"), kind, number(b"refers-to-page-id"), text(b"warc-payload-digest"), text(b"warc-target-uri"), block))
                    size += len(block)
                    if size > 2 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def reassemble(found: DataFrame) -> DataFrame:
    """One row per page record: page_id, record_type, refers_to, digest, url, block; raises on gaps and wrong lengths."""
    own = ["page_id", "record_type", "refers_to", "digest", "url"]
    alone = found.where("segment is null").select(*own, "block")
    joined = (
        found.where("segment is not null")
        .groupBy("origin_id")
        .agg(*(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in own), F.max("total").alias("total"), F.max("segment").alias("most"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
        .withColumn("block", F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary"))
    )
    right = (F.size("parts") == F.col("most")) & F.forall(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i.cast("int"))["segment"] == i) & F.col("total").eqNullSafe(F.octet_length("block"))
    checked = F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), F.col("origin_id"))).cast("binary"))
    return alone.unionByName(joined.where(F.col("record_type").isin(*PAGES) | F.col("record_type").isNull()).select(*own, checked.alias("block")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for a revisit).

    The digest of a response is computed from the decoded payload, which must match the one that its record names; that of a revisit is the
    one named, without its ``sha256:``.
    """

    def decoded(batches):
        for part in pieces(batches, "block"):
            bodies = [payload_of(b) for b in part.column("block").to_pylist()]
            kinds, said = part.column("record_type").to_pylist(), part.column("digest").to_pylist()
            digest = [(d or "").removeprefix("sha256:") if k == "revisit" else digest_of(b, d) for (b, _), k, d in zip(bodies, kinds, said, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": part.column("page_id").combine_chunks(),
                    "payload_bytes": pa.array([n for _, n in bodies], pa.int64()),
                    "payload_digest": pa.array(digest, pa.string()),
                    "record_type": pa.array(kinds, pa.string()),
                    "refers_to": part.column("refers_to").combine_chunks(),
                    "url": part.column("url").combine_chunks(),
                    "payload": pa.array([None if k == "revisit" else b for (b, _), k in zip(bodies, kinds, strict=True)], pa.binary()),
                }
            )

    return reassemble(read_records(spark, path)).mapInArrow(decoded, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads it back."""
    path = fresh_folder(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_pages(pages.sparkSession, path)
