"""Vectorised text helpers shared by the operators: flat buffers, words, rolling hashes.

Hashes are 64-bit. Every value of a byte is drawn once from a seeded generator, and a string hashes to
the sum of its bytes' values times powers of an odd number, mixed at the end, so that equal strings
hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, PIECE + 4096), _powers(_BACK, PIECE + 4096)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over the whole word (two rounds of multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one buffer, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def window_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes of buf, which is at most PIECE + 4095 bytes long."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _UP[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _DOWN[: n - k + 1])


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of all rows; words never cross rows."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word. Words are taken piece by piece; one longer than a piece is hashed in parts."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + PIECE, "right")), i)
        if j == i:
            total = np.uint64(ends[i] - starts[i])
            for part in range(base, int(ends[i]), PIECE):
                piece = buf[part : min(part + PIECE, int(ends[i]))]
                total = mix(np.array([total], np.uint64) ^ window_hash(piece, len(piece)))[0]
            out[i] = total
            i += 1
            continue
        piece = buf[base : int(ends[j - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * _UP[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a column; one narrow scan with a partial sum."""
    return docs.agg(F.sum(F.octet_length(column))).head()[0] or 0


def named(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns cannot clash with those an operator adds."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def pieces(batches, column: str = "text", size: int = 2 << 20):
    """Cuts Arrow batches into tables of about ``size`` bytes of the column; a longer row stands alone."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        _, offsets = flat(table.column(column))
        i = 0
        while i < table.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield table.slice(i, j - i)
            i = j


def grams(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, at the place of the first; those that cross rows are wrong, see ``whole``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def whole(row: np.ndarray, n: int) -> np.ndarray:
    """Which of the n-word windows lie inside one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over every row."""
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[offsets[1:]] - upto[offsets[:-1]]
