"""Fill-in-middle: the middle block of a text moves behind its end, marked by sentinels, and back.

A text is cut at two code points into prefix, middle and suffix. All work is done in one bytearray a text: the cuts are
found by a scan for the bytes that begin a code point, sentinels are inserted before each block, and
blocks are exchanged by rotations, each of them three reversals in place. ``restore`` inverts the rotations from the
output and its form alone and takes the sentinels out again; as no text with a sentinel in it is changed, and no sentinel can
arise across the border of a block, the text comes back exactly.

The draws are the first four groups of eight hex digits of sha256(``<seed>:<doc_id>``), so a row always gets
the same cuts, wherever it is computed. Rows are transformed one by one, whole, without a shuffle.

A null or empty text is plain and gives an empty output. A null doc_id draws from ``<seed>:`` alone. Repeated rows give repeated
results, texts with a sentinel stay plain, an empty table gives an empty result, and further columns are not carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from rivulet.llm.text import flat, named, pieces

PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def rotate(buf: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the blocks [start, middle) and [middle, end) of buf by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for i, j in ((start, middle), (middle, end), (start, end)):
        half = (j - i) // 2
        kept = view[i : i + half].copy()
        view[i : i + half] = view[j - half : j][::-1]
        view[j - half : j] = kept[::-1]


def exchange(buf: bytearray, first: int, second: int, form: str) -> None:
    """Text into output, in place; first and second are the byte offsets of the cuts."""
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buf[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if form == PSM:
        rotate(buf, middle, suffix, len(buf))
    else:
        rotate(buf, 0, suffix, len(buf))


def put_back(buf: bytearray, form: str) -> None:
    """Output into text, in place, by the rotations of ``exchange`` the other way round."""
    if form == PSM:
        start = buf.index(SUFFIX)
        moved = len(buf) - buf.index(MIDDLE, start)
    else:
        start = 0
        moved = len(buf) - buf.index(PREFIX)
    rotate(buf, start, len(buf) - moved, len(buf))
    middle = buf.index(MIDDLE)
    suffix = buf.index(SUFFIX, middle)
    for at in (suffix, middle, 0):
        del buf[at : at + 3]


def transform(docs: DataFrame, *, seed: int = 1, changed_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and the output text of every row of docs."""

    def moved(batches):
        for part in pieces(batches):
            buf, offsets = flat(part.column("text"))
            starts = np.flatnonzero((buf & 0xC0) != 0x80)  # where code points begin
            upto = np.searchsorted(starts, offsets)
            columns = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
            ids = part.column("doc_id").combine_chunks().cast(pa.int64())
            for i, doc_id in enumerate(ids.to_pylist()):
                text = bytearray(buf[offsets[i] : offsets[i + 1]])
                n = int(upto[i + 1] - upto[i])
                h1, h2, h3, h4 = draws(seed, doc_id)
                form, first, second = PLAIN, None, None
                if n and h3 % 100 < changed_percent and not any(mark in text for mark in SENTINELS):
                    form = SPM if h4 % 100 < spm_percent else PSM
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    at = [int(starts[upto[i] + cut] - offsets[i]) if cut < n else len(text) for cut in (first, second)]
                    exchange(text, *at, form)
                for name, value in zip(columns, (n, form, first, None if first is None else second - first, bytes(text)), strict=True):
                    columns[name].append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = {name: pa.array(values, kind) for (name, values), kind in zip(columns.items(), kinds, strict=True)}
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | arrays | {"output": arrays["output"].cast(pa.string())})

    return named(docs, "doc_id", "text").mapInArrow(moved, _TRANSFORMED)


def restore(rows: DataFrame) -> DataFrame:
    """rows (of ``transform``) with restored, the text rebuilt from output and form alone."""

    def rebuilt(batches):
        for part in pieces(batches, "output"):
            texts = []
            buf, offsets = flat(part.column("output"))
            for i, form in enumerate(part.column("form").to_pylist()):
                text = bytearray(buf[offsets[i] : offsets[i + 1]])
                if form != PLAIN:
                    put_back(text, form)
                texts.append(bytes(text))
            table = part.append_column("restored", pa.array(texts, pa.binary()).cast(pa.string()))
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(rebuilt, f"{_TRANSFORMED}, restored string")
