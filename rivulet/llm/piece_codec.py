"""SentencePiece (BPE) encoding that keeps offsets, and decoding.

A text is first normalised by the model's compiled character map: at every place the longest key that the text goes on with is
replaced, else one character is kept; spaces become the space sign. For every byte of the normal form the byte of the text it
came from is recorded. The normal form is then cut into pieces by the model's merges, and the border of each piece is carried back
through that record, so every piece has a span of bytes in the original text.

No piece of a model holds the space sign behind another character (else texts are not cut), so the normal form is cut before each run of signs, and around
line breaks and tabs if no longer piece has one; the library merges each part once a worker (with normalisation off), and its pieces are kept in a
table that is emptied when it holds ``ROOM`` bytes. Pieces are laid out for a whole batch by numpy. Long texts go
through in sections of the normal form. Nothing is shuffled.

A null or empty text has no pieces. Texts may hold the space sign itself, control characters, unknown characters (bytes, or the unknown id) and the names
of control pieces, which are ordinary text. Repeated rows are encoded each; an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

import itertools
import re
import struct
from array import array

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from rivulet.llm.text import flat, named, pieces, ranges

SIGN, ROOM, SECTION = "▁", 64 << 20, 1 << 19
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in a model
_BPE = 2  # kind of a model
_CODECS: dict[str, "Codec"] = {}
_COLUMNS = ("doc_id", "n_tokens", "ids", "begins", "ends")
_ENCODED = "doc_id long, n_tokens long, ids array<int>, begins array<int>, ends array<int>"


def character_map(blob: bytes) -> dict[str, str]:
    """Keys and replacements of a compiled map: a double array of 32-bit units, then texts ended by zero bytes."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]

    def step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    found: dict[str, str] = {}
    todo = [(step(units[0]), b"")]
    while todo:
        node, key = todo.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            unit = units[at]
            below = at ^ step(unit)
            if unit >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                found[(key + bytes([byte])).decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, key + bytes([byte])))
    return found


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != _BPE or kinds & {_USER, _UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces can be read")
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = character_map(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.behind = proto.trainer_spec.treat_whitespace_as_suffix
        self.space = SIGN if self.escape else " "
        known = {p.piece for p in proto.pieces if p.type == _NORMAL}
        self.width = np.array([len(p.piece.encode()) if p.type == _NORMAL else 0 for p in proto.pieces], np.int32)
        self.byte = np.array([int(p.piece[1:-1], 16) if p.type == _BYTE else -1 for p in proto.pieces], np.int32)
        self.bytes, self.unknown = proto.trainer_spec.byte_fallback, next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        plain = proto.normalizer_spec
        plain.precompiled_charsmap, plain.add_dummy_prefix, plain.remove_extra_whitespaces, plain.escape_whitespaces = b"", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())  # takes normal forms
        longest: dict[str, int] = {}
        for key in self.map:
            longest[key[0]] = max(longest.get(key[0], 0), len(key))
        self.longest = longest
        alone = re.escape("".join(c for c in "\n\t" if not any(c in p and p != c for p in known)))
        crossing = self.behind or self.space not in known or any(self.space in p.lstrip(self.space) for p in known)
        s = re.escape(self.space)
        self.parts = None if crossing else re.compile(f"{s}*[{alone}]|{s}*[^{s}{alone}]+|{s}+" if alone else f"{s}*[^{s}]+|{s}+")
        self.isolated = self.bytes and not crossing and "\\\n" in alone
        self.border = re.compile(f"[^{s}]{s}")
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.ids, self.sizes, self.counts = array("i"), array("i"), array("i")

    # -- normal form --------------------------------------------------------------------------------

    def normal(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form, and for every byte of it and its end the byte of the text it came from."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not self.map and not self.squeeze:
            head = self.dummy and not self.behind and len(data) > 0
            tail = self.dummy and self.behind and len(data) > 0
            form = (self.space if head else "") + text.replace(" ", self.space) + (self.space if tail else "")
            wide = len(self.space.encode())
            times = np.where(data == 0x20, wide, 1)
            origin = np.concatenate([np.zeros(wide * head, np.int64), np.repeat(np.arange(len(data)), times), np.full(wide * tail, len(data)), [len(data)]])
            return form, origin
        return self._mapped(text)

    def _next(self, text: str, i: int) -> tuple[str, int]:
        """What stands for the text from i on, and how many characters it stands for."""
        for size in range(min(self.longest.get(text[i], 0), len(text) - i), 0, -1):
            if (found := self.map.get(text[i : i + size])) is not None:
                return found, size
        return text[i], 1

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        parts, origin, i, at = [], [], 0, 0

        def add(part: str) -> None:
            for c in part:
                c = self.space if c == " " else c
                parts.append(c)
                origin.extend([at] * len(c.encode()))

        while self.squeeze and i < len(text):
            part, size = self._next(text, i)
            if part != " ":
                break
            at += len(text[i : i + size].encode())
            i += size
        if i == len(text):
            return "", np.array([at])
        if self.dummy and not self.behind:
            add(" ")
        after_space = self.squeeze
        while i < len(text):
            part, size = self._next(text, i)
            if after_space:
                part = part.lstrip(" ")
            if part:
                add(part)
                after_space = self.squeeze and part.endswith(" ")
            at += len(text[i : i + size].encode())
            i += size
        width = len(self.space.encode())
        while self.squeeze and parts and parts[-1] == self.space:
            parts.pop()
            at = origin[len(origin) - width]
            del origin[len(origin) - width :]
        if self.dummy and self.behind:
            add(" ")
        return "".join(parts), np.array([*origin, at], np.int64)

    # -- pieces -------------------------------------------------------------------------------------

    def _merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each part, ids, sizes in bytes) by the model's merges alone."""
        if not self.isolated:
            found = [self.merges.encode(p, return_type="proto").pieces for p in parts]
            flat_found = list(itertools.chain.from_iterable(found))
            return np.array([len(f) for f in found]), np.array([p.id for p in flat_found], np.int32), np.array([p.end - p.begin for p in flat_found], np.int32)
        # One text of all parts, a line break between any two, which nothing merges with.
        ids = np.array(self.merges.encode("\n".join(parts)), np.int32)
        sizes, byte = self.width[ids], self.byte[ids]
        inner = (byte & 0xC0) == 0x80  # a byte of an unknown character, but not its first
        lead = np.flatnonzero((byte >= 0) & ~inner)
        last = np.flatnonzero((byte >= 0) & ~np.append(inner[1:], False))
        sizes[last] = last - lead + 1  # the last of its bytes spans an unknown character
        begin = np.cumsum(sizes) - sizes
        lengths = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        first = np.cumsum(lengths + 1) - lengths - 1
        of = np.searchsorted(first, begin, "right") - 1
        own = begin < first[of] + lengths[of]
        return np.bincount(of[own], minlength=len(parts)), ids[own], sizes[own]

    def _learn(self, parts: list[str]) -> None:
        counts, ids, sizes = self._merged(parts)
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.counts.frombytes(counts.astype(np.int32).tobytes())
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts)), strict=True))
        self.held += 160 * len(parts) + sum(map(len, parts)) + 8 * len(ids)

    def _sections(self, form: str):
        """The parts of a normal form, some at a time."""
        if self.parts is None:
            yield [form] if form else []
            return
        at = 0
        while at < len(form):
            border = self.border.search(form, at + SECTION) if len(form) > at + SECTION else None
            end = border.end() - len(self.space) if border else len(form)
            yield self.parts.findall(form, at, end)
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each row, ids, begins, ends): spans in bytes of the row's own text."""
        origins, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        counts = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        rows: list[tuple[int, int]] = []  # (row, parts) of the waiting parts

        def lay_out() -> None:
            if self.held > ROOM:
                self._empty()
            known = list(map(self.place.get, waiting))
            if None in known:
                self._learn(list(dict.fromkeys(itertools.compress(waiting, (k is None for k in known)))))
                known = list(map(self.place.get, waiting))
            code, own = np.array(known, np.int64), np.frombuffer(self.counts, np.int32).astype(np.int64)
            at = ranges((np.cumsum(own) - own)[code], own[code])
            ids.append(np.frombuffer(self.ids, np.int32)[at])
            sizes.append(np.frombuffer(self.sizes, np.int32)[at])
            np.add.at(counts, np.repeat([r for r, _ in rows], [n for _, n in rows]), own[code])
            waiting.clear()
            rows.clear()

        for row, text in enumerate(texts):
            form, origin = self.normal(text)
            origins.append(origin)
            for parts in self._sections(form):
                waiting.extend(parts)
                rows.append((row, len(parts)))
                if len(waiting) > SECTION:
                    lay_out()
        if waiting:
            lay_out()
        ids, origin = np.concatenate(ids), np.concatenate(origins)
        size, row = np.concatenate(sizes), np.repeat(np.arange(len(texts)), counts)
        upto = np.cumsum(size, dtype=np.int64) + row  # every row before has one place more, its end
        begins, ends = origin[upto - size], origin[upto]
        if not self.bytes:  # neighbouring unknown pieces are one
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (row[1:] == row[:-1])
            kept = np.flatnonzero(~same)
            ids, begins, ends = ids[kept], begins[kept], ends[np.append(kept[1:], len(row))[: len(kept)] - 1]
            counts = np.bincount(row[kept], minlength=len(texts))
        return counts, ids, begins, ends

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


def codec(path: str) -> Codec:
    """The codec of a model file, read once a worker."""
    if path not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[path] = Codec(file.read())
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, and the spans begins and ends (bytes of the original text) of every row of docs.

    ``path`` must be readable on every executor. decoded adds the text that the library makes of the ids, in the same pass.
    """

    def encoded(batches):
        own = codec(path)
        for part in pieces(batches, size=1 << 20):
            counts, ids, begins, ends = own.encode([t or "" for t in part.column("text").to_pylist()])
            at = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32))) for values in (ids, begins, ends)]
            columns = dict(zip(_COLUMNS, (part.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(counts), *lists), strict=True))
            if decoded:
                columns["decoded"] = pa.array([own.decode(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return named(docs, "doc_id", "text").mapInArrow(encoded, f"{_ENCODED}, decoded string" if decoded else _ENCODED)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (of ``encode``) with decoded, the text of the ids as the library gives it."""

    def made(batches):
        own = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            texts = [own.decode(ids[i].values.to_numpy()) if ids[i].is_valid else "" for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(made, f"{_ENCODED}, decoded string")
