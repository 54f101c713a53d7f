"""Token counts by a map-side table in two tiers: no pre-token is ever shuffled.

Tier one is a broadcast dictionary of the token counts of frequent pre-tokens, learnt from a bounded
sample; tier two is a dictionary in every Python worker, which is emptied when it is full. Both only
save work: a pre-token in neither is encoded by the library. No piece of the vocabulary holds a space after
another character or a line break beside one (checked when the file is loaded), so a text may be cut
before each run of spaces and around each line break, and the counts of the parts add up.

A null or empty text has no tokens; texts with the vocabulary's own space sign, with double or outer
spaces or with spaces before line breaks are cut by a slower rule, and are exact too. Rows are counted
one by one, whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.text import flat, named, pieces

SIGN = "▁"
_WORKER: dict[str, tuple[object, dict[str, int]]] = {}
_RUN = re.compile(" +[^ ]*")


def load(path: str):
    """The tokenizer; raises if its pieces do not allow the cuts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if SIGN in piece.lstrip(SIGN) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    if len(model.encode("a  a")) != len(model.encode("a")) * 2 + 1:
        raise ValueError("the tokenizer merges spaces")
    return model


def cut(text: str) -> list[str] | None:
    """Keys of a text's pre-tokens; None where only the whole text will do. A key that starts with a line break stands without a space."""
    if SIGN in text or "\0" in text:
        return None
    if not text:
        return []
    if "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
        return ["\1" + run[1:] for run in _RUN.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def _encode(model, keys: list[str]) -> list[int]:
    """Counts of keys: "\\1..." is a run as it stands; "\\n..." follows a line without a space, whose sign is taken off again."""
    plain = [k[1:] if k[:1] == "\1" else k for k in keys]
    out = [len(x) for x in model.encode(plain, num_threads=1)]
    return [1 if p == "" else n - (k[:1] == "\n") for k, p, n in zip(keys, plain, out, strict=True)]


def _sum(model, texts: list[str], frequent: dict[str, int], own: dict[str, int], room: int) -> list[int]:
    cuts = [cut(t) for t in texts]
    missing = {k for keys in cuts if keys for k in keys}.difference(frequent).difference(own)
    if missing:
        if len(own) + len(missing) > room:
            own.clear()
            missing = {k for keys in cuts if keys for k in keys}.difference(frequent)
        missing = list(missing)
        own.update(zip(missing, _encode(model, missing), strict=True))
    out = []
    for text, keys in zip(texts, cuts, strict=True):
        if keys is None:
            out.append(len(model.encode(text)))
        else:
            out.append(sum(frequent[k] if k in frequent else own[k] for k in keys))
    return out


def frequent_lengths(docs: DataFrame, path: str, *, sample: int = 1000, entries: int = 20_000) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of ``sample`` texts of at most 64 kB: at most ``entries`` of them."""
    some = docs.select("text").where(F.octet_length("text") <= 65536).limit(sample)
    counts = Counter(k for (t,) in some.collect() for k in cut(t) or ())
    keys = [k for k, n in counts.most_common(entries) if n > 1]
    return dict(zip(keys, _encode(load(path), keys), strict=True)) if keys else {}


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096, sample: int = 1000, entries: int = 20_000, room: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs. ``path`` must be readable on every executor."""
    docs = named(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample=sample, entries=entries))

    def counted(batches):
        if path not in _WORKER:
            _WORKER[path] = load(path), {}
        model, own = _WORKER[path]
        for part in pieces(batches, size=1 << 20):
            _, offsets = flat(part.column("text"))
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = _sum(model, texts, table.value, own, room)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id").combine_chunks().cast(pa.int64()), "n_bytes": pa.array(offsets[1:] - offsets[:-1]), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            )

    return docs.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
