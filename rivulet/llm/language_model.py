"""Scores of texts by word counts of the corpus and by a gated recurrent network.

Learnt from are the texts whose crc32(doc_id as text) mod 5 is not 1. Words are lower-cased runs without ASCII
white space, known by 64-bit hashes, and every text ends with an end token.

Counts: documents are dealt to chunks; each chunk sends its distinct words with their training counts, packed, to
buckets of words, which sum them and answer every chunk in its own order. So all counts over all words are used, no
word's occurrences meet in one task, and a chunk sends a frequent word once.

Network: its words are the most frequent ones that make up ``SHARE`` of the words learnt from, ``LEAST`` or more, so they
grow with the corpus; what memory allows is ``MOST`` of them (a worker holds about 1 kB for each). ``words`` sets another number. Another word is the network's unknown word times
the word's share among all others, (c + 0.5) / (M + 0.5 (U + 1)) with the others' tokens M and distinct words U. Training
takes every training text once: the texts are dealt to ``rounds`` rounds; in each round every task trains a copy
on its texts, and the copies are averaged by their tokens, parameter by parameter, on the cluster, in packed blocks. The
network, which starts from the words' shares, is all that the driver and the workers hold of it.

A null or empty text is the end token alone. A null doc_id counts as the empty text in the crc32. Rows are learnt
from and scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.recurrent import END, Gru
from rivulet.llm.text import LOWER, flat, mix, named, pieces, total_bytes, word_hash, words
from rivulet.session import fresh_folder

CHUNK_BYTES = 8 << 20
SHARE = 0.75
LEAST = 1022
MOST = (1 << 16) - 2
BLOCK = 1 << 14  # parameters
END_HASH = mix(np.array([0xE0D], np.uint64))[0]
_NOTE = "chunk int, bucket int, data binary, word long, count long, tokens long, known long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclasses.dataclass
class Corpus:
    tokens: int  # N
    distinct: int  # V
    words: np.ndarray  # hashes of the network's words from id 2 on
    other_tokens: int
    other_distinct: int
    counts: np.ndarray  # of all ids

    def __post_init__(self):
        """Slots by the first bits of a hash: where the sorted hashes of a slot begin, and how many the fullest holds."""
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]
        bits = max(len(self.words).bit_length() + 3, 8)
        self.shift = np.uint64(64 - bits)
        ends = np.searchsorted(self.sorted >> self.shift, np.arange(1 << bits, dtype=np.uint64), "right")
        counts = np.diff(ends, prepend=0)
        self.first, self.most = (ends - counts).astype(np.int32), int(counts.max())

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        first = self.first[h >> self.shift]
        for k in range(self.most):
            at = np.minimum(first + k, len(self.words) - 1)
            own = np.flatnonzero(self.sorted[at] == h)
            out[own] = self.order[at[own]] + 2
        out[h == END_HASH] = END
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens with their ends, and the offsets of the texts."""
    buf, offsets = flat(column)
    buf = LOWER[buf]
    start, end, row = words(buf, offsets)
    count = np.bincount(row, minlength=len(offsets) - 1)
    at = np.append(0, np.cumsum(count + 1))
    out = np.full(at[-1], END_HASH, np.uint64)
    out[np.arange(len(row)) + row] = word_hash(buf, start, end)
    return out, at


def _note(chunk, bucket, data=None, word=None, count=None, tokens=None, known=None) -> pa.Table:
    n = len(bucket)
    none = [None] * n
    columns = [(chunk, pa.int32()), (bucket, pa.int32()), (data, pa.binary()), (word, pa.int64()), (count, pa.int64()), (tokens, pa.int64()), (known, pa.int64())]
    return pa.Table.from_arrays([pa.array(none if c is None else c, t) for c, t in columns], names=[x.split()[0] for x in _NOTE.split(", ")])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse; only the distinct hashes are sorted."""
    coded = pa.array(h).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[coded.indices.to_numpy()]


def _own(table: pa.Table, buckets: int):
    """A chunk's tokens, their distinct hashes in order of buckets, and the bucket of each."""
    h, at = _tokens(table.column("text"))
    distinct, which = _distinct(h)
    return h, at, distinct, which, ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        h, at, distinct, which, bucket = _own(table, buckets)
        learn = ~np.array(table.column("held_out").to_pylist(), bool)
        count = np.bincount(which, weights=np.repeat(learn, np.diff(at)), minlength=len(distinct)).astype(np.uint64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        data = [distinct[cuts[b] : cuts[b + 1]].tobytes() + zlib.compress(count[cuts[b] : cuts[b + 1]].tobytes(), 1) for b in full]
        sizes = [int(cuts[b + 1] - cuts[b]) for b in full]
        return _note([table.column("chunk")[0].as_py()] * len(full), full.tolist(), data, count=sizes)

    return send


def _sum(top: int):
    def summed(table: pa.Table) -> pa.Table:
        data, sizes = table.column("data").to_pylist(), table.column("count").to_pylist()
        h = np.concatenate([np.frombuffer(d, np.uint64, n) for d, n in zip(data, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(zlib.decompress(d[8 * n :]), np.uint64) for d, n in zip(data, sizes, strict=True)])
        distinct, which = _distinct(h)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, which, count)
        answer, at = total[which], np.cumsum([0, *sizes])
        bucket = table.column("bucket").to_pylist()
        back = _note(table.column("chunk").to_pylist(), bucket, [zlib.compress(answer[i:j].tobytes(), 1) for i, j in zip(at[:-1], at[1:], strict=True)])
        word = (distinct != END_HASH) & (total > 0)
        best = np.flatnonzero(word)[np.argsort(-total[word].astype(np.int64), kind="stable")[:top]]
        first = _note([None] * len(best), [bucket[0]] * len(best), word=distinct[best].view(np.int64), count=total[best].astype(np.int64))
        sums = _note([None], bucket[:1], tokens=[int(total.sum())], known=[int((total > 0).sum())])
        return pa.concat_tables([back, first, sums])

    return summed


def _mean(table: pa.Table) -> pa.Table:
    """A block of parameters, averaged over tasks by their tokens."""
    n, total = table.column("tokens").to_numpy(), 0.0
    for data, k in zip(table.column("data").to_pylist(), n, strict=True):
        total = total + np.frombuffer(data, np.float32).astype(np.float64) * k
    return pa.table({"block": table.column("block")[:1], "data": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def _train(docs: DataFrame, corpus: Corpus, hidden: int, rounds: int) -> Gru:
    model = Gru(len(corpus.words) + 2, hidden)
    model.start_from(corpus.counts)
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((corpus, model.flat))

        def trained(batches, sent=sent):
            known, start = sent.value
            streams = []
            for part in pieces(batches):
                h, _ = _tokens(part.column("text"))
                streams.append(known.ids(h).astype(np.int32))
            own = Gru(len(known.words) + 2, hidden)
            own.flat[:] = start
            stream = np.concatenate(streams) if streams else np.zeros(0, np.int32)
            n = own.train(stream.astype(np.int64))
            if n:
                blocks = [own.flat[i : i + BLOCK].tobytes() for i in range(0, len(own.flat), BLOCK)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.arange(len(blocks), dtype=np.int32)), "data": pa.array(blocks, pa.binary()), "tokens": pa.array(np.full(len(blocks), n, np.int64))})

        mine = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn)).select("text")
        got = mine.mapInArrow(trained, "block int, data binary, tokens long").groupBy("block").applyInArrow(_mean, "block int, data binary").toArrow()
        for block, data in zip(got.column("block").to_pylist(), got.column("data").to_pylist(), strict=True):
            model.flat[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.float32)
    return model


def _network_words(count: np.ndarray, tokens: int, words: int | None) -> int:
    """How many of the words with these falling counts the network knows."""
    if words is not None:
        return min(words, len(count))
    return min(max(int(np.searchsorted(np.cumsum(count), SHARE * tokens)) + 1, LEAST), len(count), MOST)


def score_texts(docs: DataFrame, *, words: int | None = None, hidden: int = 16, rounds: int = 2, chunks: int | None = None) -> DataFrame:
    """The columns of ``_SCORES`` for every row of docs."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "language-model")
    docs = named(docs, "doc_id", "text")
    if chunks is None:
        chunks = max(4, -(-total_bytes(docs) // CHUNK_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    by_chunk = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text", "held_out").groupBy("chunk")
    by_chunk.applyInArrow(_send(chunks), _NOTE).groupBy("bucket").applyInArrow(_sum(MOST if words is None else words), _NOTE).write.parquet(folder)
    table = spark.read.parquet(folder)
    sums = table.agg(F.sum("tokens"), F.sum("known")).head()
    tokens, distinct = sums[0] or 0, sums[1] or 0
    best = table.where("word is not null").select("word", "count").orderBy(F.desc("count"), "word").limit(MOST if words is None else words).toArrow()
    ends = docs.where("not held_out").count()
    count = best.column("count").to_numpy()
    size = _network_words(count, tokens - ends, words)
    count = count[:size]
    others = int(tokens - ends - count.sum())
    corpus = Corpus(tokens, distinct, best.column("word").to_numpy()[:size].view(np.uint64), others, distinct - size - (ends > 0), np.append([others, ends], count))
    model = _train(docs, corpus, hidden, rounds)
    sent = spark.sparkContext.broadcast((corpus, model.flat))

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        known, parameters = sent.value
        h, at, distinct, which, _ = _own(table, chunks)
        order = np.argsort(answers.column("bucket").to_numpy())
        data = answers.column("data").to_pylist()
        c = np.concatenate([np.frombuffer(zlib.decompress(data[i]), np.uint64) for i in order]).astype(np.float64)
        base = np.log10((c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))
        ids = known.ids(distinct)
        other = np.where(ids == 0, np.log10((c + 0.5) / (known.other_tokens + 0.5 * (known.other_distinct + 1))), 0.0)
        add = lambda x: np.add.reduceat(x[which], at[:-1])  # noqa: E731  every text has a token
        own = Gru(len(known.words) + 2, hidden)
        own.flat[:] = parameters
        tokens = ids[which]
        logs = own.score([tokens[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]) / np.log(10)
        n = table.num_rows
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(add((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(n, known.tokens)), "base_score": pa.array(add(base)), "score": pa.array(logs + add(other))})

    return by_chunk.cogroup(table.where("chunk is not null").select("chunk", "bucket", "data").groupBy("chunk")).applyInArrow(scored, _SCORES)
