"""Near-duplicates by an inverted join on the coordinates of MinHash signatures.

Documents with equal shingle sets are one class (a 64-bit hash of the set), and only classes go on, so groups
of copies cost no more than one document. A class posts itself under each (coordinate, value) of
its signature of ``COORDINATES`` minima. Pairs of a similarity of 0.8 agree in about 51 of 64; pairs that
agree in ``MATCHES`` or more are compared on their full sets (a pair at the limit is missed with a
probability of about 1e-7). To find them without counting all collisions:

* rarity: postings are counted over all classes in a table of ``CELLS`` hashed cells, 4 MB whatever the input, that all
  tasks get; a cell's count is never below that of its postings, and any order that all classes share will do;
* skip: a posting alone in its cell counts for nothing, and a class with fewer than ``MATCHES`` others is done;
* prefix: of two classes that agree in ``MATCHES`` coordinates, the ``COORDINATES - MATCHES + 1`` rarest postings of
  both hold a common one, so only those are shuffled and joined.

Three steps find the links, none of which writes or gathers the pairs of a group:

* families: in the lists of the prefixes, collisions are counted on the low four bits of every coordinate, 32 bytes a class, which
  never counts too few. Of the pairs that agree, a task sends on only the edges of a spanning forest, and their
  components are the families: every pair that may be a link lies within one. Lists are cut into blocks of about ``BLOCK``
  classes; each block meets itself and the smallest class of its list, and only lists that still hold several
  families have their blocks compared with one another.
* links: the shingle sets of the classes of a family are sent once to its block of at most ``BLOCK`` classes or ``BLOCK_SHINGLES``
  shingles. There all intersections are counted exactly (frequent shingles by a product of 0/1 matrices, rare ones by
  their pairs), and again only a spanning forest of the links goes out. The smallest class of a family is sent to all its blocks.
* Families that lie in several blocks and hold several components have their blocks compared pair by pair, without the pairs
  of one component.

So large groups of near copies cost as much as their classes, and only groups whose members do not link with one another are compared
pair by pair, inside tasks. No list is capped, and no link between components is lost.

A null or empty text has no words, an empty set, and no links; a text of fewer words than a shingle is one
shingle. Rows are kept as they are: repeated rows are copies. A null doc_id is never the smallest of
its component unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.components import components
from rivulet.llm.text import LOWER, flat, grams, mix, named, pieces, ranges, whole, word_hash, words
from rivulet.session import fresh_folder

COORDINATES, MATCHES, BLOCK, BITS, CELLS = 64, 34, 512, 1 << 26, 1 << 20
BLOCK_SHINGLES, FREQUENT = 1 << 20, 12
_SPREAD, _NIBBLES, _PAIRS = 2654435769, np.uint64(0x1111111111111111), 1 << 19
_MEMBER = "node long, size long, low array<long>"
_SEEDS = np.random.default_rng(20230915).integers(1, 2**63, (COORDINATES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, in order."""
    start, end, row = words(buf, offsets)
    h = word_hash(buf, start, end)
    inside = whole(row, n)
    key, of = grams(h, row, n)[inside], row[: len(inside)][inside]
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = grams(h[first[i] : first[i] + count[i]], row, int(count[i]))
        key, of = np.append(key, mix(own + np.uint64(count[i]))), np.append(of, i)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return of[fresh], key[fresh]


def _class_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def row_key(docs: DataFrame) -> DataFrame:
    """docs with key, a digest of id and text: rows of equal keys are copies of one row."""
    return docs.withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)))


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """key, doc_id, n_shingles, node (class, null without words), signature of every row."""

    def sketched(batches):
        for part in pieces(batches, size=1 << 20):
            buf, offsets = flat(part.column("text"))
            row, key = shingles(LOWER[buf], offsets, n)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            full = np.flatnonzero(np.diff(cut))
            minima = np.zeros((part.num_rows, COORDINATES), np.uint32)
            for k in range(COORDINATES if len(full) else 0):
                values = ((key * _SEEDS[k, 0] + _SEEDS[k, 1]) >> np.uint64(32)).astype(np.uint32)
                minima[full, k] = np.minimum.reduceat(values, cut[full])
            nodes = [_class_of(key[i:j]) if i < j else None for i, j in zip(cut[:-1], cut[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * COORDINATES, pa.int32()), pa.array(minima.view(np.int32).ravel()))
            yield pa.RecordBatch.from_pydict({"key": part.column("key").combine_chunks(), "doc_id": part.column("doc_id").combine_chunks().cast(pa.int64()), "n_shingles": pa.array(np.diff(cut), pa.int64()), "node": pa.array(nodes, pa.int64()), "signature": lists})

    return docs.mapInArrow(sketched, "key binary, doc_id long, n_shingles long, node long, signature array<int>")


def _of_keys(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, ...) with the text of its row.

    A bit map of ``BITS`` bits of the keys' hashes, 8 MB whatever their number, goes to all tasks first, so that few other
    texts are shuffled for the join that decides; of copies of a row, a batch sends one.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(BITS))
    filled = wanted.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits"))
    bits = np.zeros(BITS // 64, np.int64)
    for batch in filled.toArrow().to_batches():  # at most BITS / 64 rows
        bits[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def passed(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = np.flatnonzero((sent.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1))
            keys = batch.column("key").to_pylist()
            once = list({keys[i]: i for i in hit.tolist()}.values())
            yield batch.select(["key", "text"]).take(pa.array(once, pa.int64()))

    some = docs.select("key", "text", place.alias("place")).mapInArrow(passed, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))
    return some.join(wanted, "key")


def forest(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most size edges (place, smallest place of its component) that join the same places as the edges (x, y)."""
    label = np.arange(size)
    while len(x):
        of_x, of_y = label[x], label[y]
        low = np.minimum(of_x, of_y)
        np.minimum.at(label, of_x, low)
        np.minimum.at(label, of_y, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    at = np.flatnonzero(label != np.arange(size))
    return at, label[at]


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members any two of the sets share, exactly."""
    k = len(sets)
    keys, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    times = np.diff(np.append(first, len(keys)))
    out = np.zeros((k, k), np.float32)  # exact: no count reaches 2^24
    rare = np.flatnonzero((times > 1) & (times <= FREQUENT))
    for i in range(0, len(rare), 1 << 13):
        own = rare[i : i + (1 << 13)]
        place = ranges(first[own], times[own])
        behind = np.repeat(first[own] + times[own], times[own]) - place - 1
        code = np.repeat(owner[place], behind) * k + owner[ranges(place + 1, behind)]
        at, n = np.unique(code, return_counts=True)
        out.ravel()[at] += n
    often = np.flatnonzero(times > FREQUENT)
    out += out.T
    for i in range(0, len(often), 2048):
        own = often[i : i + 2048]
        dense = np.zeros((k, len(own)), np.float32)
        dense[owner[ranges(first[own], times[own])], np.repeat(np.arange(len(own)), times[own])] = 1
        out += dense @ dense.T
    return out


def _linked(sets: list[np.ndarray], percent: int, open_pair: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets; open_pair: which pairs count."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        one = int(100 * common >= percent * (size.sum() - common))
        return np.ones(one, int), np.zeros(one, int)
    common = common_counts(sets).astype(np.int64)
    good = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if open_pair is not None:
        good &= open_pair
    return forest(*np.nonzero(np.triu(good, 1)), len(sets))


def _in_blocks(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links found in the blocks of rows of text, node, root, family, p, q, own (the block of the row; -1: meets all)."""

    def listed(batches):
        for part in pieces(batches, size=1 << 20):
            buf, offsets = flat(part.column("text"))
            row, key = shingles(LOWER[buf], offsets, n)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            sets = [key[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            table = part.drop_columns(["text"]).append_column("members", pa.array(sets, pa.binary()))
            yield from table.combine_chunks().to_batches()

    def met(batches):
        held: list[tuple] = []

        def done():
            nodes, roots, own = (np.array([h[i] for h in held]) for i in (1, 2, 3))
            sets = [np.frombuffer(h[4], np.uint64) for h in held]
            two = own[:, None] != own[None, :]
            pair = None if held[0][0][1] == held[0][0][2] else two & (roots[:, None] != roots[None, :])
            x, y = _linked(sets, percent, pair) if pair is None or pair.any() else (np.zeros(0, int), np.zeros(0, int))
            return _pairs(nodes[x], nodes[y])

        for part in pieces(batches, "members", size=4 << 20):
            columns = [part.column(c).to_pylist() for c in ("family", "p", "q", "node", "root", "own", "members")]
            for family, p, q, *rest in zip(*columns, strict=True):
                if held and held[0][0] != (family, p, q):
                    if len(held) > 1:
                        yield done()
                    held = []
                held.append(((family, p, q), *rest))
        if len(held) > 1:
            yield done()

    kind = "node long, root long, family long, own int, p int, q int"
    sets = texts.select("text", "node", "root", "family", "own", "p", "q").mapInArrow(listed, f"{kind}, members binary")
    return sets.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(met, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """node, first (smallest doc_id), key (of one row), size, signature of every class of rows."""
    return rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.min("n_shingles").alias("size"), F.any_value("signature").alias("signature"))


def _rooted(docs: DataFrame, words_per_shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, n_shingles, node) of docs and classes (node, first, root)."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "near-dup")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    docs = row_key(named(docs, "doc_id", "text"))
    rows = written(sketch(docs, words_per_shingle), "rows")
    classes = written(_classes(rows), "classes")
    family = _families(written(_shared_heads(classes), "heads"), percent, written)
    dealt = written(_dealt(classes, family), "dealt")
    alone = dealt.withColumn("root", F.col("node")).withColumn("hub", F.col("node") == F.col("least"))
    alone = alone.withColumn("p", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))).withColumn("q", F.col("p"))
    links = written(_in_blocks(_of_keys(docs, alone), words_per_shingle, percent), "links")
    root = components(links)
    wide = dealt.where("blocks > 1").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = wide.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("family")
    wide = written(wide.join(mixed, "family"), "wide")
    if wide.limit(1).count():
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != own")
        wide = wide.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
        more = written(_in_blocks(_of_keys(docs, wide), words_per_shingle, percent), "more")
        root = components(links.union(more))
    return rows.drop("signature"), classes.select("node", "first").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _dealt(classes: DataFrame, family: DataFrame) -> DataFrame:
    """key, node, family, blocks, own (block), least (node of the family): where the classes of families meet."""
    members = family.join(classes.select("node", "key", "size"), "node")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("node").alias("least"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sizes.select("family", "least", blocks.alias("blocks")), "family")
    return placed.select("key", "node", "family", "blocks", "least", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))


def link_components(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows, classes = _rooted(docs, words_per_shingle, percent)
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = classes.join(smallest, "root").select("node", "component_id")
    out = rows.join(ids, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _cell_counts(classes: DataFrame) -> np.ndarray:
    """How many postings of all classes fall into each of the ``CELLS`` cells."""
    posts = classes.select(F.posexplode("signature").alias("at", "value"))
    cell = F.pmod(F.col("value").cast("long") + F.col("at").cast("long") * F.lit(_SPREAD), F.lit(CELLS)).cast("int")
    counts = np.zeros(CELLS, np.int64)
    for batch in posts.groupBy(cell.alias("cell")).count().toArrow().to_batches():  # at most CELLS rows
        counts[batch.column("cell").to_numpy()] = batch.column("count").to_numpy()
    return counts


def _shared_heads(classes: DataFrame) -> DataFrame:
    """post, blocks (of its list), hub (its smallest node), node, size, low of the prefix postings that two or more classes have in their prefixes.

    A link between different sets needs four common shingles, so smaller classes post nothing.
    """
    classes = classes.where("size >= 4").select("node", "size", "signature")
    sent = classes.sparkSession.sparkContext.broadcast(_cell_counts(classes))

    def posted(batches):
        at = np.arange(COORDINATES, dtype=np.uint64)
        for batch in batches:
            value = _signatures(batch)
            count = sent.value[((value + at * np.uint64(_SPREAD)) & np.uint64(CELLS - 1)).astype(np.int64)]
            count[count < 2] = 1 << 62
            shared = (count < 1 << 62).sum(1)
            post = value | (at << np.uint64(32))
            order = np.lexsort((post, count), axis=1)
            take = np.arange(COORDINATES)[None, :] < (shared - MATCHES + 1)[:, None]
            node = np.repeat(batch.column("node").to_numpy(), take.sum(1))
            yield pa.RecordBatch.from_pydict({"post": pa.array(np.take_along_axis(post, order, 1)[take].view(np.int64)), "node": pa.array(node, pa.int64())})

    def packed(batches):
        for batch in batches:
            value = _signatures(batch) & np.uint64(15)
            low = np.bitwise_or.reduce(value.reshape(-1, COORDINATES // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1) * (COORDINATES // 16), pa.int32()), pa.array(low.view(np.int64).ravel()))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "size": batch.column("size"), "low": lists})

    heads = classes.select("node", "signature").mapInArrow(posted, "post long, node long")
    lists = heads.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1").select("post", "hub", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return heads.join(lists, "post").join(classes.mapInArrow(packed, _MEMBER), "node").select("post", "blocks", "hub", "node", "size", "low")


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("signature").flatten().to_numpy().view(np.uint32).reshape(-1, COORDINATES).astype(np.uint64)


def _families(heads: DataFrame, percent: int, written) -> DataFrame:
    """node, family (its smallest node) of every class that agrees with another."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    heads = heads.withColumn("own", own)
    first = heads.withColumn("label", F.col("node")).withColumn("p", F.explode(F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))).withColumn("q", F.col("p"))
    edges = written(_agreeing(first, percent), "agreeing")
    family = components(edges)
    wide = heads.where("blocks > 1").join(family.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = wide.groupBy("post").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("post")
    wide = written(wide.join(mixed, "post").select("post", "blocks", "own", "node", "size", "low", "label"), "wide-heads")
    if wide.limit(1).count():
        wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != own")
        wide = wide.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
        family = components(edges.union(written(_agreeing(wide, percent), "agreeing-wide")))
    return family.select("node", F.col("root").alias("family"))


def _agreeing(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests of the pairs of classes of different labels that meet in a list's blocks p and q, agree in ``MATCHES`` coordinates and fit in size."""
    member = F.struct("node", "size", "label", "own", *(F.col("low")[i].alias(f"low{i}") for i in range(COORDINATES // 16)))
    groups = heads.groupBy("post", "p", "q").agg(F.collect_list(member).alias("members"))

    def met(batches):
        for batch in batches:
            lists = batch.column("members")
            size = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(size)), size)
            flat_members = lists.flatten()
            column = {name: flat_members.field(name).to_numpy() for name in ("node", "size", "label", "own", *(f"low{i}" for i in range(COORDINATES // 16)))}
            order = np.lexsort((column["node"], of))  # so that a list's smallest class is the root of its trees, and lists send the same edges
            column = {name: values[order] for name, values in column.items()}
            low = np.stack([column[f"low{i}"].view(np.uint64) for i in range(COORDINATES // 16)], axis=1)
            node, alone = column["node"], (batch.column("p").to_numpy() == batch.column("q").to_numpy())[of]
            behind = np.repeat(np.cumsum(size), size) - np.arange(len(of)) - 1  # members after this one in its list
            upto, i = np.cumsum(behind), 0
            while i < len(of):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, "right")))
                x = np.repeat(np.arange(i, j), behind[i:j])
                y = ranges(np.arange(i, j) + 1, behind[i:j])
                i = j
                fits = 100 * np.minimum(column["size"][x], column["size"][y]) >= percent * np.maximum(column["size"][x], column["size"][y])
                good = fits & (column["label"][x] != column["label"][y]) & (alone[x] | (column["own"][x] != column["own"][y]))
                x, y = x[good], y[good]
                apart = np.zeros(len(x), np.int64)
                for k in range(low.shape[1]):
                    bits = low[x, k] ^ low[y, k]
                    bits |= bits >> np.uint64(1)
                    bits |= bits >> np.uint64(2)
                    apart += np.bitwise_count(bits & _NIBBLES)
                good = apart <= COORDINATES - MATCHES
                places, at = np.unique(np.concatenate([x[good], y[good]]), return_inverse=True)
                x, y = (places[k] for k in forest(*np.split(at, 2), len(places)))
                a, b = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
                once = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
                yield _pairs(once[:, 0], once[:, 1])

    return groups.select("p", "q", "members").mapInArrow(met, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def keep_first(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null after all others), of equal ids that of the smallest key.

    Rows without words are in no component and all stay; of repeated rows one stays.
    """
    rows, classes = _rooted(docs, words_per_shingle, percent)
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    kept = rows.join(classes.select("node", "root"), "node").groupBy("root").agg(F.min(best).alias("best")).select("best.key")
    given = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*given).alias("row"), F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    once = row_key(packed.where(worded)).groupBy("key").agg(F.first("row").alias("row"))
    return packed.where(~worded).select("row.*").unionByName(once.join(kept, "key", "left_semi").select("row.*"))
