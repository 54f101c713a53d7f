"""How far the sources of a language lie apart in their words, by smoothed term shares and exact integers.

1. *Collapse.* Identical texts of a language are one group, known by the sha256 of the text. How often each source has
   a text is counted on digests alone; the text itself is shuffled once, after a map-side combine, so a text
   that fills a third of the table is a row a task. The list of a text's sources is no longer than the list of the language's sources,
   whose square is what the audit returns.
2. *Tokenise once.* Each distinct text is cut into terms once and counted with its multiplicities: a term gets
   occurrences times copies for every source, and copies as its document frequency.
3. *Keep* the terms in at least ``least`` documents of their language.
4. *Pairs, sparsely.* A share is ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, and an absent term has the same
   share ``p0`` all over a group. The distance of two groups over all V terms is therefore

       (V - |a| - |b|) * |p0a - p0b| + H(a, p0b) + H(b, p0a) + X(a, b)

   where H(a, x) sums ``|p - x|`` over the terms of a, from a histogram of the few different shares, and X corrects for the
   terms that both hold: ``|pa - pb| - |pa - p0b| - |pb - p0a| + |p0a - p0b|``. X is summed in blocks of terms, which hold all
   sources of a term but only a bounded number of terms, with at most ``_PAIRS`` pairs in memory at a time.

Shares are at most SCALE + 1, sums of them at most 2 * (SCALE + V), so they fit longs; the products before the division are
decimals. Tables of one row a group are broadcast if there are at most ``FEW`` groups, else joined by shuffles.

A null text, lang or source is read as ''. Groups without terms take part with p0. A language without kept terms has distance 0
between its sources. Repeated rows are documents of their own. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.text import LOWER, flat, named, pieces, ranges, words
from rivulet.session import fresh_folder

SCALE, PRIOR, FEW, BLOCK = 1_000_000_000, 5, 100_000, 50_000
GAP = np.ones(256, bool)
GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_PAIRS = 1 << 19
_GROUP = ["lang", "source"]


def collapse(docs: DataFrame) -> DataFrame:
    """lang, text, sources (array of source and n copies): one row per distinct text of a language."""
    docs = named(docs, "lang", "source", "text").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    keyed = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    of_text = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = keyed.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(of_text, ["lang", "digest"]).select("lang", "text", "sources")


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it) from rows of ``collapse``; partial sums, several rows a term.

    A text of only gaps gives no rows; its group is known from the documents.
    """

    def counted(batches):
        for part in pieces(batches, size=4 << 20):
            buf, offsets = flat(part.column("text"))
            lower = LOWER[buf]
            start, end, row = words(lower, offsets, GAP)
            if not len(start):
                continue
            data = lower.tobytes()
            number: dict[bytes, int] = {}
            term = np.fromiter((number.setdefault(data[s:e], len(number)) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
            pair, times = np.unique(row.astype(np.int64) * len(number) + term, return_counts=True)
            of_text, term = pair // len(number), pair % len(number)
            groups: dict[tuple[str, str], int] = {}
            lists = part.column("sources").to_pylist()
            langs = part.column("lang").to_pylist()
            own = [np.array([(groups.setdefault((lang, s["source"]), len(groups)), s["n"]) for s in sources], np.int64).reshape(-1, 2) for lang, sources in zip(langs, lists, strict=True)]
            size = np.array([len(o) for o in own])
            first, flat_own = np.cumsum(size) - size, np.concatenate(own)
            at = ranges(first[of_text], size[of_text])
            repeat = np.repeat(np.arange(len(pair)), size[of_text])
            code, place = np.unique(flat_own[at, 0] * len(number) + term[repeat], return_inverse=True)
            n, docs = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            np.add.at(n, place, flat_own[at, 1] * times[repeat])
            np.add.at(docs, place, flat_own[at, 1])
            names = pa.array(list(number), pa.binary()).cast(pa.string())
            group_names = list(groups)
            group = code // len(number)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([g[0] for g in group_names], pa.string()).take(pa.array(group)),
                    "source": pa.array([g[1] for g in group_names], pa.string()).take(pa.array(group)),
                    "term": names.take(pa.array(code % len(number))),
                    "n": pa.array(n),
                    "docs": pa.array(docs),
                }
            )

    return texts.select("lang", "text", "sources").mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in parts of SCALE; null without kept terms."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(PRIOR))
    parts = total.cast("decimal(19,0)") + F.lit(PRIOR) * terms.cast("decimal(18,0)")
    return F.when(terms > 0, F.call_function("div", whole, parts) + 1)


def _small(groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(groups) if few else groups


def audit(docs: DataFrame, *, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to every other source of the language, and the terms a source overuses most."""
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "divergence")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    counts = term_counts(collapse(docs)).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least).select("lang", "term", "lang_n")
    kept = written(kept, "kept")
    held = written(counts.drop("docs").join(kept, ["lang", "term"]), "held")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    present = named(docs, *_GROUP).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _GROUP)).distinct()
    totals = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_terms"))
    groups = present.join(totals, _GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(*_GROUP, *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "distinct_terms", "terms", "lang_total")))
    groups = written(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    few = groups.limit(FEW + 1).count() <= FEW

    shares = held.join(_small(groups, few), _GROUP).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    shares = written(shares.select(*_GROUP, "term", "p", "q", "p0"), "shares")
    over = shares.where("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(over).where(F.col("rank") <= top).unionByName(_ranked(_distances(shares, groups, few)))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select(*_GROUP, "part", "item", "value", "rank")


def _distances(shares: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """lang, source, part, item (another source of lang), value: both directions of every pair."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"), F.col("distinct_terms").alias("other_terms"))
    pairs = groups.join(_small(other, few), "lang").where(F.col("source") != F.col("item"))
    # H(a, x): the sum of p - x over all terms, and twice the shortfall where p < x.
    histogram = shares.groupBy(*_GROUP, "p").agg(F.count(F.lit(1)).alias("m"))
    sums = histogram.groupBy(*_GROUP).agg(F.sum(F.col("p") * F.col("m")).alias("sum_p"))
    short = histogram.join(_small(other, few), "lang").where((F.col("source") != F.col("item")) & (F.col("p") < F.col("other_p0")))
    short = short.groupBy(*_GROUP, "item").agg(F.sum((F.col("other_p0") - F.col("p")) * F.col("m")).alias("shortfall"))
    reach = (
        pairs.join(sums, _GROUP, "left")
        .join(short, [*_GROUP, "item"], "left")
        .withColumn("h", F.coalesce("sum_p", F.lit(0)) - F.col("distinct_terms") * F.coalesce("other_p0", F.lit(0)) + 2 * F.coalesce("shortfall", F.lit(0)))
    )
    back = reach.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("h").alias("back_h"))
    common = _common(shares).groupBy(*_GROUP, "item").agg(F.sum("x").alias("x"))
    apart = (F.col("terms") - F.col("distinct_terms") - F.col("other_terms")) * F.abs(F.col("p0") - F.col("other_p0"))
    value = F.when(F.col("terms") > 0, apart + F.col("h") + F.col("back_h") + F.coalesce("x", F.lit(0))).otherwise(F.lit(0))
    return reach.join(back, [*_GROUP, "item"]).join(common, [*_GROUP, "item"], "left").select(*_GROUP, F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def _common(shares: DataFrame) -> DataFrame:
    """lang, source, item, x: partial sums over the terms that both sources hold, in both directions."""
    blocks = max(1, -(-shares.count() // BLOCK))
    # A third key spreads the terms of one language; all rows of a term meet in its block.
    dealt = shares.select("lang", "source", "term", "p", "p0", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).alias("block"))

    def met(table: pa.Table) -> pa.Table:
        names = table.column("source").combine_chunks().dictionary_encode()
        source = names.indices.to_numpy().astype(np.int64)
        term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        p, p0 = table.column("p").to_numpy(), table.column("p0").to_numpy()
        order = np.argsort(term, kind="stable")
        source, term, p, p0 = source[order], term[order], p[order], p0[order]
        last = np.searchsorted(term, term, "right")
        behind = last - np.arange(len(term)) - 1
        upto, i, width = np.cumsum(behind), 0, len(names.dictionary)
        codes, sums = [], []
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, "right")))
            a, b = np.repeat(np.arange(i, j), behind[i:j]), ranges(np.arange(i, j) + 1, behind[i:j])
            i = j
            x = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p[b] - p0[a]) + np.abs(p0[a] - p0[b])
            code, at = np.unique(source[a] * width + source[b], return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, at, x)
            codes.append(code)
            sums.append(total)
        code, total = np.concatenate(codes), np.concatenate(sums)
        lang = pa.array([table.column("lang")[0].as_py()] * len(code), pa.string())
        first, second = (names.dictionary.take(pa.array(c)) for c in (code // max(width, 1), code % max(width, 1)))
        out = {"lang": lang, "source": first, "item": second, "x": pa.array(total)}
        return pa.concat_tables([pa.table(out), pa.table(out | {"source": second, "item": first})])

    return dealt.groupBy("lang", "block").applyInArrow(met, "lang string, source string, item string, x long")
