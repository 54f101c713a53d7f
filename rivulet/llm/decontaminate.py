"""Benchmark decontamination with DataFrame functions alone: windows of test words found in documents.

Words are runs of lower-cased ASCII letters, digits and characters beyond ASCII. A window is ``n`` consecutive
words of an item, an item of fewer words is one window. Up to ``max_set`` distinct windows are sent to all
tasks as a hash set, in which each window of each document is looked up; the set is counted first, and a
benchmark with more windows is joined by shuffles instead, with the same result. Both compare
the windows' words themselves, so that a hit needs no further check.

A null or empty text has no words and no hits; items without words have no windows; rows with equal ids
are judged one by one; an empty benchmark or table gives no hits or no rows. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.text import named
from rivulet.session import fresh_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_SET = 50_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _window(w: Column, at: Column, n) -> Column:
    return F.array_join(F.slice(w, at, n), " ")


def _places(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))


def _looked_up(w: Column, size: int, known: list[str]) -> Column:
    at = F.filter(_places(w, size), lambda i: _window(w, i, size).isin(known))
    return F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.lit(size).alias("size"), _window(w, i, size).alias("gram")))


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """gram, size (words), item_id: the distinct windows of every item."""
    items = named(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    return items.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at")).select(_window(F.col("w"), F.col("at"), F.col("size")).alias("gram"), "size", "item_id").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, max_set: int = MAX_SET) -> DataFrame:
    """docs with row_id, n_words and hits, an array of (pos, size, gram) in order of pos, the first word being 0."""
    grams = item_windows(benchmark, n).select("gram", "size").distinct()
    known = grams.limit(max_set + 1).collect()
    keyed = docs.withColumn("row_id", F.monotonically_increasing_id()).withColumn("w", words(F.col("text")))
    kind = "array<struct<pos: int, size: int, gram: string>>"
    if len(known) <= max_set:
        found = F.array().cast(kind)
        for size in sorted({r["size"] for r in known}):
            found = F.concat(found, _looked_up(F.col("w"), size, [r["gram"] for r in known if r["size"] == size]))
        return keyed.withColumn("n_words", F.size("w").cast("long")).withColumn("hits", F.array_sort(found.cast(kind))).drop("w")
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "decontaminate")
    keyed.drop("w").write.parquet(folder)
    keyed = spark.read.parquet(folder)
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most n of them
    w = keyed.select("row_id", words(F.col("text")).alias("w"))
    every = w.select("row_id", "w", F.explode(F.array(*(F.lit(s) for s in sizes))).alias("size")).where(F.size("w") >= F.col("size"))
    every = every.select("row_id", "size", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: _window(F.col("w"), i, F.col("size")))).alias("pos", "gram"))
    found = every.join(grams, ["gram", "size"]).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "gram"))).cast(kind).alias("hits"))
    none = F.array().cast(kind)
    return keyed.join(found, "row_id", "left").withColumn("n_words", F.size(words(F.col("text"))).cast("long")).withColumn("hits", F.coalesce("hits", none))


def ranges(hits: Column, n: int) -> Column:
    """The hit words as disjoint ranges (start, stop) in order, from hits in order of pos and size; linear in the hits.

    Of the hits at one word the longest counts. A window has at most n words, so only the n - 1 such hits before one can reach it.
    """
    longest = F.filter(hits, lambda h, i: ~h["pos"].eqNullSafe(F.get(hits, i + 1)["pos"]))
    kind = "array<struct<pos: int, size: int>>"
    one = F.array(F.transform(longest, lambda h: F.struct(h["pos"], h["size"])).cast(kind))

    def piece(known: Column) -> Column:
        def own(h, i):
            before = [F.when(i >= k, F.get(known, i - k)["pos"] + F.get(known, i - k)["size"]) for k in range(1, n)]
            return F.struct(F.greatest(h["pos"], *before).alias("start"), (h["pos"] + h["size"]).alias("stop"))

        return F.filter(F.transform(known, own), lambda c: c["start"] < c["stop"])

    return F.flatten(F.transform(one, piece))  # an array of one, so that the longest hits are computed once


def n_hit(hits: Column) -> Column:
    """Words in one hit or more, in a single pass over the hits in order of pos."""
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))

    def step(done, h):
        stop = F.greatest(done["stop"], h["pos"] + h["size"])
        return F.struct(stop.alias("stop"), (done["n"] + stop - F.greatest(done["stop"], h["pos"])).cast("long").alias("n"))

    return F.aggregate(hits, start, step, lambda done: done["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, max_set: int = MAX_SET) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    hit = find_hits(named(docs, "doc_id", "text"), benchmark, n, max_set=max_set).select("row_id", "doc_id", "n_words", n_hit(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["gram"])).alias("grams"))
    items = item_windows(benchmark, n).select("gram", F.col("item_id").cast("string").alias("item"))
    rows = hit.select("row_id", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram")).join(items, "gram", "left")
    done = rows.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, max_set: int = MAX_SET) -> DataFrame:
    """docs, the hit words cut out of their texts; what stands between words stays, other texts stay as they are.

    A text is words and gaps in turn. Each range of hit words cuts it into a slice that stays and one of which only the gaps stay.
    """
    hit = find_hits(_packed(docs), benchmark, n, max_set=max_set).withColumn("cuts", ranges(F.col("hits"), n))
    parts = F.when(F.size("cuts") > 0, F.regexp_extract_all(F.col("text"), F.lit(f"({WORD}|{GAP})"), F.lit(1)))
    lead = F.when(F.regexp_like(F.col("text"), F.lit(f"^{WORD}")), F.lit(0)).otherwise(F.lit(1))
    hit = hit.withColumn("cutting", F.struct(parts.alias("parts"), lead.alias("lead")))
    part, at = F.col("cutting.parts"), lambda word: F.col("cutting.lead") + 2 * word
    between = lambda i, j: F.slice(part, i + 1, F.greatest(j - i, F.lit(0)))

    def cut(c, i):
        start = F.when(i > 0, at(F.get(F.col("cuts"), i - 1)["stop"])).otherwise(F.lit(0))
        gaps = F.filter(between(at(c["start"]), at(c["stop"])), lambda p, k: k % 2 == 1)
        return F.concat(F.array_join(between(start, at(c["start"])), ""), F.array_join(gaps, ""))

    rest = F.array_join(between(at(F.element_at("cuts", -1)["stop"]), F.size(part)), "")
    text = F.when(F.size("cuts") > 0, F.concat(F.array_join(F.transform("cuts", cut), ""), rest)).otherwise(F.col("text"))
    return hit.withColumn("cut_text", text).select(*(F.col("cut_text").alias("text") if c == "text" else F.col(f"given.`{c}`").alias(c) for c in docs.columns))


def _packed(docs: DataFrame) -> DataFrame:
    """The text of every row beside the whole row, so that no column of docs clashes with those added here."""
    return docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("given"), F.col("`text`").alias("text"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, max_set: int = MAX_SET) -> DataFrame:
    """docs without those that hold a window."""
    return find_hits(_packed(docs), benchmark, n, max_set=max_set).where(F.size("hits") == 0).select("given.*")
