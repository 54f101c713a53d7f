"""Temperature mixing of sources, realised as budgeted block permutations.

A source with a share p of the tokens gets the weight p**a / sum of p**a. The exponent a in [0, 1] is the
largest whose weights reach ``target_entropy`` (a part of the largest possible entropy); if some source
would then be repeated more than ``max_repeats`` times, it is the smallest that keeps the limit. The
interval is cut in ``CUTS`` parts per round, each round one aggregate over the table of sources, which
never leaves the cluster.

Without a budget the mixture is as long as it must be for every document to be in it once or more, so none
is lost; with a budget of tokens, sources are cut or repeated to meet it. A budget of more than ``max_repeats`` times the corpus
cannot be met within the limit; the limit holds then, and the mixture has that many passes of every source. Every source is a sequence of
passes over its documents. Documents lie in about sqrt(n) blocks by hash; each pass puts the blocks, and the
documents in each, in a new order, and the last pass ends when the source's budget is used up (the
document that crosses it is in). Windows run over a source's blocks or a block's documents, so neither
of them holds more than about the square root of a source.

A null source is a source. Documents without tokens (null and empty texts too) weigh nothing and come with the
whole passes of their source; a source without tokens is passed once if there is no budget, else left
out. Repeated rows are separate documents. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.text import named
from rivulet.session import fresh_folder

CUTS, ROUNDS = 16, 7


def word_count(text: Column | str) -> Column:
    """Runs without ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, total: float, budget: int | None, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest repetition) of each exponent, in one pass over the sources."""
    p = F.col("tokens") / F.lit(total)
    rows = []
    for k, a in enumerate(exponents):
        rows += [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"hi{k}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"lo{k}")]
    r = shares.where("tokens > 0").agg(*rows).head()
    out = []
    for k, a in enumerate(exponents):
        z, s, hi, lo = (r[f"{n}{k}"] for n in ("z", "s", "hi", "lo"))
        out.append((math.log(z) - a * s / z, hi / lo if budget is None else hi / z * budget / total))
    return out


def fit_exponent(shares: DataFrame, *, budget: int | None = None, target_entropy: float = 0.97, max_repeats: float = 4.0) -> tuple[float, float, float]:
    """Exponent, sum of the powers, and the least repetition's power, for a table of sources (tokens)."""
    total, n = shares.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).head()
    if not n:
        return 1.0, 1.0, 1.0
    aim = target_entropy * math.log(n)

    def bisect(met, want_largest: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
            good = [met(*m) for m in _measures(shares, total, budget, grid)]
            if want_largest:  # met at the low end first
                k = max((i for i, g in enumerate(good) if g), default=0)
                low, high = grid[k], grid[min(k + 1, CUTS)]
            else:
                k = min((i for i, g in enumerate(good) if g), default=CUTS)
                low, high = grid[max(k - 1, 0)], grid[k]
        return low if want_largest else high

    a = bisect(lambda entropy, _: entropy >= aim - 1e-12, True)
    if _measures(shares, total, budget, [a])[0][1] > max_repeats * (1 + 1e-12):
        a = bisect(lambda _, repeats: repeats <= max_repeats * (1 + 1e-12), False)
    p = F.col("tokens") / F.lit(float(total))
    z, least = shares.where("tokens > 0").agg(F.sum(F.pow(p, F.lit(a))), F.min(F.pow(p, F.lit(a - 1)))).head()
    return a, z, least


def mix_sources(docs: DataFrame, *, tokens: Column | None = None, budget: int | None = None, target_entropy: float = 0.97, max_repeats: float = 4.0, seed: int = 1) -> DataFrame:
    """One row per document and pass: doc_id, source, n_tokens, pass, block, position (in the source), at (order over all sources, in [0, 1)), weight.

    ``tokens`` counts a row's tokens, by default its words. Sorted by ``at``, every stretch of the mixture holds the sources by their weights.
    """
    if tokens is None:
        rows = named(docs, "doc_id", "source", "text").select("doc_id", "source", word_count("text").alias("n_tokens"))
    else:
        rows = docs.select(F.col("doc_id"), F.col("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "mixing")
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).write.parquet(f"{folder}/sources")
    shares = spark.read.parquet(f"{folder}/sources")
    if budget is not None:
        budget = min(budget, int(max_repeats * (shares.agg(F.sum("tokens")).head()[0] or 0)))
    a, z, least = fit_exponent(shares, budget=budget, target_entropy=target_entropy, max_repeats=max_repeats)
    total = float(shares.agg(F.sum("tokens")).head()[0] or 1)
    p = F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total))
    repeats = F.pow(p, F.lit(a - 1)) / F.lit(least) if budget is None else F.pow(p, F.lit(a - 1)) / F.lit(z) * F.lit(budget / total)
    plan = shares.select(
        F.col("source").alias("of"),
        F.ceil(F.sqrt("docs")).cast("long").alias("blocks"),
        F.coalesce(F.pow(p, F.lit(a)) / F.lit(z), F.lit(0.0)).alias("weight"),
        F.coalesce(repeats, F.lit(1.0 if budget is None else 0.0)).alias("repeats"),
        "tokens",
    ).select("of", "blocks", "weight", F.floor("repeats").cast("int").alias("whole"), F.round((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).cast("long").alias("rest"))
    passes = F.col("whole") + (F.col("rest") > 0).cast("int")
    hashed = lambda *keys: F.xxhash64(F.lit(seed), *keys)
    placed = rows.join(plan, rows.source.eqNullSafe(plan.of)).where(passes > 0).select("doc_id", "source", "n_tokens", "weight", "whole", "rest", F.pmod(hashed("doc_id", "n_tokens"), F.col("blocks")).alias("block"))
    spread = lambda df: df.withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    sums = spread(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.count("*").alias("block_docs"), F.first("whole").alias("whole"), F.first("rest").alias("rest")))
    earlier = Window.partitionBy("source", "pass").orderBy(hashed("pass", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "block", "pass", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("block_docs").over(earlier), F.lit(0)).alias("docs_before"))
    starts = starts.select(*(F.col(c).alias(f"b_{c}") for c in starts.columns))
    each = spread(placed)
    # the last pass needs no documents of blocks behind its end
    each = each.join(starts, each.source.eqNullSafe(F.col("b_source")) & (each.block == F.col("b_block")) & (each["pass"] == F.col("b_pass"))).where((F.col("pass") <= F.col("whole")) | (F.col("b_tokens_before") < F.col("rest")))
    inner = Window.partitionBy("source", "block", "pass").orderBy(hashed("pass", "doc_id", "n_tokens"), "doc_id", "n_tokens")
    before = F.col("b_tokens_before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    chosen = each.withColumn("before", before).withColumn("place", F.col("b_docs_before") + F.row_number().over(inner) - 1).where((F.col("pass") <= F.col("whole")) | (F.col("before") < F.col("rest")))
    sizes = shares.select(F.col("source").alias("s_source"), F.col("docs"), F.col("tokens").alias("s_tokens"))
    length = F.col("whole") * F.col("s_tokens") + F.col("rest")
    done = (F.col("pass") - 1) * F.col("s_tokens") + F.col("before")
    return chosen.join(sizes, chosen.source.eqNullSafe(sizes.s_source)).select(
        "doc_id", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), F.col("block").cast("long").alias("block"), ((F.col("pass") - 1) * F.col("docs") + F.col("place")).cast("long").alias("position"), F.coalesce(done / F.nullif(length, F.lit(0)), F.lit(0.0)).alias("at"), "weight"
    )
