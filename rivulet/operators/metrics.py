"""Counters, gauges and cumulative histograms over logs, and their exposition text.

Every metric is one grouped aggregate, combined on the map side before the shuffle, so a label set
that takes most of the log is no burden.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.labels import braces, label_pairs, number_text

# Upper bounds of the request-duration buckets, in milliseconds.
DURATION_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def counter(log: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """Sum per label set, counting one per row unless an amount is given."""
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return log.groupBy(*labels).agg(total.alias("value"))


def gauge(log: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value set per label set."""
    return log.groupBy(*labels).agg(F.max_by(F.col(value), F.struct(*order)).alias("value"))


def histogram(log: DataFrame, labels: list[str], value: str, bounds=DURATION_BOUNDS) -> DataFrame:
    """Per label set one row per bucket: observations up to the bound, with the sum and the count.

    Counting ``value <= bound`` per bound gives the cumulative counts at once.
    """
    bounds = sorted(bounds)
    observed = F.col(value)
    wide = log.groupBy(*labels).agg(
        *[F.count_if(observed <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(bounds)],
        F.sum(observed).alias("sum"),
        F.count(F.lit(1)).alias("count"),
    )
    rows = [
        F.struct(F.lit(i).alias("bucket_no"), F.lit(str(b)).alias("le"), F.col(f"_le{i}").alias("bucket"))
        for i, b in enumerate(bounds)
    ]
    rows.append(
        F.struct(F.lit(len(bounds)).alias("bucket_no"), F.lit("+Inf").alias("le"), F.col("count").alias("bucket"))
    )
    return wide.select(*labels, "sum", "count", F.inline(F.array(*rows)))


def summary(log: DataFrame, labels: list[str], value: str, order: list[str], bounds=DURATION_BOUNDS) -> DataFrame:
    """What a part of a log adds to the counters, gauges and histograms of its label sets, in one pass.

    Summaries of parts merge to that of the whole, so a metric is kept by adding each drain's summary to the stored one.
    """
    observed = F.col(value)
    return log.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(observed).alias("sum"),
        *[F.count_if(observed <= F.lit(b)).alias(f"le_{i}") for i, b in enumerate(sorted(bounds))],
        F.max(F.struct(*order, observed.alias("value"))).alias("last"),
    )


def merge(labels: list[str], *summaries: DataFrame) -> DataFrame:
    """The summary of all the parts together; the last value is that of the highest order, wherever it was."""
    both = reduce(DataFrame.unionByName, summaries)
    kinds = dict(both.dtypes)
    added = [F.sum(c).cast(kinds[c]).alias(c) for c in both.columns if c not in (*labels, "last")]
    return both.groupBy(*labels).agg(*added, F.max("last").alias("last"))


def counter_of(merged: DataFrame, labels: list[str]) -> DataFrame:
    return merged.select(*labels, F.col("count").alias("value"))


def gauge_of(merged: DataFrame, labels: list[str]) -> DataFrame:
    return merged.select(*labels, "last.value")


def histogram_of(merged: DataFrame, labels: list[str], bounds=DURATION_BOUNDS) -> DataFrame:
    """The rows of ``histogram`` from a summary."""
    rows = [F.struct(F.lit(i).alias("bucket_no"), F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("bucket")) for i, b in enumerate(sorted(bounds))]
    rows.append(F.struct(F.lit(len(rows)).alias("bucket_no"), F.lit("+Inf").alias("le"), F.col("count").alias("bucket")))
    return merged.select(*labels, "sum", "count", F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Metric:
    """A named metric with its samples: ``value`` per label set, or the rows of a histogram."""

    name: str
    help: str
    kind: str
    samples: DataFrame
    labels: list[str] = field(default_factory=list)
    bounds: tuple = DURATION_BOUNDS

    @property
    def sample_name(self) -> str:
        if self.kind == "counter" and not self.name.endswith("_total"):
            return f"{self.name}_total"
        return self.name


def _header(metric: Metric) -> list[str]:
    return [f"# HELP {metric.name} {metric.help}", f"# TYPE {metric.name} {metric.kind}"]


def _zeros(metric: Metric) -> list[str]:
    """The samples of a metric that has none."""
    if metric.kind != "histogram":
        return [f"{metric.sample_name} 0"]
    buckets = [f'{metric.name}_bucket{{le="{b}"}} 0' for b in (*sorted(metric.bounds), "+Inf")]
    return [*buckets, f"{metric.name}_sum 0", f"{metric.name}_count 0"]


def _lines(metric: Metric) -> DataFrame:
    pairs = label_pairs(metric.labels)
    if metric.kind != "histogram":
        line = F.concat_ws(" ", F.concat(F.lit(metric.sample_name), braces(pairs)), number_text(F.col("value")))
        return metric.samples.select(pairs.alias("label_text"), F.lit(100).alias("line_no"), line.alias("line"))
    own = F.concat_ws(",", F.when(pairs != "", pairs), F.concat(F.lit('le="'), F.col("le"), F.lit('"')))
    bucket = F.concat(F.lit(f"{metric.name}_bucket"), braces(own), F.lit(" "), F.col("bucket").cast("string"))
    ends = [
        F.concat(F.lit(f"{metric.name}_{part}"), braces(pairs), F.lit(" "), number_text(F.col(part)))
        for part in ("sum", "count")
    ]
    lines = F.when(
        F.col("le") == "+Inf",
        F.array(
            F.struct((F.col("bucket_no") + 100).alias("line_no"), bucket.alias("line")),
            *[F.struct((F.col("bucket_no") + 101 + i).alias("line_no"), e.alias("line")) for i, e in enumerate(ends)],
        ),
    ).otherwise(F.array(F.struct((F.col("bucket_no") + 100).alias("line_no"), bucket.alias("line"))))
    return metric.samples.select(pairs.alias("label_text"), F.inline(lines))


def exposition(metrics: list[Metric]) -> DataFrame:
    """Lines of all metrics with their place: metric, label set, line inside it.

    Samples are computed once: their lines meet the table of declared metrics, one row each, where a metric that
    finds none gets its zeros.
    """
    lines = reduce(DataFrame.unionByName, [_lines(m).withColumn("metric_no", F.lit(i)) for i, m in enumerate(metrics)])
    rows = [(i, _header(m), _zeros(m)) for i, m in enumerate(metrics)]
    declared = lines.sparkSession.createDataFrame(rows, "metric_no int, header array<string>, zeros array<string>")
    head = declared.select("metric_no", F.lit("").alias("label_text"), F.posexplode("header").alias("line_no", "line"))
    none = F.transform("zeros", lambda text, i: F.struct((i + 2).alias("line_no"), text.alias("line")))
    own = F.array(F.struct("line_no", "line"))
    samples = declared.join(lines, "metric_no", "left").select("metric_no", F.coalesce("label_text", F.lit("")).alias("label_text"), F.inline(F.when(F.col("line").isNull(), none).otherwise(own)))
    return head.unionByName(samples)


def write_exposition(lines: DataFrame, path: str) -> None:
    """The text as one file; it has as many lines as there are label sets, not rows of the log."""
    (
        lines.orderBy("metric_no", "label_text", "line_no")
        .select("line")
        .coalesce(1)
        .write.mode("overwrite")
        .text(path)
    )
