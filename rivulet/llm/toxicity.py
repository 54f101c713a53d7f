"""Severity of toxicity by a cumulative-link ordinal regression on words.

P(grade <= k) = logistic(t_k - w.x): all thresholds t_1 < t_2 < ... share the weights w of the words x that a
text holds (present or not). Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII,
known by 64-bit hashes. The model is fitted on at most ``sample`` labelled rows of each class (those with the smallest
hashes of their ids), of which only word hashes reach the driver; the ``features`` words whose presence
tells most about the label are kept, if they tell more than chance, so the model has a fixed size. All texts are scored, whole.

Labels that know only toxic or not are graded first: a toxic text is of grade 2 if its share of words that
are typical of toxic texts is above the median of toxic texts, else of grade 1.
A null or empty text has no words and gets the score of an empty text; rows are scored one by one. Labels
without a document, with nulls, or of one class only teach nothing: without both classes all scores are 0.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.text import LOWER, flat, named, pieces, word_hash, words

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SIGNIFICANT = 3.5  # standard errors between the classes' shares of texts that hold a word
_SCORES = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


@dataclasses.dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def link(self, row: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        """w.x of every row, for distinct (row, word) pairs."""
        if not len(self.words):
            return np.zeros(size)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        own = self.words[at] == h
        return np.bincount(row[own], weights=self.weights[at[own]], minlength=size)

    def above(self, link: np.ndarray) -> np.ndarray:
        """P(grade >= k) of every row, for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - link[:, None], -50, 50)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, grade: np.ndarray, columns: int, *, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent with momentum on the likelihood; (row, column) are the ones of the design."""
    n, top = len(grade), int(grade.max())
    start = np.array([np.log((grade < k).mean() / max((grade >= k).mean(), 1e-9) + 1e-9) for k in range(1, top + 1)])
    # thresholds: the first, and logarithms of the gaps
    free = np.concatenate([np.zeros(columns), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, t = free[:columns], np.cumsum(np.append(free[columns], np.exp(free[columns + 1 :])))
        link = np.bincount(row, weights=w[column], minlength=n)
        p = 1 / (1 + np.exp(np.clip(link[:, None] - t, -50, 50)))  # P(grade <= k - 1)
        edge = np.concatenate([np.zeros((n, 1)), p, np.ones((n, 1))], 1)
        slope = edge * (1 - edge)
        mass = np.maximum(edge[np.arange(n), grade + 1] - edge[np.arange(n), grade], 1e-12)
        up, down = slope[np.arange(n), grade + 1] / mass, slope[np.arange(n), grade] / mass
        by_link = (down - up) / n
        by_t = np.array([(up * (grade == k - 1)).sum() - (down * (grade == k)).sum() for k in range(1, top + 1)]) / n
        by_free = np.concatenate([np.bincount(column, weights=by_link[row], minlength=columns) - ridge * w, [by_t.sum()], np.exp(free[columns + 1 :]) * np.cumsum(by_t[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * by_free, 0.999 * v + 0.001 * by_free**2
        free = free + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:columns], np.cumsum(np.append(free[columns], np.exp(free[columns + 1 :])))


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) pairs of a table."""
    buf, offsets = flat(table.column("text"))
    buf = LOWER[buf]
    start, end, row = words(buf, offsets, GAP)
    h = word_hash(buf, start, end)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[fresh], h[fresh]


def _word_sets(batches):
    for part in pieces(batches):
        row, h = _distinct(part)
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        sets = [h[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"label": part.column("label").combine_chunks().cast(pa.int32()), "set": pa.array(sets, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 4000, features: int = 2000, least: int = 5) -> OrdinalModel:
    """A model from labels (doc_id, ``label`` 0 or 1) and the texts of their documents."""
    labels = labels.select(F.col("doc_id").alias("labelled"), F.col(f"`{label}`").cast("int").alias("label")).where("labelled is not null and label in (0, 1)")
    some = [labels.where(F.col("label") == k).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for k in (0, 1)]
    chosen = some[0].unionAll(some[1])
    texts = named(docs, "doc_id", "text")
    found = texts.join(chosen, texts.doc_id == chosen.labelled).select("label", "text").mapInArrow(_word_sets, "label int, set binary").collect()
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(2, 50.0))
    toxic = np.array([r.label for r in found], bool)
    if not len(found) or toxic.all() or not toxic.any():
        return nothing
    sets = [np.frombuffer(r["set"], np.uint64) for r in found]
    row, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    known, column, many = np.unique(h, return_inverse=True, return_counts=True)
    held = np.bincount(column, weights=toxic[row], minlength=len(known))
    rate_toxic, rate_clean = held / toxic.sum(), (many - held) / (~toxic).sum()
    pooled = many / len(sets)
    tells = np.where(many >= least, np.abs(rate_toxic - rate_clean) / np.sqrt(pooled * (1 - pooled) * (1 / toxic.sum() + 1 / (~toxic).sum()) + 1e-12), 0)
    best = np.sort(np.argsort(-tells, kind="stable")[:features])
    best = best[tells[best] >= SIGNIFICANT]
    if not len(best):
        return nothing
    place = np.full(len(known), -1)
    place[best] = np.arange(len(best))
    own = place[column] >= 0
    row_in, column_in = row[own], place[column][own]
    typical = (rate_toxic > 5 * rate_clean) & (many >= least)
    share = np.bincount(row[typical[column]], minlength=len(sets)) / np.maximum([len(s) for s in sets], 1)
    grade = np.where(toxic, 1 + (share > np.median(share[toxic])), 0)
    if grade.max() < 2:
        grade = np.where(toxic, 1, 0)
    weights, thresholds = fit_ordinal(row_in, column_in, grade, len(best))
    return OrdinalModel(known[best], weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (the likeliest), toxic (p_toxic of a half or more)."""
    docs = named(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for part in pieces(batches):
            row, h = _distinct(part)
            above = sent.value.above(sent.value.link(row, h, part.num_rows))
            edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").combine_chunks().cast(pa.int64()),
                    "severity": pa.array(above.sum(1)),
                    "p_toxic": pa.array(above[:, 0]),
                    "grade": pa.array((edges[:, :-1] - edges[:, 1:]).argmax(1).astype(np.int32)),
                    "toxic": pa.array(above[:, 0] >= 0.5),
                }
            )

    return docs.mapInArrow(scored, _SCORES)
