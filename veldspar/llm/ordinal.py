"""Toxicity by cumulative-link ordinal regression over sparse word features.

The vocabulary holds the words whose log odds of being in a toxic document differ clearly from zero.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all thresholds, which are kept in order by
positive gaps; x marks which words, and beginnings of words, of the
vocabulary a text holds. The likelihood of the grades is maximised by
gradients that Spark sums over the partitions of a bounded sample of labelled documents. A text's expected severity is
the sum over k of P(grade > k).

Where labels only say toxic or not, a toxic document's grade is its number of distinct marker words (words that occur
in far more toxic than other labelled documents), 1 to ``top_grade``; other documents have grade 0.

Null and empty texts have no features: they get the severity that the thresholds alone give. Null labels aren't
learned from; documents without a label are only scored. Ties and repeated rows are scored alike, row by row. Without
any labelled row the model is empty and every severity is 0. An empty table gives an empty result. Texts of any length
are read whole, and no other column is changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm.common import WordIds, hash_sample, minimise, pieces, sigmoid, written


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 26
    sample_rows: int = 20_000
    vocabulary: int = 8_192
    top_grade: int = 3
    least_z: float = 2.5
    marker_odds: float = 20.0
    marker_docs: int = 5
    steps: int = 60
    seed: int = 5
    reject_at: float = 0.6


@dataclass(frozen=True)
class Model:
    buckets: int
    words: np.ndarray  # sorted buckets
    weights: np.ndarray
    thresholds: np.ndarray  # in order; empty if there was nothing to learn from

    def grade_probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return sigmoid(np.asarray(eta)[:, None] - self.thresholds[None, :])


BEGINNINGS = range(4, 9)


def _ids(word: str, buckets: int) -> tuple[int, ...]:
    """Buckets of a word without punctuation and of its beginnings of 4 to 8 letters (forms of a word share them)."""
    bare = word.strip(WordIds.EDGES)
    names = [bare, *(f"{k}:{bare[:k]}" for k in BEGINNINGS if len(bare) > k)] if bare else []
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in names)


class _Features(dict):
    """Word -> the places of its features in the vocabulary."""

    def __init__(self, buckets: int, words: np.ndarray):
        super().__init__()
        self.buckets, self.place = buckets, {int(w): i for i, w in enumerate(words)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 150_000:
            self.clear()
        at = tuple(self.place[b] for b in _ids(word, self.buckets) if b in self.place)
        if len(word) <= 64:
            self[word] = at
        return at

    def of(self, text: str | None) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(text.lower().split())))) if text else []


def _word_table(sample: DataFrame, s: Settings) -> DataFrame:
    """(bucket, toxic, other): labelled documents that hold the word, summed per batch and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", 1 << 20):
            each = [np.array(list({b for w in set((t or "").lower().split()) for b in _ids(w, s.buckets)}), np.int64) for t in part.column(0).to_pylist()]
            ids, toxic = np.concatenate(each), np.repeat(np.array(part.column(1).to_pylist(), np.int64), [len(x) for x in each])
            if len(ids):
                words, place = np.unique(ids, return_inverse=True)
                both, bad = np.bincount(place, minlength=len(words)), np.bincount(place, weights=toxic, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bad), pa.array(both - bad)], ["bucket", "toxic", "other"])

    return sample.select("text", "toxic").mapInArrow(run, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def thresholds(parameters: np.ndarray) -> np.ndarray:
    """The first threshold and the logarithms of the gaps -> all thresholds."""
    return parameters[0] + np.concatenate(([0.0], np.cumsum(np.exp(parameters[1:]))))


def loss_gradient(x: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The gradient of minus the log likelihood of the grades y (from 0). x: a weight for each of size features, then the
    parameters of the thresholds; row, col: the places of the ones in the feature matrix."""
    w, theta, k = x[:size], thresholds(x[size:]), len(x) - size
    eta = np.bincount(row, weights=w[col], minlength=len(y))
    padded = np.concatenate(([-np.inf], theta, [np.inf]))
    hi, lo = sigmoid(padded[y + 1] - eta), sigmoid(padded[y] - eta)
    p = np.maximum(hi - lo, 1e-12)
    out = np.zeros(len(x))
    out[:size] = np.bincount(col, weights=(1 - hi - lo)[row], minlength=size)
    d_theta = np.bincount(y, weights=-hi * (1 - hi) / p, minlength=k + 1)[:k] + np.bincount(y, weights=lo * (1 - lo) / p, minlength=k + 1)[1:]
    after = np.cumsum(d_theta[::-1])[::-1]  # a gap moves all later thresholds
    out[size] = after[0]
    out[size + 1 :] = after[1:] * np.exp(x[size + 1 :])
    return out


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from at most Settings.sample_rows labelled documents."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(hash_sample(known, "doc_id", s.sample_rows, s.seed))
    sample = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id"), "toxicity-sample").coalesce(8)  # all tasks scan, few read the sample again
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic, n = int(totals[0] or 0), int(totals[1])
    if not 0 < toxic < n:
        return Model(s.buckets, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (n - toxic + 1))
    table = _word_table(sample, s).withColumn("odds", odds).withColumn("z", F.abs(odds) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5)))
    top = table.filter(F.col("z") >= s.least_z).orderBy(F.desc("z"), "bucket").limit(s.vocabulary).collect()
    words = np.array(sorted(r.bucket for r in top), np.int64)
    markers = {r.bucket for r in top if r.odds >= np.log(s.marker_odds) and r.toxic >= s.marker_docs}
    marked = np.array([int(w) in markers for w in words])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Features(s.buckets, words)
        for part in pieces(batches, "text"):
            texts, toxic = part.column(0).to_pylist(), part.column(1).to_pylist()
            cols = [place.of(t) for t in texts]
            hits = [sum(bool(marked[list(place[w])].any()) for w in set((t or "").lower().split()) if place[w]) if y else 0 for t, y in zip(texts, toxic, strict=True)]
            grades = [min(max(n, 1), s.top_grade) if y else 0 for n, y in zip(hits, toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.list_(pa.int32())), pa.array(grades, pa.int32())], ["cols", "grade"])

    rows = written(sample.select("text", "toxic").mapInArrow(features, "cols array<int>, grade int"), "toxicity-features").coalesce(4)
    counts = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    grades = sorted(counts)
    order, k = {g: i for i, g in enumerate(grades)}, len(grades) - 1
    share = np.cumsum([counts[g] for g in grades])[:-1] / sum(counts.values())
    first = np.log(share / (1 - share))
    start = np.concatenate((np.zeros(len(words)), [first[0]], np.log(np.maximum(np.diff(first), 1e-3))))
    l2 = np.concatenate((np.full(len(words), 3e-4), np.zeros(k)))

    def gradient(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        flat, lengths = batch.column(0).flatten().to_numpy(zero_copy_only=False), np.array([len(c) for c in batch.column(0)])
        return loss_gradient(x, np.repeat(np.arange(batch.num_rows), lengths), flat, np.array([order[g] for g in batch.column(1).to_pylist()]), len(words))

    x = minimise(rows, gradient, start, s.steps, 0.3, l2)
    return Model(s.buckets, words, x[: len(words)], thresholds(x[len(words) :]))


def score(docs: DataFrame, model: Model, text_col: str = "text", severity_col: str = "severity", toxic_col: str = "p_toxic") -> DataFrame:
    """docs with the expected severity and P(grade > 0) of each text; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(severity_col, toxic_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(severity_col, T.DoubleType()), T.StructField(toxic_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = _Features(m.buckets, m.words)
        for part in pieces(batches, text_col):
            eta = np.array([float(m.weights[place.of(t)].sum()) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()])
            above = m.grade_probabilities(eta)
            toxic = above[:, 0] if above.shape[1] else np.zeros(len(eta))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(above.sum(axis=1)), pa.array(toxic)], names=schema.names)

    return rest.mapInArrow(run, schema)
