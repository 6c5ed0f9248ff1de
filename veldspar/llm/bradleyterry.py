"""Document quality by Bradley-Terry pairwise ranking.

P(a is preferred to b) = sigmoid(w . (x_a - x_b)). Preference pairs are formed of all labelled documents that aren't held
out (each against several of the other label), and w minimises the logistic loss on the feature differences by
Newton steps whose sums Spark takes over partitions. The threshold is an exact quantile of these documents' scores: as large a
share lies below it as bears label 0. Published scores are sigmoid(w . x - threshold), moved so that the threshold is at ``cut``.

Features come from the text's UTF-8 bytes alone: the square roots of the shares of all pairs of neighbouring byte
classes (letters by case, digits, white space, single marks, symbols, bytes beyond ASCII), of the share of repeated
lines and words, and of lengths. Labels, language, source and id are no inputs.

Null and empty texts have zero features and the score that follows from them. Null labels and ids aren't learned from.
Without labels of both kinds every score is ``cut``. Repeated rows are scored alike, texts of any length are read whole;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import bounded_broadcast, newton, pieces, sigmoid, written
from veldspar.operators.scans import exact_quantiles


@dataclass(frozen=True)
class Settings:
    pairs_each: int = 3
    steps: int = 15
    cut: float = 0.3
    l2: float = 1e-4
    seed: int = 3


CLASSES = 16
DIMS = CLASSES * CLASSES + 6
BLOCK = 64  # documents of the more frequent label that meet the same others
SUMS = 24  # tasks that sum derivatives


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "$%&*#@^~", "\"'`()[]{}", "-_=/\\+<>", ":;"]
    for k, group in enumerate(groups):
        for c in group:
            table[ord(c)] = k
    table[128:] = 14
    return table


_TABLE = _class_table()


def features(texts: pa.Array) -> np.ndarray:
    """(rows, DIMS) float64 of an Arrow column of texts."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    size = np.array([len(t) for t in raw], np.int64)
    n = len(raw)
    out = np.zeros((n, DIMS))
    if size.sum():
        classes = _TABLE[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        doc = np.repeat(np.arange(n), size)
        pair = classes[:-1] * CLASSES + classes[1:]
        same = doc[:-1] == doc[1:]
        counts = np.bincount(doc[:-1][same] * CLASSES**2 + pair[same], minlength=n * CLASSES**2).reshape(n, -1)
        out[:, : CLASSES**2] = np.sqrt(counts / np.maximum(size[:, None] - 1, 1))
    for i, t in enumerate(raw):
        if t:
            words, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
            out[i, CLASSES**2 :] = (
                np.sqrt(1 - len(set(lines)) / max(len(lines), 1)), np.sqrt(1 - len(set(words)) / max(len(words), 1)), np.log1p(len(words)) / 10,
                np.log1p(len(lines)) / 10, np.log1p(len(t) / max(len(words), 1)) / 4, np.log1p(max(map(len, words), default=0)) / 10,
            )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights - self.threshold + np.log(self.cut / (1 - self.cut)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are only for measuring."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMS).astype(np.float64)


def _numbered(ids: DataFrame, seed: int) -> DataFrame:
    """(doc_id, i): distinct ids numbered from 0 in the order of a hash. Only counts of hash ranges meet in one task."""
    hashed = ids.select("doc_id").distinct().withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.shiftright("h", 52))
    sizes = hashed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")  # 4,096 rows at most
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "doc_id")) - 1
    return hashed.withColumn("at", inside).join(F.broadcast(before), "range").select("doc_id", (F.col("before") + F.col("at")).alias("i"))


def pairs(ranked: DataFrame, counts: dict[int, int], s: Settings) -> DataFrame:
    """(d binary): features of a good less those of a bad document, float32. ranked: doc_id, y, x; counts: its rows of each label.

    Documents of the more frequent label are dealt to blocks by a hash. Those of the other are dealt to the blocks in turn,
    again and again until every block has pairs_each of them. In its block each document meets pairs_each of the other
    label (all, if fewer): every document is in a pair."""
    few = 0 if counts[0] <= counts[1] else 1
    blocks = -(-counts[1 - few] // BLOCK)
    many = ranked.filter(F.col("y") != few).withColumn("block", F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(blocks)))
    dealt = _numbered(ranked.filter(F.col("y") == few), s.seed)
    distinct = dealt.count()
    slots = F.sequence(F.col("i"), F.lit(max(distinct, s.pairs_each * blocks) - 1), F.lit(distinct))
    turns = dealt.select("doc_id", F.explode(slots).alias("slot")).select("doc_id", F.pmod("slot", F.lit(blocks)).alias("block"))
    both = many.union(ranked.filter(F.col("y") == few).join(turns, "doc_id").select(*many.columns))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        y, x = table.column("y").to_numpy(), _matrix(table.column("x"))
        good, bad = x[y == 1], x[y == 0]
        if not len(good) or not len(bad):
            return pa.table({"d": pa.array([], pa.binary())})
        a = np.arange(max(len(good), len(bad)))
        k = np.arange(min(s.pairs_each, len(bad) if few == 0 else len(good)))
        fixed, turning = np.repeat(a, len(k)), (a[:, None] + k[None, :]).ravel()
        i, j = (fixed, turning) if few == 0 else (turning, fixed)
        return pa.table({"d": pa.array([r.tobytes() for r in (good[i % len(good)] - bad[j % len(bad)]).astype(np.float32)], pa.binary())})

    return both.select("block", "doc_id", "y", "x").groupBy("block").applyInArrow(meet, "d binary")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label_col: str = "quality") -> Model:
    """Learn from all labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    known = bounded_broadcast(written(known, "quality-labels"), 16)  # up to 2 M labels; beyond, texts are shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["doc_id", "y", "x"])

    ranked = written(texts.select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, x binary"), "quality-features")
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in ranked.groupBy("y").count().collect()}
    if not min(n.values()):
        return Model(np.zeros(DIMS), 0.0, s.cut)
    met = written(pairs(ranked, n, s), "quality-pairs").coalesce(SUMS)

    def derivatives(w: np.ndarray, batch: pa.RecordBatch) -> tuple[float, np.ndarray, np.ndarray]:
        x = _matrix(batch.column(0))
        margin = x @ w
        p = sigmoid(-margin)
        return float(np.logaddexp(0, -margin).sum()), -(p @ x), (x * (p * (1 - p))[:, None]).T @ x

    w = newton(met, derivatives, DIMS, s.steps, s.l2)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "x"):
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(part.column(0)) @ shared.value)], ["s"])

    below, rows = min(n[0], n[0] + n[1] - 1), n[0] + n[1]
    middle = (below - 0.5) / (rows - 1)  # between the scores numbered below - 1 and below, from 0
    return Model(w, float(exact_quantiles(ranked.select("x").mapInArrow(scores, "s double"), [], "s", [middle]).first()["q"][0]), s.cut)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(features(part.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))
