"""Benchmark decontamination by latent semantic retrieval.

1. Word counts over all documents give an inverse frequency to each hashed word.
2. Benchmark items, cut into passages of ``window`` words, make a TF-IDF matrix; its leading right singular vectors
   come from a randomised SVD whose products with the matrix are sums over Spark partitions.
3. Every window of every document (``window`` words, half overlapping) is folded into the latent space and compared
   with all item passages by cosine; the norm is the window's whole TF-IDF norm, so what lies outside of the latent
   space counts against it.
4. Around each candidate window the longest common subsequence of words with the whole item is taken, and the share
   of the item's rarest words (its answer terms) that occur there. Both must reach their thresholds; a subsequence of
   ``sure_lcs`` of an item of ``sure_words`` words or more is enough by itself.

Words of very many windows weigh nothing. Items that hold no other word have no latent vector: their candidates are the
windows that share ``gram`` neighbouring words with them (all of their words, if they have fewer); step 4 follows. Items
whose words weigh little may stay below the cosine among words of great weight: items that ``heavy`` of all words' weights around
them could hide are sought by their ``light_grams`` rarest sequences of ``gram`` words as well.

The benchmark is taken in slices of ``slice_items`` items and about ``slice_words`` words at most. A slice whose latent space of ``rank`` dimensions
keeps less than ``kept`` of any passage's squared norm is cut further, so that recall doesn't depend on the benchmark's
size (an item that fails alone gets a larger rank). A slice and its model have a bounded size; ``pass_slices`` of them
travel with the tasks, and a larger benchmark takes more passes over the documents, whose hits are written one by one.

Nulls and empty texts have no words and match nothing; null ids, of documents and items, are kept as null. A repeated
row gives its hits once a row; equal items are one. Items without words match nothing. Ties don't arise: every hit is
returned. Texts of any length are read whole; empty tables give no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import WordIds, pieces, written


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 20
    window: int = 32
    rank: int = 256
    energy: float = 0.95
    kept: float = 0.7
    stop_idf: float = 1.5
    power: int = 2
    min_cosine: float = 0.3
    min_lcs: float = 0.6
    min_answer: float = 0.5
    sure_lcs: float = 0.7
    sure_words: int = 8
    gram: int = 4
    heavy: float = 0.95
    light_grams: int = 3
    slice_items: int = 4096
    slice_words: int = 200_000
    pass_slices: int = 8
    seed: int = 7


def word_counts(docs: DataFrame, s: Settings, text_col: str = "text") -> np.ndarray:
    """Occurrences of each word bucket in all documents: partial counts per task, summed by Spark in blocks of
    buckets. The result has a fixed size."""
    block = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = WordIds(s.buckets), np.zeros(s.buckets, np.int64)
        for part in pieces(batches, "text"):
            n += np.bincount(words.column(part.column(0))[0], minlength=s.buckets)
        for k in range(0, s.buckets, block):
            if n[k : k + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k : k + block].tobytes()], pa.binary())], ["k", "n"])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(block, np.int64)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                n += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["k", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "k int, n binary").groupBy("k").applyInArrow(total, "k int, n binary")
    out = np.zeros(s.buckets, np.int64)
    for row in sums.toLocalIterator():
        out[row.k : row.k + block] = np.frombuffer(row.n, np.int64)
    return out


def inverse_frequency(counts: np.ndarray, window: int, stop: float = 0.0) -> np.ndarray:
    """-log of the share of windows that hold the word, if its occurrences were spread evenly; at least one each.
    Words below ``stop`` (those of very many windows) weigh nothing."""
    share = -np.expm1(-window * np.maximum(counts, 1) / max(int(counts.sum()), 1))
    weight = -np.log(np.clip(share, 1e-12, 1.0)).astype(np.float32)
    weight[0] = 0
    return np.where(weight < stop, 0, weight).astype(np.float32)


class Slice:
    """A slice of the benchmark: its words, passages and latent model. Bounded by Settings.slice_items."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, s: Settings, heavy: float = 0.0):
        words, self.heavy = WordIds(s.buckets), heavy
        self.settings, self.item_ids, self.item_words, self.answers, self.masks, owner, rows = s, [], [], [], [], [], []
        for item_id, text in items:
            ids = words.of(text)
            ids = ids[ids > 0]
            if not len(ids):
                continue
            k = len(self.item_ids)
            self.item_ids.append(item_id)
            self.item_words.append(ids)
            distinct = np.unique(ids)
            rare = distinct[np.argsort(-idf[distinct], kind="stable")][: max(1, (len(distinct) + 2) // 3)]
            self.answers.append(set(rare.tolist()))
            mask: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)
            for at in range(0, max(1, len(ids) - s.window // 2), s.window // 2):
                owner.append(k)
                rows.append(ids[at : at + s.window])
        self.owner = np.array(owner, np.int64)
        self.passages = rows
        vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int32)
        self.vocabulary = vocabulary[idf[vocabulary] > 0]
        self.idf = idf

    def matrix(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(column, TF-IDF) of each passage, of length one; columns by the slice's vocabulary."""
        out = []
        for p in self.passages:
            at = np.searchsorted(self.vocabulary, p)
            ok = (at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, max(len(self.vocabulary) - 1, 0))] == p) if len(self.vocabulary) else np.zeros(len(p), bool)
            col, tf = np.unique(at[ok], return_counts=True)
            val = (tf * self.idf[self.vocabulary[col]]).astype(np.float32)
            out.append((col, val / max(float(np.linalg.norm(val)), 1e-9)))
        return out


def randomised_svd(matrix: DataFrame, columns: int, s: Settings) -> np.ndarray:
    """Right singular vectors (columns x rank, float32; the largest first) of a sparse matrix given as rows (col
    array<int>, val array<float>). Every product with the matrix and its transpose runs over the partitions; the driver holds columns x
    (rank + 16) numbers."""
    width = min(columns, s.rank + 16)
    rng = np.random.default_rng(s.seed)
    basis = rng.standard_normal((columns, width)).astype(np.float32)

    def gram(q: np.ndarray) -> np.ndarray:
        shared = matrix.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, q = np.zeros((columns, width), np.float32), shared.value
            for batch in batches:
                for col, val in zip(batch.column(0), batch.column(1), strict=True):
                    c, v = col.values.to_numpy(zero_copy_only=False), val.values.to_numpy(zero_copy_only=False)
                    out[c] += v[:, None] * (v @ q[c])
            for k in range(0, columns, 1024):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out[k : k + 1024].tobytes()], pa.binary())], ["k", "x"])

        def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sum(np.frombuffer(y, np.float32).astype(np.float64) for b in batches for y in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["k", "x"])

        out = np.zeros((columns, width), np.float32)
        for row in matrix.mapInArrow(run, "k int, x binary").groupBy("k").applyInArrow(total, "k int, x binary").toLocalIterator():
            part = np.frombuffer(row.x, np.float32).reshape(-1, width)
            out[row.k : row.k + len(part)] = part
        shared.unpersist()
        return out

    for _ in range(s.power):
        basis = np.linalg.qr(gram(np.ascontiguousarray(basis)))[0].astype(np.float32)
    small = basis.T @ gram(np.ascontiguousarray(basis))  # = (A Q)' (A Q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[: s.rank]]).astype(np.float32)


def latent_space(spark: SparkSession, part: Slice, s: Settings) -> np.ndarray | None:
    """The slice's vectors, as many as keep ``energy`` of the whole matrix and ``kept`` of every passage; None if rank
    is too small for the latter."""
    matrix = part.matrix()
    rows = spark.createDataFrame([(c.tolist(), v.tolist()) for c, v in matrix], "col array<int>, val array<float>")
    vectors = randomised_svd(rows, len(part.vocabulary), s)
    share = np.cumsum(np.stack([v @ vectors[c] for c, v in matrix if len(c)]) ** 2, axis=1)
    if share[:, -1].min() < s.kept:
        return None
    rank = max(int(np.searchsorted(share.mean(axis=0), s.energy)), int(np.argmax(share.min(axis=0) >= s.kept))) + 1
    return vectors[:, :rank]


def _fitted(spark: SparkSession, items: list[tuple[int, str]], idf: np.ndarray, s: Settings, heavy: float) -> Iterator[tuple[Slice, np.ndarray]]:
    """The items in slices with their latent spaces, cut until every passage is kept."""
    part = Slice(items, idf, s, heavy)
    if not len(part.vocabulary):
        if part.item_ids:
            yield part, np.zeros((0, 1), np.float32)
        return
    if (latent := latent_space(spark, part, s)) is not None:
        yield part, latent
    elif len(items) == 1:
        yield from _fitted(spark, items, idf, replace(s, rank=2 * s.rank), heavy)
    else:
        n = -(-len(items) // max(2, -(-3 * len(part.passages) // (4 * s.rank))))
        for k in range(0, len(items), n):
            yield from _fitted(spark, items[k : k + n], idf, s, heavy)


def lcs(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words, bit-parallel."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := mask.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each n neighbouring words."""
    key = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return key


def _is_light(passage: np.ndarray, part: Slice, s: Settings) -> bool:
    """Whether the passage's cosine with a window that holds it may stay below the threshold."""
    _, tf = np.unique(passage, return_counts=True)
    weight = part.idf[passage].astype(np.float64)
    own = float(((tf * part.idf[np.unique(passage)]) ** 2).sum()) * (1.0 if len(passage) <= s.window // 2 else 0.5)  # a longer one may be cut by the windows
    return s.kept * own <= s.min_cosine**2 * (float((weight**2).sum()) + (s.window - min(len(passage), s.window // 2)) * part.heavy)


def _grams(part: Slice, s: Settings) -> dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[int]]]]:
    """By size: word sequences of the items that the cosine may miss, and whose they are; before that, which values of
    the first 16 bits occur, and all numbers in order."""
    light = np.ones(len(part.item_words), bool)
    for k, p in zip(part.owner.tolist(), part.passages, strict=True):
        light[k] &= _is_light(p, part, s)
    found: dict[int, dict[int, list[int]]] = {}
    for k, ids in enumerate(part.item_words):
        if not light[k]:
            continue
        n = min(s.gram, len(ids))
        keys = _gram_keys(ids, n)
        if (part.idf[ids] > 0).any():  # others have grams of frequent words only
            weight = np.convolve(part.idf[ids], np.ones(n), "valid")
            apart: list[int] = []
            for i in np.argsort(-weight, kind="stable").tolist():
                if len(apart) < s.light_grams and all(abs(i - j) >= n for j in apart):
                    apart.append(i)
            keys = keys[apart]
        for key in set(keys.tolist()):
            found.setdefault(n, {}).setdefault(key, []).append(k)
    out = {}
    for n, keys in found.items():
        ordered = np.array(sorted(keys), np.uint64)
        some = np.zeros(1 << 16, bool)
        some[(ordered >> np.uint64(48)).astype(np.int64)] = True
        out[n] = some, ordered, keys
    return out


def _hits(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray, idf2: np.ndarray, model: tuple, s: Settings) -> pa.RecordBatch | None:
    """The documents of a batch, given by their ids and words, that hold an item of the slice."""
    items, folded, row_of, owner, item_ids, item_words, masks, answers, grams = model
    half = s.window // 2
    if not len(ids):
        return None
    lengths = np.diff(offsets)
    blocks = -(-lengths // half)
    first = np.concatenate(([0], np.cumsum(blocks)))
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    block = first[doc_of] + (np.arange(len(ids)) - offsets[doc_of]) // half
    n = int(first[-1])
    squared = np.bincount(block, weights=idf2[ids], minlength=n)
    latent = np.zeros((n, folded.shape[1]), np.float32)
    rows = row_of[ids]
    known = np.flatnonzero(rows >= 0)
    at = block[known]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    order = np.argsort(nth.astype(np.int8), kind="stable")
    ends = np.cumsum(np.bincount(nth, minlength=1))
    for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):  # the first known word of each block, the second, ...
        some = order[lo:hi]
        latent[at[some]] += folded[rows[known[some]]]
    doc_of_block = np.repeat(np.arange(len(lengths)), blocks)
    joined = doc_of_block[:-1] == doc_of_block[1:]
    latent[:-1][joined] += latent[1:][joined]  # a window is a block and the next of the same document
    squared[:-1][joined] += squared[1:][joined]
    limit = s.min_cosine * np.sqrt(np.maximum(squared, 1e-9)).astype(np.float32)
    hits: dict[tuple[int, int], list] = {}
    able = np.flatnonzero(np.einsum("ij,ij->i", latent, latent) >= limit**2 * (1 - 1e-4))  # no cosine is larger than the window's share in the latent space
    for k in range(0, len(able), 4096):
        some = able[k : k + 4096]
        score = latent[some] @ items
        for b, p in zip(*np.nonzero(score >= limit[some, None]), strict=True):
            at = int(some[b])
            hits.setdefault((int(doc_of_block[at]), int(owner[p])), []).append((at, float(score[b, p] / limit[at] * s.min_cosine)))
    for size, (some, ordered, keys) in grams.items():
        found_keys = _gram_keys(ids, size)
        at = np.flatnonzero(some[(found_keys >> np.uint64(48)).astype(np.int64)])
        for i in at[np.isin(found_keys[at], ordered)].tolist():
            if doc_of[i] == doc_of[i + size - 1]:
                for item in keys[int(found_keys[i])]:
                    where = hits.setdefault((int(doc_of[i]), item), [])
                    if not where or where[-1][0] != int(block[i]):
                        where.append((int(block[i]), 0.0))
    found = []
    for (d, item), where in sorted(hits.items()):
        size, best, cosine = len(item_words[item]), (0.0, 0.0), max(c for _, c in where)
        spans: list[list[int]] = []
        for b, _ in sorted(where):  # the stretch around each candidate, joined where they meet
            lo = max(0, int(b - first[d]) * half - size)
            hi = int(b - first[d]) * half + s.window + size
            if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 8 * (size + s.window):
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            near = ids[offsets[d] + lo : min(offsets[d] + hi, offsets[d + 1])].tolist()
            terms = answers[item]
            best = max(best, (lcs(masks[item], size, near) / size, len(terms.intersection(near)) / len(terms)))
        sure = best[0] >= s.sure_lcs and size >= s.sure_words
        if sure or best[0] >= s.min_lcs and best[1] >= s.min_answer:
            found.append((d, item_ids[item], cosine, *best))
    if found:
        d, item, cosine, ratio, share = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d, pa.int64())), pa.array(item, pa.int64()), pa.array(cosine, pa.float64()), pa.array(ratio, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "cosine", "lcs_ratio", "answer_share"])
    return None


def _model(part: Slice, latent: np.ndarray, s: Settings) -> tuple:
    items = np.stack([v @ latent[c] for c, v in part.matrix()])  # zeros for passages without weight
    folded = (latent * part.idf[part.vocabulary][:, None]).astype(np.float32)
    row_of = np.full(s.buckets, -1, np.int32)
    row_of[part.vocabulary] = np.arange(len(part.vocabulary), dtype=np.int32)
    return items.T.astype(np.float32).copy(), folded, row_of, part.owner, part.item_ids, part.item_words, part.masks, part.answers, _grams(part, s)


def _search(docs: DataFrame, models: list[tuple], idf: np.ndarray, s: Settings) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((idf**2, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (idf2, models) = WordIds(s.buckets), shared.value
        for batch in pieces(batches, "text", 1 << 20):
            ids, offsets = words.column(batch.column(1))
            for model in models:
                if (found := _hits(batch.column(0), ids, offsets, idf2, model, s)) is not None:
                    yield found

    return docs.mapInArrow(run, "doc_id long, item_id long, cosine double, lcs_ratio double, answer_share double")


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_share): the documents that hold a benchmark item, whole or reworded."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = word_counts(docs, s, text_col)
    idf = inverse_frequency(counts, s.window, s.stop_idf)
    by_weight = np.argsort(idf, kind="stable")
    heavy = float(idf[by_weight[min(len(idf) - 1, int(np.searchsorted(np.cumsum(counts[by_weight]), s.heavy * counts.sum())))]]) ** 2
    ordered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct().orderBy("item_id", "text")

    def slices() -> Iterator[list[tuple[int, str]]]:
        held: list[tuple[int, str]] = []
        size = 0
        for row in ordered.toLocalIterator():
            n = len(row.text.split())
            if held and (len(held) == s.slice_items or size + n > s.slice_words):
                yield held
                held, size = [], 0
            held.append((row.item_id, row.text))
            size += n
        if held:
            yield held

    models = (_model(part, latent, s) for items in slices() for part, latent in _fitted(spark, items, idf, s, heavy))
    out = None
    while some := list(islice(models, s.pass_slices)):  # one pass over the documents
        found = _search(texts, some, idf, s)
        if out is not None or len(some) == s.pass_slices:  # there may be more passes: their models needn't wait for each other
            found = written(found, "leaks-of-a-pass")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_ratio double, answer_share double")
