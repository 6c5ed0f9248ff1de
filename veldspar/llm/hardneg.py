"""Hard negatives by inner product over rotated one-bit codes.

Vectors become integers floor(256 x). A row's code is the sign of each of its coordinates after a random rotation (signs
and Walsh-Hadamard transforms, from a seed). Beside the code the index keeps the row's alignment with its code vector (its
length along it) and the length of what is left, which is coded again under another rotation, ``LEVELS`` times. An
anchor's product with a code vector is a sum of popcounts over the bitmaps of the anchor's quantised coordinates. The
estimate of a score is the sum of these products, each times its alignment; by Cauchy and Schwarz what is left changes it
by at most the rest's length times that of the part of the anchor across the code vector. So every row has an interval
that surely holds its score. Rows whose interval can't reach the result are dropped, level by level; the rest are scored
in integers. The result is exact.

Row blocks stay where they are. Anchors travel to them in slices of at most ``SLICE_BYTES``, one slice a pass; a task
keeps each window's best rows so far, and its bar prunes the blocks that follow.

Rows whose id, label or vector is null, or whose vector holds null, NaN or infinite components, take no part; shorter vectors,
empty ones too, count as padded with zeros. Of rows that share an anchor's id the one with the smallest label, then
vector, is the anchor; none of them is its candidate. Elsewhere rows that share an id are separate candidates, and equal
rows appear once each. Ties go to the smaller id. Empty tables and anchors without positives give none. Other columns
don't matter, whatever their names. Components of 2 ** 31 / 256 or more, or so large that a sum of products could pass
2 ** 62, raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.bitslice import _matrix, _usable
from veldspar.llm.common import written

ROWS, LEVELS, QUERY_BITS, GROUP, SLICE_BYTES, SEED = 2048, 6, 8, 32, 4 << 20, 7

_INDEX = "ids binary, labels binary, exact binary, codes binary, align binary, rest binary"
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; it is its own inverse."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def _signs(level: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, level]).choice([-1.0, 1.0], (2, width))


def rotated(x: np.ndarray, level: int, back: bool = False) -> np.ndarray:
    """Each row of x after the rotation of a level, or back from it."""
    first, second = _signs(level, x.shape[1])
    return _hadamard(_hadamard(x) * second) * first if back else _hadamard(_hadamard(x * first) * second)


def _width(dims: int) -> int:
    return max(64, 1 << (dims - 1).bit_length())


def _padded(exact: np.ndarray) -> np.ndarray:
    out = np.zeros((len(exact), _width(exact.shape[1])))
    out[:, : exact.shape[1]] = exact
    return out


def encode(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes (levels, rows, words), alignments (levels, rows), lengths of the rests (levels, rows))."""
    left = _padded(exact)
    root = np.sqrt(left.shape[1])
    codes, align, rest = [], [], []
    for level in range(LEVELS):
        z = rotated(left, level)
        positive = z > 0
        length = np.abs(z).sum(axis=1) / root
        left = left - rotated(np.where(positive, 1.0, -1.0), level, back=True) * (length / root)[:, None]
        codes.append(np.packbits(positive, axis=1, bitorder="little").view("<u8"))
        align.append(length)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(codes), np.stack(align), np.stack(rest)


@dataclass
class Asked:
    """Anchors, their quantised bitmaps under each level's rotation, and what the quantisation can change at most."""

    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray

    def __post_init__(self) -> None:
        self.norm = np.sqrt((self.exact.astype(np.float64) ** 2).sum(axis=1))
        x = _padded(self.exact)
        self.root = np.sqrt(x.shape[1])
        self.planes, self.low, self.step, self.total, self.error = [], [], [], [], []
        for level in range(LEVELS):
            z = rotated(x, level)
            low = z.min(axis=1, initial=0.0)
            step = np.maximum((z.max(axis=1, initial=0.0) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
            whole = np.rint((z - low[:, None]) / step[:, None]).astype(np.int64)
            near = low[:, None] + step[:, None] * whole
            self.planes.append(np.stack([np.packbits((whole >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(QUERY_BITS)]))
            for column, value in ((self.low, low), (self.step, step), (self.total, near.sum(axis=1)), (self.error, np.abs(z - near).sum(axis=1) / self.root)):
                column.append(value)

    def product(self, level: int, who, codes: np.ndarray) -> np.ndarray:  # noqa: ANN001
        """Quantised anchors times code vectors, by popcounts. codes: (…, words), broadcast against the anchors who."""
        weighted = sum((np.bitwise_count(codes & self.planes[level][b][who]).sum(axis=-1, dtype=np.int64) << b for b in range(QUERY_BITS)), np.int64(0))
        ones = np.bitwise_count(codes).sum(axis=-1, dtype=np.int64)
        return (2 * (self.step[level][who] * weighted + self.low[level][who] * ones) - self.total[level][who]) / self.root


def _kth_lower(window: np.ndarray, lower: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of each of n windows: the k-th largest of its lower bounds, or -inf where it has fewer."""
    out = np.full(n, -np.inf)
    order = np.lexsort((-lower, window))
    window, lower = window[order], lower[order]
    at = np.searchsorted(window, np.arange(n)) + k - 1
    ok = at < np.searchsorted(window, np.arange(n), "right")
    out[ok] = lower[at[ok]]
    return out


def best_of_block(block: tuple, asked: Asked, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, bar: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window number, row number, score) of the rows that may be among the k best of a window lo..hi of its anchor: same
    label as the anchor or not, score of at least bar. All of the block's k best with such scores are among them."""
    ids, labels, exact, codes, align, rest = block
    out = []
    for at in range(0, int(anchor.max(initial=-1)) + 1, GROUP):
        windows = np.arange(np.searchsorted(anchor, at), np.searchsorted(anchor, at + GROUP))
        if not len(windows):
            continue
        who = np.arange(at, min(at + GROUP, len(asked.ids)))
        own, slack = anchor[windows] - at, 1e-9 * asked.norm[who][:, None] * (align**2).sum(axis=0)[None, :] ** 0.5 + 1e-6
        slack += 1e-9 * asked.norm[who][:, None] * rest[-1][None, :]
        allowed = ((labels[None, :] == asked.labels[who][:, None]) == same) & (ids[None, :] != asked.ids[who][:, None])
        t = asked.product(0, who[:, None], codes[0][None])
        known, unsure = t * align[0], align[0] * asked.error[0][who][:, None] + slack
        across = np.sqrt(np.maximum(asked.norm[who][:, None] ** 2 - np.maximum(np.abs(t) - asked.error[0][who][:, None], 0) ** 2, 0))
        window, row = np.nonzero(allowed[own])
        for level in range(LEVELS):
            pair = own[window], row
            if level:
                cell = np.unique(pair[0] * len(ids) + row)
                a, r = cell // len(ids), cell % len(ids)
                t = asked.product(level, at + a, codes[level][r])
                error = asked.error[level][at + a]
                known[a, r] += align[level][r] * t
                unsure[a, r] += align[level][r] * error
                across[a, r] = np.sqrt(np.maximum(asked.norm[at + a] ** 2 - np.maximum(np.abs(t) - error, 0) ** 2, 0))
            middle, width = known[pair], unsure[pair] + rest[level][row] * across[pair]
            lower, upper = middle - width, middle + width
            low, high = lo[windows][window], hi[windows][window]
            sure = (lower >= low) & (upper <= high)
            least = np.maximum(_kth_lower(window[sure], lower[sure], k, len(windows)), bar[windows])
            alive = (upper >= low) & (lower <= high) & (upper >= least[window])
            window, row = window[alive], row[alive]
        cell, back = np.unique(own[window] * len(ids) + row, return_inverse=True)
        score = np.einsum("ij,ij->i", exact[cell % len(ids)], asked.exact[at + cell // len(ids)])[back]
        inside = (score >= lo[windows][window]) & (score <= hi[windows][window])
        out.append((windows[window[inside]], row[inside], score[inside]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _first(window: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each window, in order."""
    order = np.lexsort((ids, -score, window))
    window, ids, score = window[order], ids[order], score[order]
    best = np.arange(len(window)) - np.searchsorted(window, window) < k
    return window[best], ids[best], score[best]


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(blocks, dims): at most ROWS rows a block, built within the partitions without a shuffle, and written to the shared
    folder."""
    v = _rows(vectors, id_col, vector_col, label_col)
    size, low, high = v.agg(F.max(F.size("v")), F.min(F.array_min("v")).cast("double"), F.max(F.array_max("v")).cast("double")).first()
    if size is None:
        return v.sparkSession.createDataFrame([], _INDEX), 0
    dims = max(int(size), 1)
    if (most := np.ceil(256 * max(abs(low or 0), abs(high or 0)))) >= 1 << 31 or dims * most**2 >= 1 << 62:
        raise ValueError(f"components up to {most} / 256 in {dims} dimensions are too large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, labels = (part.column(c).to_numpy().astype(np.int64) for c in range(2))
                exact = _matrix(part.column(2), dims)
                values = (ids, labels, exact.astype(np.int32), *encode(exact))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], ["ids", "labels", "exact", "codes", "align", "rest"])

    return written(v.mapInArrow(run, _INDEX), "one-bit-codes"), dims


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    return v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))


def _block(batch: pa.RecordBatch, i: int, dims: int) -> tuple:
    ids, labels, exact, codes, align, rest = (batch.column(c)[i].as_buffer() for c in range(6))
    ids = np.frombuffer(ids, np.int64)
    shape = LEVELS, len(ids)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(exact, np.int32).astype(np.int64).reshape(-1, dims), np.frombuffer(codes, np.uint64).reshape(*shape, -1), np.frombuffer(align).reshape(shape), np.frombuffer(rest).reshape(shape)


def _best(blocks: DataFrame, dims: int, slices: DataFrame, passes: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score, rank): each window's k best rows. slices: (pass, id, label, v, tag, lo, hi), one row a
    window. A pass takes one slice to all blocks."""
    spark, kinds, found = blocks.sparkSession, "anchor_id long, tag long, vec_id long, score long", []
    for p in range(passes):
        mine = slices.filter(F.col("pass") == p).orderBy("id", "tag").toArrow()
        if not mine.num_rows:
            continue
        ids, first, anchor = np.unique(mine["id"].to_numpy(), return_index=True, return_inverse=True)
        exact = _matrix(mine["v"].combine_chunks(), dims)[first]
        shared = spark.sparkContext.broadcast((ids, mine["label"].to_numpy()[first], exact, anchor, *(mine[c].to_numpy() for c in ("tag", "lo", "hi"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, labels, exact, anchor, tag, lo, hi = shared.value
            asked, bar = Asked(ids, labels, exact), np.full(len(anchor), -np.inf)
            best = (np.zeros(0, np.int64),) * 3
            for batch in batches:
                for i in range(batch.num_rows):
                    block = _block(batch, i, dims)
                    window, row, score = best_of_block(block, asked, anchor, lo, hi, bar, same, k)
                    best = _first(*(np.concatenate(x) for x in zip(best, (window, block[0][row], score), strict=True)), k)
                    bar = np.maximum(bar, _kth_lower(best[0], best[2], k, len(anchor)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[anchor[best[0]]], tag[best[0]], best[1], best[2])], ["anchor_id", "tag", "vec_id", "score"])

        found.append(written(blocks.mapInArrow(run, kinds), "best-of-tasks"))
        shared.destroy()
    every = spark.createDataFrame([], kinds)
    for part in found:
        every = every.union(part)
    order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). An anchor's positives are the rows of its
    label with the highest scores; each positive's negatives are those of other labels with the highest scores from
    ``least`` to ``most`` hundredths of the positive's."""
    blocks, dims = index(vectors, id_col, vector_col, label_col)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = _rows(anchors, id_col, vector_col, label_col).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    asked = written(asked, "anchors")
    passes = max(1, -(-asked.count() * 8 * dims // SLICE_BYTES))
    slices = asked.withColumn("pass", F.pmod(F.xxhash64("id"), F.lit(passes)))
    whole = slices.select("*", F.lit(0).cast("long").alias("tag"), F.lit(_LOWEST).alias("lo"), F.lit(_HIGHEST).alias("hi"))
    close = written(_best(blocks, dims, whole, passes, True, positives).select(F.col("anchor_id").alias("id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = close.select("id", F.col("positive_score").alias("tag")).distinct()  # equal scores have equal windows
    windows = written(slices.join(_bounds(bounds, least, most), "id").filter("lo <= hi").select("pass", "id", "label", "v", "tag", "lo", "hi"), "windows")
    far = _best(blocks, dims, windows, passes, False, negatives)
    pairs = close.join(far.select(F.col("anchor_id").alias("id"), F.col("tag").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["id", "positive_score"])
    return pairs.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _bounds(scores: DataFrame, least: int, most: int) -> DataFrame:
    """lo and hi of each score (tag): its hundredths, rounded up and down in whole numbers."""

    def share(percent: int, rounded) -> Column:  # noqa: ANN001
        rest = (F.expr("tag % 100") * percent).cast("decimal(20,0)") / F.lit(100)
        return F.expr("tag div 100") * percent + rounded(rest).cast("long")

    return scores.select("id", "tag", share(least, F.ceil).alias("lo"), share(most, F.floor).alias("hi"))


def oracle(every: int = 100) -> str:
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % {every} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10"""
