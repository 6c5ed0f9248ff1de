"""Exact top-k by inner product over a bit-sliced index.

Vectors become integers floor(256 x). The index holds blocks of rows: each attribute, quantised to ``BITS`` bits, is a
bitmap per bit. A query adds the bitmaps of its attributes, weighted by its own quantised components, with bitwise
arithmetic (ripple-carry adders over 64 rows a word, many queries at once), which gives each row's approximate score as
bitmaps again. From the most significant one downward they yield the k-th best approximate score of a block; every row
that can reach it within the block's error bound is scored exactly. So the result is exact whatever the quantisation.

Query blocks meet row blocks by an equi-join on (query block, row block): the stated query set against all rows.

Vectors that are null or hold null, NaN or infinite components, and null ids, take no part; shorter vectors, empty ones
too, count as padded with zeros. Rows with the query's id aren't its candidates. Of rows that share a query's id the smallest
vector is the query. Ties go to the smaller id; rows that share an id are separate candidates. Empty tables give none.
Components of 2 ** 31 / 256 or more, or so large that a sum of products could pass 2 ** 62, raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import written

BITS, QUERY_BITS, ROWS, QUERIES, GROUP = 6, 5, 4096, 1024, 64


def _usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    if isinstance(column, pa.ListArray) and len(column):
        lengths = np.diff(column.offsets.to_numpy())
        values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """(n, rows) of 0 and 1 as (n, words of 64 rows)."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), np.uint8)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def _scores(slices: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bitmaps (most bits, queries, words) of sum over attributes of |q| * (value, or its complement where q < 0)."""
    dims, bits, words = slices.shape
    negative, size = q < 0, np.abs(q)
    width = max(1, int(np.max(size.sum(axis=1))).bit_length() + bits)
    acc = np.zeros((width, len(q), words), np.uint64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    bound = np.zeros(len(q), np.int64)
    for d in range(dims):
        flip = np.where(negative[:, d], ones, np.uint64(0))[:, None]
        for b in range(int(size[:, d].max()).bit_length()):
            has = (size[:, d] >> b & 1).astype(bool)
            if not has.any():
                continue
            mask = np.where(has, ones, np.uint64(0))[:, None]
            bound += np.where(has, ((1 << bits) - 1) << b, 0)
            carry = np.zeros((len(q), words), np.uint64)
            for j in range(bits):
                x = (slices[d, j][None, :] ^ flip) & mask
                a = acc[b + j]
                s = a ^ x
                over = (a & x) | (s & carry)
                acc[b + j], carry = s ^ carry, over
            for j in range(b + bits, min(width, int(bound.max()).bit_length())):
                a = acc[j]
                acc[j], carry = a ^ carry, a & carry
    return acc


def _count(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap).sum(axis=-1, dtype=np.int64)


def _kth(acc: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each query over the valid rows, from the most significant bitmap downward."""
    equal = np.broadcast_to(valid, acc.shape[1:]).copy()
    above, value = np.zeros(acc.shape[1], np.int64), np.zeros(acc.shape[1], np.int64)
    for j in range(len(acc) - 1, -1, -1):
        one = equal & acc[j]
        n = _count(one)
        take = above + n >= k
        equal = np.where(take[:, None], one, equal & ~acc[j])
        above = np.where(take, above, above + n)
        value |= np.where(take, 1 << j, 0)
    return value


def _at_least(acc: np.ndarray, valid: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose value reaches least, from the most significant bitmap downward."""
    equal = np.broadcast_to(valid, acc.shape[1:]).copy()
    more = np.zeros(acc.shape[1:], np.uint64)
    for j in range(len(acc) - 1, -1, -1):
        bit = (least >> j & 1).astype(bool)[:, None]
        more |= np.where(bit, np.uint64(0), equal & acc[j])
        equal = np.where(bit, equal & acc[j], equal & ~acc[j])
    return np.where((least <= 0)[:, None], valid, np.where((least >> len(acc) > 0)[:, None], np.uint64(0), more | equal))


def top_of_block(ids: np.ndarray, exact: np.ndarray, slices: np.ndarray, low: int, step: int, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows of a block and all that tie with the last."""
    rows, dims = exact.shape
    q_step = max(1, -(-int(np.abs(q).max(initial=0)) // ((1 << QUERY_BITS) - 1)))
    coarse = np.rint(q / q_step).astype(np.int64)
    middle = low + (step - 1) / 2
    quantised = (exact - low) // step
    residual = float(np.sqrt(((exact - middle - step * quantised) ** 2).sum(axis=1).max()))
    length = float(np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1).max()))
    error = np.sqrt(((q_step * coarse) ** 2).sum(axis=1)) * residual + np.sqrt(((q - q_step * coarse) ** 2).sum(axis=1)) * length
    margin = np.ceil(2 * error / (q_step * step) + 1).astype(np.int64)
    valid = _packed(np.ones((1, rows), np.uint8))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), GROUP):
        part = slice(at, at + GROUP)
        acc = _scores(slices, coarse[part])
        least = _kth(acc, valid, min(rows, k + 1)) - margin[part]  # one more, as the query itself may be among them
        able = np.unpackbits(_at_least(acc, valid, least).view(np.uint8), axis=-1, bitorder="little")[:, :rows]
        who, row = np.nonzero(able)
        score = np.einsum("ij,ij->i", exact[row], q[part][who])
        keep = ids[row] != q_ids[part][who]
        who, row, score = who[keep], row[keep], score[keep]
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        first = np.searchsorted(who, who)
        best = np.arange(len(who)) - first < k
        out.append((who[best] + at, row[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int, int]:
    """(blocks, dims, low, step). blocks: (block long, ids, exact, slices as binary), at most ROWS rows each; built
    within the partitions, without a shuffle, and written to the shared folder."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    size, low, high = v.agg(F.max(F.size("v")), F.floor(256 * F.min(F.array_min("v")).cast("double")), F.floor(256 * F.max(F.array_max("v")).cast("double"))).first()
    if size is None:
        return v.sparkSession.createDataFrame([], "block long, ids binary, exact binary, slices binary"), 0, 0, 1
    dims, low, high = max(int(size), 1), min(int(low or 0), 0), max(int(high or 0), 0)
    if (most := max(high, -low)) >= 1 << 31 or dims * most**2 >= 1 << 62:
        raise ValueError(f"components up to {most} / 256 in {dims} dimensions are too large")
    step = max(1, -(-(high - low + 1) // (1 << BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                exact, ids = _matrix(part.column(1), dims), part.column(0).to_numpy().astype(np.int64)
                value = (exact - low) // step
                slices = _packed(np.stack([(value.T >> j & 1).astype(np.uint8) for j in range(BITS)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([exact.astype(np.int32).tobytes()], pa.binary()), pa.array([slices.tobytes()], pa.binary())], ["ids", "exact", "slices"])

    blocks = v.mapInArrow(run, "ids binary, exact binary, slices binary").select(F.monotonically_increasing_id().alias("block"), "ids", "exact", "slices")
    return written(blocks, "bit-slices"), dims, low, step


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows with the largest integer inner products, exactly."""
    blocks, dims, low, step = index(vectors, id_col, vector_col)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    spark, kinds = vectors.sparkSession, "query_id long, vec_id long, score long"
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(1).to_numpy().astype(np.int64), _matrix(b.column(2), dims)) for b in batches]
        ids, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], ["q_block", "q_ids", "q"])

    width = max(1, -(-asked.count() // QUERIES))
    salts = max(1, min(blocks.count(), 64 // width))  # few query blocks: their copies spread over more tasks
    q_blocks = written(asked.select(F.pmod(F.xxhash64("id"), F.lit(width)).alias("q_block"), "id", "v").groupBy("q_block").applyInArrow(pack, "q_block long, q_ids binary, q binary"), "queries")
    cells = blocks.select(F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "ids", "exact", "slices", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("q_block"))
    paired = cells.join(q_blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")).hint("merge"), ["q_block", "salt"])  # query blocks grow with the queries: never broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, exact, slices, q_ids, q = (batch.column(c)[i].as_buffer() for c in range(5))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                exact, q = np.frombuffer(exact, np.int32).astype(np.int64).reshape(-1, dims), np.frombuffer(q, np.int64).reshape(-1, dims)
                who, row, score = top_of_block(ids, exact, np.frombuffer(slices, np.uint64).reshape(dims, BITS, -1), low, step, q_ids, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(ids[row]), pa.array(score)], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = paired.select("ids", "exact", "slices", "q_ids", "q").mapInArrow(run, kinds)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
