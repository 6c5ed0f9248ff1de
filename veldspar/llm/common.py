"""Shared helpers: tables in the cluster's shared folder, size-checked broadcasts, components, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own_roots.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own_roots[app] = root
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # what a writer holds in memory
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let tasks hand texts to Python in batches of so many rows, in place of Spark's 10,000, unless the cluster's
    configuration names a number: a task's buffers, in the JVM and in Python, hold a batch each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, rows)


def bounded_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows fit limit_bytes, otherwise df as it is (Spark then shuffles the join).

    df should be a written table: its rows are counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose given column holds about max_bytes at most (one row may hold more)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        share = batch.column(batch.schema.get_field_index(column)).nbytes / n
        at = 0
        while at < n:
            step = max(1, min(n - at, max_rows, int(max_bytes / max(share, 1.0))))
            part = batch.slice(at, step)
            while step > 1 and _used(part.column(part.schema.get_field_index(column))) > 2 * max_bytes:
                step = max(1, step // 2)
                part = batch.slice(at, step)
            yield part
            at += step


def trim() -> None:
    """Give memory that was freed back to the system: Python workers go on to other tasks beside a JVM of fixed size."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _used(column: pa.Array) -> int:
    """Bytes of the slice's own values."""
    return column.nbytes


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of edges (a, b) reaches; a and b are longs without nulls.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edges stay the same.
    Every round is a written table, so a lost executor costs one round at most."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(df: DataFrame, both: DataFrame, keep) -> DataFrame:
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(low, "a").filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))

    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(now, both, F.col("b") > F.col("a")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = written(small, "edges")
        if (is_now := state(now)) == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root")).union(
        now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("v"), F.col("b").alias("root"))
    )


class WordIds(dict):
    """Word -> bucket of its CRC-32 without surrounding punctuation; looked-up words are kept, up to a bound.

    Words that are punctuation alone have bucket 0, which no other word has."""

    #: Stripped from both ends of a word.
    EDGES = ".,;:!?\"'()[]{}<>|*#$%&+-_=/\\~`^…–—“”„«»"

    def __init__(self, buckets: int, most: int = 150_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(self.EDGES)
        bucket = 1 + zlib.crc32(bare.encode("utf-8", "surrogatepass")) % (self.buckets - 1) if bare else 0
        if len(word) <= 64:
            self[word] = bucket
        return bucket

    def of(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all texts of an Arrow column, one after the other, and the offsets of each text's first."""
        each = [self.of(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) for x in each], out=offsets[1:])
        return (np.concatenate(each) if each else np.zeros(0, np.int32)), offsets


def minimise(rows: DataFrame, gradient, start: np.ndarray, steps: int = 80, rate: float = 0.2, l2: np.ndarray | float = 1e-3) -> np.ndarray:
    """Full-batch Adam: every step is a Spark job that sums gradient(parameters, batch) over the partitions of rows.

    gradient returns an array of the parameters' size. The driver holds that array once a partition; rows should be a
    written table of bounded size, in few partitions. The mean gradient gets l2 * parameters added."""
    spark, x = rows.sparkSession, start.astype(np.float64).copy()
    n = rows.count()
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1 if n else 1):
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value))
            for batch in batches:
                total += gradient(shared.value, batch)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

        g = sum(np.frombuffer(r.g) for r in rows.mapInArrow(run, "g binary").toLocalIterator()) / n + l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        shared.unpersist()
    return x


def newton(rows: DataFrame, derivatives, size: int, steps: int = 15, l2: float = 1e-3) -> np.ndarray:
    """Newton's method from zero for a convex loss: every step is a Spark job that sums derivatives(parameters, batch) =
    (loss, gradient, Hessian) over the partitions of rows, a written table in few partitions. The mean
    loss gets l2 / 2 * |parameters| ** 2 added. A step that doesn't lower the loss is halved."""
    spark, n = rows.sparkSession, rows.count()

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                loss, g, h = derivatives(shared.value, batch)
                total += np.concatenate(([loss], g, h.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["d"])

        d = sum(np.frombuffer(r.d) for r in rows.mapInArrow(run, "d binary").collect()) / n  # a row a partition
        shared.unpersist()
        return d[0] + l2 / 2 * float(x @ x), d[1 : 1 + size] + l2 * x, d[1 + size :].reshape(size, size) + l2 * np.eye(size)

    x = np.zeros(size)
    if not n:
        return x
    loss, g, h = at(x)
    scale = 1.0
    step = np.linalg.solve(h, g)
    for _ in range(steps):
        new = at(x - scale * step)
        if new[0] > loss + 1e-12:
            scale /= 2
            continue
        gain, x = loss - new[0], x - scale * step
        loss, g, h = new
        if gain < 1e-7:
            break
        scale, step = 1.0, np.linalg.solve(h, g)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x, np.float64) / 2))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The rows of df with the smallest hashes of the key, ``rows`` of them at most: bounded, and the same wherever and
    however often it runs. Only for fitting a model on labelled rows."""
    return df.withColumn("_order", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_order", key).limit(rows).drop("_order")
