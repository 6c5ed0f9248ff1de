"""Exact quantiles and ordered recursions without a task that holds all values of a group.

Rows are dealt by range, so that each range is a stretch of the order; a summary of every stretch, combined in order, tells each of them
what went before. The ranges are written once into the shared folder, as their bounds come from a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from veldspar.sources.scratch import shared_folder


def _ranged(df: DataFrame, *by: str) -> DataFrame:
    """df with the number of its range (_part)."""
    path, spark = shared_folder(df.sparkSession, "ranges"), df.sparkSession
    dealt = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., n, q array<double>): interpolated quantiles of the values of each group, nulls aside; groups without a value have null
    ones. Distinct values are counted first; each range of them learns how many values its group has before."""
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    groups = named.select(*keys).distinct() if by else None
    counts = _ranged(named.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count("*").alias("_c")), *keys, "_v")
    sizes = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))  # a row a group and range
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    earlier = sizes.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.col("_part").alias("_epart"), (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys], F.col("_part") == F.col("_epart"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(earlier, same).withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
    place = lambda p: F.lit(p) * (F.col("_all") - 1)
    at = lambda rank: (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
    ends = [[F.max(F.when(at(f(place(p))), F.col("_v").cast("double"))).alias(f"_{name}{i}") for name, f in (("a", F.floor), ("b", F.ceil))] for i, p in enumerate(shares)]
    needed = reduce(Column.__or__, [at(f(place(p))) for p in shares for f in (F.floor, F.ceil)])
    found = ranked.filter(needed).groupBy(*keys).agg(F.max("_all").alias("n"), *[c for pair in ends for c in pair])
    part = [place(p) - F.floor(place(p)) for p in shares]
    q = F.array(*[F.col(f"_a{i}") + x * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, x in enumerate(part)])
    result = found.withColumn("_all", F.col("n")).select(*keys, "n", q.alias("q"))
    if not by:
        return result
    own = result.select(*[F.col(k).alias(f"_e{k}") for k in keys], "n", "q")
    matched = groups.join(own, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys]), "left")
    return matched.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.coalesce("n", F.lit(0)).alias("n"), "q")


def in_blocks(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """df with a number of its block (_block) and its place there from 1 (_r): blocks are stretches of a key's order of at most so many
    rows, with ascending numbers."""
    place = F.row_number().over(Window.partitionBy("_part", key).orderBy(order)) - 1
    dealt = _ranged(df, key, order).withColumn("_at", place)
    return dealt.select(*df.columns, (F.col("_part").cast("long") * (1 << 40) + F.floor(F.col("_at") / size)).alias("_block"), (F.col("_at") % size + 1).alias("_r"))


_NONE = object()


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)  # NaN is a key, too


def _by_blocks(sums: DataFrame, key: str, fold: Callable[[Iterator[tuple]], Iterator[tuple]], kinds: StructType) -> DataFrame:
    """fold over the rows of sums by key and block, a stream a task: a call for each key would cost far more than its few blocks. Null
    keys don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fold(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while some := list(islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], kinds.names)

    return sums.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "_block").mapInArrow(run, kinds)


def block_size(keep: float, most: int = 1024) -> int:
    """Rows of a block in which keep ** -rows stays far from overflow."""
    return most if keep <= 0 or keep >= 1 else max(1, min(most, int(230 / -np.log(keep))))


def decayed(df: DataFrame, key: str, order: str, value: str, start: str, keep: float) -> DataFrame:
    """df, whose values aren't null, with the recursion z = keep * z + (1 - keep) * value along the order (_z), from the value of the column start,
    and each row's number (_n). A block turns z into keep ** rows * z + its own weighted sum."""
    blocks = in_blocks(df, key, order, block_size(keep))
    rows = Window.partitionBy(key, "_block").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    weight = lambda n: F.pow(F.lit(keep), n) if keep > 0 else F.lit(0.0)
    own = blocks.withColumn("_own", weight(F.col("_r")) * F.sum((1 - keep) * F.col(value) / weight(F.col("_r"))).over(rows)) if keep > 0 else blocks.withColumn("_own", F.col(value).cast("double"))
    sums = own.groupBy(key, "_block").agg(F.max("_r").alias("rows"), F.max_by("_own", "_r").alias("own"), F.min_by(start, "_r").cast("double").alias("start"))

    def carry(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, z, n = _NONE, 0.0, 0
        for k, block, size, own, first in rows:
            if not _same(k, last):
                last, z, n = k, first, 0
            yield k, block, z, n
            z, n = keep**size * z + own, n + size

    kinds = StructType([df.schema[key], StructField("_block", LongType()), StructField("_in", DoubleType()), StructField("_before", LongType())])
    into = _by_blocks(sums, key, carry, kinds)  # one row a block
    return own.join(into, [key, "_block"]).select(*df.columns, (weight(F.col("_r")) * F.col("_in") + F.col("_own")).alias("_z"), (F.col("_before") + F.col("_r")).alias("_n"))


def clamped_sums(df: DataFrame, key: str, order: str, steps: dict[str, Column], most: int = 1024) -> DataFrame:
    """(key, one column a step): the largest value of the recursion c = max(0, c + step) along the order, from 0. A block turns c into max(c + its
    sum, its own end), and its largest value is max(c + its largest sum, its own largest)."""
    names = list(steps)
    with_steps = df.select(key, order, *[x.cast("double").alias(f"_y_{n}") for n, x in steps.items()])
    blocks = in_blocks(with_steps, key, order, most)
    rows = Window.partitionBy(key, "_block").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.withColumns({f"_s_{n}": F.sum(f"_y_{n}").over(rows) for n in steps})
    own = sums.withColumns({f"_d_{n}": F.col(f"_s_{n}") - F.min(f"_s_{n}").over(rows) for n in steps})
    four = [f.alias(f"{name}_{n}") for n in steps for name, f in (("sum", F.max_by(f"_s_{n}", "_r")), ("end", F.max_by(f"_d_{n}", "_r")), ("top", F.max(f"_s_{n}")), ("own", F.max(f"_d_{n}")))]
    summed = own.groupBy(key, "_block").agg(*four)

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, now = _NONE, []
        for k, _, *values in rows:
            if not _same(k, last):
                if last is not _NONE:
                    yield (last, *(best for best, _ in now))
                last, now = k, [(0.0, 0.0)] * len(names)
            now = [(max(best, c + top, own), max(c + total, end)) for (best, c), (total, end, top, own) in zip(now, zip(*[iter(values)] * 4, strict=True), strict=True)]
        if last is not _NONE:
            yield (last, *(best for best, _ in now))

    kinds = StructType([df.schema[key], *[StructField(n, DoubleType()) for n in steps]])
    return _by_blocks(summed, key, fold, kinds)  # one row a block
