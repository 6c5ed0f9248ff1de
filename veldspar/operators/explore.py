"""Filters, column edits, profiles, samples, markings."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.scans import exact_quantiles


def all_of(*parts: Column) -> Column:
    """The AND of a set of filter fragments; true for none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def between(column: str, low, high) -> Column:
    return (F.col(column) >= low) & (F.col(column) <= high)


def contains(column: str, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is in a pasted list: a predicate for short lists, a semi join for long ones."""
    if len(values) <= 100:
        return df.filter(F.col(column).isin(values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], [column]).distinct()
    return df.join(keys, column, "left_semi")


def edited(df: DataFrame, rename: dict | None = None, cast: dict | None = None, replace: dict | None = None, drop: tuple = ()) -> DataFrame:
    """Column edits in this order: replacement of values, casts that give null for bad values, drops, new names."""
    for c, values in (replace or {}).items():
        df = df.withColumn(c, F.coalesce(*[F.when(F.col(c) == a, F.lit(b)) for a, b in values.items()], F.col(c)))
    for c, kind in (cast or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(kind))
    return df.drop(*drop).withColumnsRenamed(rename or {})


def profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row a numeric column: its type, rows, missing share, min, max, mean, sd, quartiles, distinct values. Exact quartiles and distinct
    values come from the counted values of all columns, dealt by range, so no task holds a column."""
    kinds = dict(df.dtypes)
    quartiles = lambda c: F.array(*[F.lit(None).cast("double")] * 3) if exact else F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.count("*").alias("n"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias("missing"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"), *[quartiles(c)[i].cast("double").alias(f"q{i + 1}") for i in range(3)], F.approx_count_distinct(c).alias("n_distinct")).alias(c) for c in columns]
    rows = df.agg(*one).select(F.explode(F.array(*columns)).alias("p")).select("p.*")
    if not exact:
        return rows
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*")
    counted = values.filter("v is not null").distinct().groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    found = exact_quantiles(values, ["column_name"], "v", [0.25, 0.5, 0.75]).select("column_name", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    plain = rows.drop("n_distinct", "q1", "q2", "q3").join(F.broadcast(counted), "column_name", "left").join(F.broadcast(found), "column_name", "left")  # a row a column
    return plain.fillna(0, ["n_distinct"]).select(*rows.columns)


def roles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, role): key, time, coordinate, spec, bin, category or measure, by type, name and number of values."""
    kinds = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.when(F.lit(kinds[c] in ("timestamp", "date")), "time").when(F.lit(c.lower().endswith(("_x", "_y"))), "coordinate").when(F.lit(bool(re.search(r"(^|_)(spec|lsl|usl|target)(_|$)", c.lower()))), "spec").when(F.lit("bin" in c.lower()), "bin").when(F.col(f"d_{c}") >= 0.95 * F.col("n"), "key").when(F.lit(kinds[c] == "string") | (F.col(f"d_{c}") <= 50), "category").otherwise("measure").alias("role")) for c in columns]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_rows(df: DataFrame, keys: list[str], n: int = 200, seed: int = 1) -> DataFrame:
    """n rows that depend on their keys and the seed alone, not on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def sample_share(df: DataFrame, keys: list[str], percent: int = 1, seed: int = 1, least: int = 20_000, kept: Column | None = None) -> DataFrame:
    """The rows whose key hash falls into ``percent`` of 100 buckets; all rows where fewer than ``least`` sampled ones
    pass the filter ``kept``."""
    part = df.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(100)) < percent)
    kept = F.lit(True) if kept is None else kept
    return part.filter(kept) if part.filter(kept).limit(least).count() == least else df.filter(kept)


def facets(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """(facet, value, n, low, high): rows per category value, and the range of each number."""
    counted = df.select(*[F.col(c).cast("string").alias(c) for c in categories]).unpivot([], categories, "facet", "value").groupBy("facet", "value").agg(F.count("*").alias("n")).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    ranges = df.agg(*[F.struct(F.lit(c).alias("facet"), F.lit(None).cast("string").alias("value"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in numbers]).select(F.explode(F.array(*numbers)).alias("f")).select("f.*")
    return counted.union(ranges)


def marked_counts(df: DataFrame, by: list[str], mark: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(mark).alias("n_marked"))


def frozen_keys(df: DataFrame, mark: Column, keys: list[str]) -> DataFrame:
    """The keys that a marking holds now; apply it later with within()."""
    return df.filter(mark).select(*keys).distinct()


def within(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_semi")


def marking_drift(df: DataFrame, mark: Column, kept: Column) -> DataFrame:
    """Rows that a predicate marks before and after a filter."""
    return df.agg(F.count_if(mark).alias("n_before"), F.count_if(mark & kept).alias("n_after")).withColumn("changed", F.col("n_before") != F.col("n_after"))


def two_groups(df: DataFrame, a: DataFrame, b: DataFrame, label: str = "mark") -> DataFrame:
    """df with label A or B by two key sets (A first); other rows go."""
    keys = a.withColumn(label, F.lit("A")).union(b.join(a, a.columns, "left_anti").withColumn(label, F.lit("B")))
    return df.join(keys, a.columns)


def latest(df: DataFrame, order: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """The n latest rows, overall or for each key."""
    if not by:
        return df.orderBy(order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def top_categories(df: DataFrame, column: str, n: int = 12, other: str = "other") -> DataFrame:
    """Rows per category for the n largest (ties by name; null is a category) and for all others together, in a row of
    its own even where a category has the name ``other``."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    top = counts.orderBy(F.desc("c"), column).limit(n).select(F.col(column).alias("_k"), F.lit(True).alias("_top"))
    marked = counts.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_k")), "left")  # n rows
    return marked.groupBy(F.col("_top"), F.when(F.col("_top"), F.col(column)).otherwise(other).alias("category")).agg(F.sum("c").alias("n")).drop("_top")


def size_regime(rows: int) -> str:
    """exact up to 1M rows, exact on release up to 10M, approximate beyond."""
    return "exact" if rows <= 1_000_000 else "on_release" if rows <= 10_000_000 else "approximate"
