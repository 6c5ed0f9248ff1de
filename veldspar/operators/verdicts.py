"""Statistical comparisons between groups of lots, and graded verdicts.

Statistics are distributed aggregates; tail probabilities are evaluated by an Arrow UDF on the few result rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veldspar.operators.scans import exact_quantiles
from veldspar.sources.scratch import shared_folder


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(-x / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return (front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b) if 0 < x < 1 else float(x >= 1)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None or a != a or b != b or b <= 0 else t_two_sided(abs(a), b) for a, b in zip(t, df, strict=True)], dtype="float64")


def permutation_test(lots: DataFrame, group: str, value: str, lot: str, rounds: int = 2000, seed: int = 7, most_lots: int = 1_000_000) -> DataFrame:
    """Lots of two groups, A and B: how many of ``rounds`` random assignments of the lots to groups of these sizes differ
    as much in their means. A round's assignment follows from the seed, the round and the lots' order alone. Lots are
    few next to rows: up to ``most_lots`` go to the tasks, each of which does some rounds; more raise an error. Lots
    without a value take part and don't count in the means."""
    spark = lots.sparkSession
    kept = lots.select(F.col(lot).alias("lot"), F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    table = kept.orderBy("lot", "g", "x").limit(most_lots + 1).toPandas()
    if len(table) > most_lots:
        raise ValueError(f"more than {most_lots} lots")
    x, n_a = table["x"].to_numpy(np.float64), int((table["g"] == "A").sum())
    mean = lambda v: float(np.nanmean(v)) if len(v) and not np.isnan(v).all() else None
    sides = [mean(x[(table["g"] == side).to_numpy()]) for side in "AB"]
    observed = None if None in sides else sides[0] - sides[1]
    shared = spark.sparkContext.broadcast(x)

    def run(batches):
        for batch in batches:
            large = 0
            for k in batch.column(0).to_pylist():
                turned = np.random.default_rng([seed, k]).permutation(shared.value)
                a, b = mean(turned[:n_a]), mean(turned[n_a:])
                large += a is not None and b is not None and abs(a - b) >= abs(observed) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array([large], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["large", "n"])

    done = spark.range(rounds if observed is not None else 0).mapInArrow(run, "large long, n long")
    as_large, n = F.coalesce(F.sum("large"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    return done.agg(F.lit(observed).cast("double").alias("observed"), as_large.alias("as_large"), n.alias("rounds")).withColumn("p_value", (F.col("as_large") + 1) / (F.col("rounds") + 1))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def effect_size(lots: DataFrame, group: str, value: str, spec_width: float) -> DataFrame:
    """Difference of the group means A - B in deviations between lots and as a percentage of the specification's width."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    out = lots.agg(side("A", F.avg).alias("mean_a"), side("B", F.avg).alias("mean_b"), side("A", F.var_samp).alias("va"), side("B", F.var_samp).alias("vb"), side("A", F.count).alias("n_a"), side("B", F.count).alias("n_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("va") + (F.col("n_b") - 1) * F.col("vb")) / (F.col("n_a") + F.col("n_b") - 2))
    return out.select("mean_a", "mean_b", "n_a", "n_b", ((F.col("mean_a") - F.col("mean_b")) / pooled).alias("effect"), (100 * (F.col("mean_a") - F.col("mean_b")) / spec_width).alias("percent_of_spec"))


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t between groups A and B, its degrees of freedom and p-value."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.agg((side("A", F.avg) - side("B", F.avg)).alias("diff"), (side("A", F.var_samp) / side("A", F.count)).alias("a"), (side("B", F.var_samp) / side("B", F.count)).alias("b"), side("A", F.count).alias("na"), side("B", F.count).alias("nb"))
    t = F.col("diff") / F.sqrt(F.col("a") + F.col("b"))
    dof = F.pow(F.col("a") + F.col("b"), F.lit(2)) / (F.pow("a", F.lit(2)) / (F.col("na") - 1) + F.pow("b", F.lit(2)) / (F.col("nb") - 1))
    return s.select("diff", t.alias("t"), dof.alias("df")).withColumn("p_value", t_p_value("t", "df"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F with its mean squares, and the lot variance share (ICC) that follows from them. Rows without a value or a group
    don't count."""
    g = moments(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()), [group], value)
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("mean")).alias("sm"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("smm"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    msb = (F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")) / (F.col("k") - 1)
    msw = F.col("ssw") / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    return s.select("n", "k", msb.alias("ms_between"), msw.alias("ms_within"), (msb / msw).alias("f"), ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties averaged; rows without a value go. Distinct values are counted and dealt by range, summed in order
    within each range, and each range adds the sizes of those before it, so no task holds all values."""
    spark = df.sparkSession
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    path = shared_folder(spark, "ranks")
    counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.schema(f"`{value}` {df.schema[value].dataType.simpleString()}, _c long, _part int").parquet(path)
    sizes = counts.groupBy("_part").agg(F.sum("_c").alias("_n"))  # a row a range
    earlier = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    w = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(F.broadcast(earlier), "_part").withColumn(name, F.col("_before") + F.sum("_c").over(w) - (F.col("_c") - 1) / 2)
    return df.join(ranks.select(value, name), value)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H, without and with the correction for ties. Rows without a value or a group don't count."""
    df = df.select(group, value).filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    r = average_ranks(df, value, "_r")
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    s = g.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("x"))
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("x") - 3 * (F.col("n") + 1)
    return s.join(F.broadcast(ties)).select(h.alias("h"), (h / (1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n")))).alias("h_corrected"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """From the occupied cells alone: chi2 = n * (sum of o * o / (r * c) - 1). Rows without one of the categories don't count."""
    cells = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a is not null and _b is not null").groupBy("_a", "_b").agg(F.count("*").alias("_o"))
    rows, cols = cells.groupBy("_a").agg(F.sum("_o").alias("_r")), cells.groupBy("_b").agg(F.sum("_o").alias("_c"))
    sums = cells.join(rows, "_a").join(cols, "_b").agg(F.sum("_o").alias("n"), F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("s"), F.countDistinct("_a").alias("x"), F.countDistinct("_b").alias("y"))
    return sums.select((F.col("n") * (F.col("s") - 1)).alias("chi2"), ((F.col("x") - 1) * (F.col("y") - 1)).alias("df"))


def regression_f(df: DataFrame, x: str, y: str) -> DataFrame:
    r2, n = F.regr_r2(y, x), F.regr_count(y, x)
    return df.agg((r2 / (1 - r2) * (n - 2)).alias("f"), n.alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    return r.agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def equivalence(df: DataFrame, group: str, value: str, delta: float) -> DataFrame:
    """TOST: the two one-sided Welch statistics against -delta and +delta."""
    w = welch(df, group, value)
    se = F.col("diff") / F.col("t")
    return w.select("diff", ((F.col("diff") + delta) / se).alias("t_low"), ((F.col("diff") - delta) / se).alias("t_high"), "df")


def corrected(tests: DataFrame, family: str, p: str = "p") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg p-values within each family."""
    w = Window.partitionBy(family)
    up = w.orderBy(p)
    m = F.count("*").over(w)
    raw = F.col(p) * m / F.rank().over(up)
    return tests.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * m)).withColumn("_raw", raw).withColumn("bh", F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def minimum_size(lots: DataFrame, group: str, lot: str, least: int = 5) -> DataFrame:
    return lots.groupBy(group).agg(F.countDistinct(lot).alias("lots")).withColumn("enough", F.col("lots") >= least)


def confounding(df: DataFrame, group: str, factor: str, limit: float = 20.0) -> DataFrame:
    """Largest difference, in points, between the two groups' shares of a factor's levels."""
    counts = df.groupBy(group, factor).agg(F.count("*").alias("n"))
    share = counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    wide = share.groupBy(factor).agg(F.sum(F.when(F.col(group) == "A", F.col("share")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(group) == "B", F.col("share")).otherwise(0.0)).alias("b"))
    return wide.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("difference")).withColumn("confounded", F.col("difference") >= limit)


def stratified(df: DataFrame, stratum: str, group: str, value: str) -> DataFrame:
    """Whether at least two thirds of the strata share the sign of the weighted mean difference."""
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(stratum).agg((side("A", F.avg) - side("B", F.avg)).alias("diff"), F.least(side("A", F.count), side("B", F.count)).alias("w")).filter("w > 0")
    total = s.agg((F.sum(F.col("diff") * F.col("w")) / F.sum("w")).alias("weighted"))
    return s.join(F.broadcast(total)).agg(F.first("weighted").alias("weighted"), F.count("*").alias("strata"), F.count_if(F.signum("diff") == F.signum("weighted")).alias("same_sign")).withColumn("kept", F.col("same_sign") * 3 >= F.col("strata") * 2)


def replication(df: DataFrame, time: str, group: str, value: str, share: float = 0.7) -> DataFrame:
    """Welch's test on the last 30 % of the period, with the direction before it."""
    times = df.select(F.unix_timestamp(time).alias("t"))
    cut = exact_quantiles(times, [], "t", [share]).select(F.col("q")[0].alias("cut"))
    part = df.join(F.broadcast(cut)).withColumn("tail", F.unix_timestamp(time) > F.col("cut"))
    head = welch(part.filter("not tail"), group, value).select(F.col("diff").alias("head_diff"))
    return welch(part.filter("tail"), group, value).join(F.broadcast(head)).withColumn("replicated", (F.signum("diff") == F.signum("head_diff")) & (F.col("p_value") < 0.05))


def power(effects: DataFrame, z_alpha: float = 1.959964) -> DataFrame:
    """Power of effects (effect, n_a, n_b) by the normal approximation."""
    z = F.abs("effect") / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b")) - z_alpha
    return effects.withColumn("power", normal_cdf(z)).withColumn("enough", F.col("power") >= 0.8)


def grades(checks: DataFrame) -> DataFrame:
    """checks: claim, p, effect, against, withheld, missing (checks that failed or lack data). strong, moderate, weak,
    against or withheld; one missing check caps at moderate, more at weak."""
    g = F.when(F.col("withheld"), "withheld").when(F.col("against"), "against").when((F.col("p") < 0.01) & (F.abs("effect") >= 0.8), "strong").when((F.col("p") < 0.05) & (F.abs("effect") >= 0.5), "moderate").otherwise("weak")
    capped = F.when((g == "strong") & (F.col("missing") == 1), "moderate").when(g.isin("strong", "moderate") & (F.col("missing") > 1), "weak").otherwise(g)
    return checks.withColumn("grade", capped)


def looks(ledger: DataFrame) -> DataFrame:
    """How many different questions were asked of each bundle: distinct (measure, split, scope)."""
    return ledger.groupBy("bundle").agg(F.countDistinct("measure", "split", "scope").alias("m"))


def paired(df: DataFrame, lot: str, group: str, value: str) -> DataFrame:
    """Split lots: t of the paired differences A - B of lots that have both."""
    side = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    pairs = df.groupBy(lot).agg(side("A").alias("a"), side("B").alias("b")).filter("a is not null and b is not null")
    return pairs.agg(F.count("*").alias("lots"), F.avg(F.col("a") - F.col("b")).alias("diff"), (F.avg(F.col("a") - F.col("b")) / (F.stddev(F.col("a") - F.col("b")) / F.sqrt(F.count("*")))).alias("t"))


def aliased(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether each level of either factor occurs with one level of the other alone."""
    pairs = df.select(a, b).distinct()
    return pairs.agg((F.count("*") == F.countDistinct(a)).alias("a_fixes_b"), (F.count("*") == F.countDistinct(b)).alias("b_fixes_a")).withColumn("aliased", F.col("a_fixes_b") & F.col("b_fixes_a"))


def small_categories(df: DataFrame, category: str, least: int = 30) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n")).withColumn("small", F.col("n") < least)


def nested_gap(df: DataFrame, lot: str, group: str, value: str) -> DataFrame:
    """The same t by rows and by lots: rows of a lot aren't independent."""
    lots = df.groupBy(lot, group).agg(F.avg(value).alias(value))
    return welch(df, group, value).select(F.col("t").alias("t_rows")).join(F.broadcast(welch(lots, group, value).select(F.col("t").alias("t_lots"))))


def cache_key(spec: Column, data_version: Column, filters: Column) -> Column:
    return F.sha2(F.to_json(F.struct(spec.alias("spec"), data_version.alias("version"), filters.alias("filters"))), 256)
