"""Wafer maps and process control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.scans import clamped_sums, decayed


def die_map(df: DataFrame, keys: list[str], value: str, bad: Column) -> DataFrame:
    """Mean and defect rate of each die position (of each wafer, if its key is given)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.count_if(bad) / F.count("*")).alias("defect_rate"), F.count("*").alias("n"))


def gallery(df: DataFrame, wafer: str, value: str, most: int = 25) -> DataFrame:
    """Die means of the first wafers of a gallery, in order of their key; the ranks run over the wafers alone."""
    wafers = df.select(wafer).distinct().orderBy(wafer).limit(most)
    return df.join(F.broadcast(wafers), wafer).groupBy(wafer, "die_x", "die_y").agg(F.avg(value).alias("mean"))


def radial_zones(df: DataFrame, centre: tuple[float, float], radius: float, edge: float = 0.97) -> DataFrame:
    """Zone of the normalised radius: centre to 0.5, middle to 0.8, outer to 1; and whether it lies in the edge ring."""
    r = F.sqrt(F.pow(F.col("die_x") - centre[0], F.lit(2)) + F.pow(F.col("die_y") - centre[1], F.lit(2))) / radius
    return df.withColumn("r", r).withColumns({"zone": F.when(F.col("r") <= 0.5, "centre").when(F.col("r") <= 0.8, "middle").when(F.col("r") <= 1.0, "outer").otherwise("outside"), "edge": F.col("r") > edge})


def grid_fit(df: DataFrame, source: str, quarter_turns: int = 0) -> DataFrame:
    """Coordinates from 0 within each source, turned so that the notch points down. The ends of each source come from a
    grouping, so that no task holds a source."""
    ends = df.groupBy(F.col(source).alias("_source")).agg(*[f(c).alias(f"_{n}_{c}") for c in ("die_x", "die_y") for n, f in (("min", F.min), ("max", F.max))])
    fit = df.join(ends, F.col(source).eqNullSafe(F.col("_source")), "left")
    x, y = F.col("die_x") - F.col("_min_die_x"), F.col("die_y") - F.col("_min_die_y")
    wide, high = F.col("_max_die_x") - F.col("_min_die_x"), F.col("_max_die_y") - F.col("_min_die_y")
    turned = [(x, y), (high - y, x), (wide - x, high - y), (y, wide - x)][quarter_turns % 4]
    return fit.select(*[F.col(c) for c in df.columns], turned[0].alias("grid_x"), turned[1].alias("grid_y"))


def capability(df: DataFrame, by: list[str], lot: str, value: str, low: float, high: float) -> DataFrame:
    """Cp and Cpk by the pooled deviation within lots, Ppk by the overall one."""
    lots = df.groupBy(*by, lot).agg(F.count(value).alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    sums = lots.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("k")).alias("within"), F.count("*").alias("lots"))
    mean = F.col("s") / F.col("n")
    sigma = F.sqrt(F.col("within") / (F.col("n") - F.col("lots")))
    overall = F.sqrt((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    side = F.least(F.lit(high) - mean, mean - F.lit(low))
    return sums.select(*by, "n", ((high - low) / (6 * sigma)).alias("cp"), (side / (3 * sigma)).alias("cpk"), (side / (3 * overall)).alias("ppk"))


def reference_lines(df: DataFrame, by: list[str], x: str, y: str, k: float = 3.0) -> DataFrame:
    """Mean plus and minus k deviations, and the linear fit of y on x with its R squared."""
    return df.groupBy(*by).agg((F.avg(y) - k * F.stddev(y)).alias("low"), F.avg(y).alias("mean"), (F.avg(y) + k * F.stddev(y)).alias("high"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def normalised(df: DataFrame, lot: str, value: str) -> DataFrame:
    """Deviation from the lot's mean in the lot's standard deviations; null for lots without spread."""
    w = Window.partitionBy(lot)
    return df.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev(value).over(w)))


def individuals(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """I-MR chart: limits of each tool by the mean moving range."""
    mr = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    return df.withColumn("mr", mr).groupBy(key).agg(F.avg(value).alias("centre"), F.avg("mr").alias("mr_bar")).withColumns({"lcl": F.col("centre") - 2.66 * F.col("mr_bar"), "ucl": F.col("centre") + 2.66 * F.col("mr_bar"), "mr_ucl": 3.267 * F.col("mr_bar")})


# A2, D3 and D4 of Xbar-R charts for subgroups of 2 to 10.
XBAR_R = [(2, 1.880, 0.0, 3.267), (3, 1.023, 0.0, 2.574), (4, 0.729, 0.0, 2.282), (5, 0.577, 0.0, 2.114), (6, 0.483, 0.0, 2.004), (7, 0.419, 0.076, 1.924), (8, 0.373, 0.136, 1.864), (9, 0.337, 0.184, 1.816), (10, 0.308, 0.223, 1.777)]


def xbar_r(df: DataFrame, key: str, subgroup: str, value: str) -> DataFrame:
    """Xbar-R limits of each tool and subgroup size."""
    groups = df.groupBy(key, subgroup).agg(F.count(value).cast("int").alias("size"), F.avg(value).alias("xbar"), (F.max(value) - F.min(value)).alias("range"))
    table = df.sparkSession.createDataFrame(XBAR_R, "size int, a2 double, d3 double, d4 double")
    sums = groups.groupBy(key, "size").agg(F.count("*").alias("subgroups"), F.avg("xbar").alias("centre"), F.avg("range").alias("r_bar"))
    return sums.join(F.broadcast(table), "size").select(key, "size", "subgroups", "centre", "r_bar", (F.col("centre") - F.col("a2") * F.col("r_bar")).alias("lcl"), (F.col("centre") + F.col("a2") * F.col("r_bar")).alias("ucl"), (F.col("d3") * F.col("r_bar")).alias("r_lcl"), (F.col("d4") * F.col("r_bar")).alias("r_ucl"))


def ewma(df: DataFrame, key: str, order: str, value: str, weight: float = 0.2, width: float = 3.0) -> DataFrame:
    """(key, n, last, n_out): the last EWMA of each key, from its mean, and its points outside of the limits. Exact, by stretches of a key's
    order; rows without a value or key don't count."""
    some = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    stats = some.groupBy(key).agg(F.avg("_v").alias("_mu"), F.coalesce(F.stddev("_v"), F.lit(0.0)).alias("_sd"))
    z = decayed(some.join(stats, key), key, "_o", "_v", "_mu", 1 - weight)
    limit = width * F.col("_sd") * F.sqrt(weight / (2 - weight) * (1 - F.pow(F.lit(1 - weight), 2 * F.col("_n"))))
    return z.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.max_by("_z", "_n").alias("last"), F.count_if(F.abs(F.col("_z") - F.col("_mu")) > limit).cast("int").alias("n_out"))


def cusum(df: DataFrame, key: str, order: str, value: str, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Largest upper and lower CUSUM of standardised values per key, and whether one passes h. Exact, by stretches of a key's order; rows
    without a value or key don't count, nor do keys whose values don't vary."""
    some = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    stats = some.groupBy(key).agg(F.avg("_v").alias("_mu"), F.stddev("_v").alias("_sd")).filter("_sd > 0")
    z = (F.col("_v") - F.col("_mu")) / F.col("_sd")
    return clamped_sums(some.join(stats, key), key, "_o", {"up": z - k, "down": -z - k}).withColumn("alarm", (F.col("up") > h) | (F.col("down") > h))


def western_electric(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with the four Western Electric rules, each true at the point that completes it."""
    all_, w = Window.partitionBy(key), Window.partitionBy(key).orderBy(*order)
    z = F.try_divide(F.col(value) - F.avg(value).over(all_), F.stddev(value).over(all_))
    df = df.withColumn("z", z)
    within = lambda least, n, sign: F.sum((F.col("z") * sign > least).cast("int")).over(w.rowsBetween(1 - n, 0))
    either = lambda least, n, k: (within(least, n, 1) >= k) | (within(least, n, -1) >= k)
    return df.withColumns({"rule1": F.abs("z") > 3, "rule2": (either(2, 3, 2)) & (F.abs("z") > 2), "rule3": (either(1, 5, 4)) & (F.abs("z") > 1), "rule4": either(0, 8, 8)})


def profile_similarity(df: DataFrame, unit: str, step: str, value: str) -> DataFrame:
    """Correlation and distance of each unit's profile over the steps with the mean profile."""
    golden = df.groupBy(step).agg(F.avg(value).alias("golden"))
    return df.groupBy(unit, step).agg(F.avg(value).alias("v")).join(F.broadcast(golden), step).groupBy(unit).agg(F.corr("v", "golden").alias("similarity"), F.sqrt(F.sum(F.pow(F.col("v") - F.col("golden"), F.lit(2)))).alias("distance"))


def kmeans(df: DataFrame, columns: list[str], k: int = 4, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_f", handleInvalid="skip").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(rows).transform(rows).drop("_f")


def before_after(df: DataFrame, event: str, time: str, by: str, value: str) -> DataFrame:
    """Means before and after a moment, and the shift, per tool."""
    after = F.col(time) >= F.lit(event).cast("timestamp")
    return df.groupBy(by).agg(F.avg(F.when(~after, F.col(value))).alias("before"), F.avg(F.when(after, F.col(value))).alias("after"), F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after")).withColumn("shift", F.col("after") - F.col("before"))


def quadratic(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares a + b x + c x^2 of each group from sums of powers (Cramer's rule)."""
    p = lambda k: F.sum(F.pow(F.col(x), F.lit(k)))
    t = lambda k: F.sum(F.pow(F.col(x), F.lit(k)) * F.col(y))
    s = df.groupBy(by).agg(F.count("*").cast("double").alias("s0"), *[p(k).alias(f"s{k}") for k in (1, 2, 3, 4)], *[t(k).alias(f"t{k}") for k in (0, 1, 2)])
    c = F.col

    def det(a: list[Column]) -> Column:
        return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])

    m = [c("s0"), c("s1"), c("s2"), c("s1"), c("s2"), c("s3"), c("s2"), c("s3"), c("s4")]
    put = lambda col: det([c(f"t{i // 3}") if i % 3 == col else m[i] for i in range(9)])
    return s.select(by, F.try_divide(put(0), det(m)).alias("a"), F.try_divide(put(1), det(m)).alias("b"), F.try_divide(put(2), det(m)).alias("c"))
