"""Group aggregates, box statistics, pivots, bins, decimation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.scans import exact_quantiles

#: The aggregate set by name.
AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "sd": F.stddev, "var": F.variance, "unique": F.countDistinct, "se": lambda c: F.stddev(c) / F.sqrt(F.count(c)),
}

#: Quantiles by name; p and a number is that percentile, as p10 or p99.5.
QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}
NAMES = [*AGGREGATES, *QUANTILES, "p10", "p90"]


def percentile(name: str) -> float | None:
    """The share that a name stands for, if it is a quantile's."""
    if name in QUANTILES or name in AGGREGATES:
        return QUANTILES.get(name)
    share = float(name[1:]) / 100 if name[:1] == "p" and name[1:].replace(".", "", 1).isdigit() else -1.0
    if not 0 <= share <= 1:
        raise ValueError(f"no aggregate is called {name}")
    return share


def group_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def aggregated(df: DataFrame, by: list[str], column: str, names: list[str]) -> DataFrame:
    """The named aggregates of each group; quantiles are exact and held by no single task."""
    shares = {n: p for n in names if (p := percentile(n)) is not None}
    plain = df.groupBy(*by).agg(*[AGGREGATES[n](column).alias(n) for n in names if n not in shares] or [F.count("*").alias("_rows")])
    if not shares:
        return plain
    q = exact_quantiles(df, by, column, list(shares.values())).select(*[F.col(b).alias(f"_q_{b}") for b in by], *[F.col("q")[i].alias(n) for i, n in enumerate(shares)])
    same = [F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in by] or [F.lit(True)]
    return plain.join(q, same, "left").select(*by, *[F.col(f"`{n}`") for n in names])


def box(df: DataFrame, by: list[str], column: str, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quartiles, n and the fences 1.5 interquartile ranges out, of each group."""
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    if exact:
        out = exact_quantiles(df, by, column, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    else:
        out = df.groupBy(*by).agg(F.count(column).alias("n"), F.percentile_approx(column, shares, F.lit(accuracy)).alias("_q"))
    out = out.select(*by, "n", *[F.col("_q")[i].cast("double").alias(f"q{i + 1}") for i in range(3)])
    return out.withColumns({"fence_low": 2.5 * F.col("q1") - 1.5 * F.col("q3"), "fence_high": 2.5 * F.col("q3") - 1.5 * F.col("q1")})


def whiskers(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """box() with the outermost values inside of the fences and the numbers of values beyond them."""
    b = box(df, by, column)
    inside = F.col(column).between(F.col("fence_low"), F.col("fence_high"))
    ends = df.join(b, by).groupBy(*by).agg(F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high"), F.count_if(F.col(column) < F.col("fence_low")).alias("n_below"), F.count_if(F.col(column) > F.col("fence_high")).alias("n_above"))
    return b.join(ends, by)


def outliers(df: DataFrame, by: list[str], column: str, ids: list[str], most: int = 200) -> DataFrame:
    """The ``most`` farthest values on each side of each group's fences."""
    beyond = df.join(box(df, by, column), by).withColumn("side", F.when(F.col(column) > F.col("fence_high"), "high").when(F.col(column) < F.col("fence_low"), "low")).filter("side is not null")
    far = F.when(F.col("side") == "high", -F.col(column)).otherwise(F.col(column))
    w = Window.partitionBy(*by, "side").orderBy(far, *ids)
    return beyond.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(*by, *ids, column, "side")


def lot_fold(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean and n of each lot (and wafer): the level at which groups are compared."""
    return df.groupBy(*keys).agg(F.avg(column).alias("lot_mean"), F.count(column).alias("n"))


def lots_below(df: DataFrame, category: str, lot: str, wafer: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), F.countDistinct(lot).alias("n_lot"), F.countDistinct(lot, wafer).alias("n_wafer"))


def cross_table(df: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    """One aggregate by row and the given column values; without a scan for the values."""
    return df.groupBy(row).pivot(column, values).agg(value)


def pivot_conditional(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(measure))).alias(f"{column}_{v}") for v in values])


def unpivoted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, "variable", "value")


def even_bins(column: str, low: float, width: float) -> Column:
    return F.floor((F.col(column) - low) / width).cast("int")


def limit_bins(column: str, limits: list[float]) -> Column:
    """0 below the first limit, k from the k-th limit on; null stays null."""
    out = F.when(F.col(column).isNull(), None)
    for k, limit in enumerate(limits):
        out = out.when(F.col(column) < limit, k)
    return out.otherwise(len(limits))


def density(df: DataFrame, x: str, y: str, xr: tuple[float, float], yr: tuple[float, float], cells: int = 256) -> DataFrame:
    """Counts on a grid over a range (zooming gives another range), with log1p of the count."""
    cell = lambda c, r: F.least(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * cells), F.lit(cells - 1)).cast("int")
    return df.filter(F.col(x).between(*xr) & F.col(y).between(*yr)).groupBy(cell(x, xr).alias("gx"), cell(y, yr).alias("gy")).agg(F.count("*").alias("n")).withColumn("weight", F.log1p("n"))


def decimated(df: DataFrame, time: str, value: str, first: str, seconds: int, key: str) -> DataFrame:
    """Min, max and their times of each stretch of time (a pixel column)."""
    column = F.floor((F.unix_timestamp(time) - F.unix_timestamp(F.lit(first).cast("timestamp"))) / seconds).cast("int")
    return df.groupBy(column.alias("pixel")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(time, F.struct(F.col(value), F.col(key))).alias("low_at"), F.max_by(time, F.struct(F.col(value), F.col(key))).alias("high_at"))


def pareto(df: DataFrame, category: str) -> DataFrame:
    """Counts with cumulative shares, largest first; the window runs over the counts alone."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    w = Window.orderBy(F.desc("n"), category).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(F.broadcast(total)).select(category, "n", (F.sum("n").over(w) / F.col("total")).alias("cumulative"))


def shares(df: DataFrame, group: str, part: str) -> DataFrame:
    counts = df.groupBy(group, part).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def subtotals(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    return df.rollup(a, b).agg(F.grouping_id().alias("level"), F.sum(value).alias("total"), F.count("*").alias("n"))


def trellis(df: DataFrame, panels: list[str], by: str, value: str) -> DataFrame:
    """Group means per panel with the value range that all panels share."""
    ends = df.agg(F.min(value).alias("axis_low"), F.max(value).alias("axis_high"))
    return df.groupBy(*panels, by).agg(F.avg(value).alias("mean")).join(F.broadcast(ends))


def trend(df: DataFrame, time: str, unit: str, group: str, value: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, time).alias("bucket"), group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def session_totals(messages: DataFrame) -> DataFrame:
    """Per session: tokens, cost, the last agent, and the last assistant model, else the first user model. messages:
    session, seq, role, agent, model, tokens struct<input, output, reasoning, cache struct<read, write>>, cost."""
    mine = F.col("role") == "assistant"
    total = lambda c: F.coalesce(F.sum(F.when(mine, c)), F.lit(0))
    last = lambda v, ok: F.max_by(v, F.when(ok & F.col(v).isNotNull(), F.col("seq")))
    return messages.groupBy("session").agg(
        total(F.col("tokens.input")).alias("tokens_in"), total(F.col("tokens.output")).alias("tokens_out"), total(F.col("tokens.reasoning")).alias("reasoning"),
        total(F.coalesce(F.col("tokens.cache.read"), F.lit(0)) + F.coalesce(F.col("tokens.cache.write"), F.lit(0))).alias("cache"), total(F.col("cost")).alias("cost"),
        last("agent", F.lit(True)).alias("agent"), F.coalesce(last("model", mine), F.min_by("model", F.when((F.col("role") == "user") & F.col("model").isNotNull(), F.col("seq")))).alias("model"),
    )


def fleet(sessions: DataFrame) -> DataFrame:
    """Per instance and, with a null instance, for all: sessions, busy ones, tokens, cost, agents, round trip, online.
    sessions: instance, session, busy, tokens, cost, agent, rtt, online."""
    return sessions.rollup("instance").agg(F.count("*").alias("sessions"), F.count_if("busy").alias("busy"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"), F.avg("rtt").alias("rtt"), F.countDistinct(F.when(F.col("online"), F.col("instance"))).alias("online"))


def run_summary(calls: DataFrame) -> DataFrame:
    """Per call site: total time, calls, last rows (and last columns, if calls has columns), whether one failed, and time
    relative to the slowest. calls: tag, t, ms, rows, ok, columns."""
    last = [F.max_by(c, "t").alias(f"last_{c}") for c in ("rows", "columns") if c in calls.columns]
    sums = calls.groupBy("tag").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"), *last, F.bool_or(~F.col("ok")).alias("failed"))
    return sums.join(F.broadcast(sums.agg(F.max("total_ms").alias("most")))).select("*", (F.col("total_ms") / F.col("most")).alias("ratio")).drop("most")


def leaderboard(scores: DataFrame, pool: float) -> DataFrame:
    """Per week: each user's rank by damage, the week's total, what remains of the pool and whether it is cleared.
    scores: week, user_id, damage."""
    by_user = scores.groupBy("week", "user_id").agg(F.sum("damage").alias("damage"))
    week = Window.partitionBy("week")
    out = by_user.withColumn("rank", F.row_number().over(week.orderBy(F.desc("damage"), "user_id"))).withColumn("total", F.sum("damage").over(week))
    return out.withColumns({"remaining": F.greatest(F.lit(0.0), pool - F.col("total")), "cleared": F.col("total") >= pool})


def diary(snapshots: DataFrame) -> DataFrame:
    """Per owner and day: what a running counter gained since the day before; days without a gain are dropped."""
    last = snapshots.groupBy("owner", "day").agg(F.max("counter").alias("counter"))
    w = Window.partitionBy("owner").orderBy("day")
    return last.withColumn("gain", F.col("counter") - F.coalesce(F.lag("counter").over(w), F.lit(0))).filter("gain > 0").drop("counter")
