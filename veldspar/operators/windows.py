"""Window operators: partitioned calculated columns, navigation, islands, running rules, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.operators.scans import decayed

from veldspar.sources.scratch import shared_folder

_ALL = (Window.unboundedPreceding, Window.currentRow)


def over(df: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """An aggregate over the rows of the same keys; null keys are one group."""
    return df.withColumn(name, value.over(Window.partitionBy(*keys)))


def deviation(df: DataFrame, column: str, keys: list[str], name: str = "deviation") -> DataFrame:
    return df.withColumn(name, F.col(column) - F.avg(column).over(Window.partitionBy(*keys)))


def over_all(df: DataFrame, value: Column, name: str) -> DataFrame:
    """An aggregate over the whole table: one row, broadcast; never a window in a single partition."""
    return df.join(F.broadcast(df.agg(value.alias(name))))


def running(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, value.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_ALL)))


def ranks(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})


def neighbours(df: DataFrame, column: str, keys: list[str], order: list[str], periods: int = 3) -> DataFrame:
    """The previous and next value, and the mean of the last ``periods``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"previous": F.lag(column).over(w), "next": F.lead(column).over(w), "last_periods": F.avg(column).over(w.rowsBetween(1 - periods, 0))})


def streaks(days: DataFrame, owner: str = "owner", day: str = "day") -> DataFrame:
    """(owner, first, last, length) of each run of consecutive days."""
    distinct = days.select(owner, day).distinct()
    island = F.date_sub(day, F.row_number().over(Window.partitionBy(owner).orderBy(day)))
    return distinct.withColumn("_i", island).groupBy(owner, "_i").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("length")).drop("_i")


#: Tiers of the diminishing weight: up to this running total of a day, a unit weighs this much.
TIERS = [(2_000_000.0, 1.0), (10_000_000.0, 0.25), (float("inf"), 0.05)]


def tiered(df: DataFrame, value: str, keys: list[str], order: list[str], tiers: list[tuple[float, float]] | None = None) -> DataFrame:
    """Each row's value, weighted by the tiers that it falls into after the rows before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out, low = F.lit(0.0), 0.0
    for high, weight in tiers or TIERS:
        out = out + F.greatest(F.lit(0.0), F.least(F.col("_b") + F.col(value), F.lit(high)) - F.greatest(F.col("_b"), F.lit(low))) * weight
        low = high
    return df.withColumn("_b", before).withColumn("weighted", out).drop("_b")


def carried(df: DataFrame, value: str, unit: float, keys: list[str], order: list[str]) -> DataFrame:
    """Units granted when the running total crosses a multiple of the unit."""
    total = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_ALL))
    return df.withColumn("_t", total).withColumn("granted", (F.floor(F.col("_t") / unit) - F.floor((F.col("_t") - F.col(value)) / unit)).cast("long")).drop("_t")


def token_deltas(df: DataFrame, started: str, slack_seconds: int = 5) -> DataFrame:
    """What a cumulative counter gained per observation. df: session, seq, created, total. Sessions created after the
    start (less the slack) count from 0, others from their first value; without a creation time they are skipped."""
    w = Window.partitionBy("session").orderBy("seq")
    fresh = F.col("created") >= F.timestamp_seconds(F.unix_timestamp(F.lit(started).cast("timestamp")) - slack_seconds)
    base = F.coalesce(F.lag("total").over(w), F.when(fresh, F.lit(0)).otherwise(F.col("total")))
    return df.filter("created is not null").withColumn("delta", F.greatest(F.lit(0), F.col("total") - base))


def transitions(df: DataFrame, state: str, keys: list[str], order: list[str]) -> DataFrame:
    """The rows at which the state differs from the one before; the first row of a key doesn't count."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("was", before).filter(F.col("was").isNotNull() & (F.col("was") != F.col(state)))


def smoothed(df: DataFrame, key: str, order: str, value: str, keep: float = 0.7) -> DataFrame:
    """keep * old + (1 - keep) * new at the end of each key's ordered values, from the first of them. Exact, by stretches of a key's order; rows
    without a value or key don't count."""
    some = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    first = some.groupBy(key).agg(F.min_by("_v", "_o").alias("_first"))
    z = decayed(some.join(first, key), key, "_o", "_v", "_first", keep)
    return z.groupBy(key).agg(F.max_by("_z", "_n").alias("smoothed"))


def completions(df: DataFrame) -> DataFrame:
    """Newly completed items and whether the list is a new one. df: session, seq, items array<struct<content, status>>."""
    w = Window.partitionBy("session").orderBy("seq")
    names = lambda c, keep: F.transform(F.filter(c, keep), lambda i: i["content"])
    done = lambda c: names(c, lambda i: i["status"] == "completed")
    every = lambda c: names(c, lambda i: F.lit(True))
    was = F.col("_was")
    return df.withColumn("_was", F.lag("items").over(w)).select("session", "seq", F.size(F.array_except(done(F.col("items")), F.coalesce(done(was), F.array().cast("array<string>")))).alias("completed"), (was.isNotNull() & (F.size("items") > 0) & ~F.arrays_overlap(every(F.col("items")), every(was))).alias("new_list"))


def versions(accesses: DataFrame) -> DataFrame:
    """accesses (table_name, seq, kind read or write) with the version: a write after a read starts a new one."""
    w = Window.partitionBy("table_name").orderBy("seq")
    new = (F.col("kind") == "write") & (F.lag("kind").over(w) == "read")
    return accesses.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("version", F.sum("_new").over(w.rowsBetween(*_ALL))).drop("_new")


def bands(df: DataFrame, keys: list[str], position: str, gap: int = 2) -> DataFrame:
    """(keys, first, last): positions that are at most ``gap`` apart, merged."""
    w = Window.partitionBy(*keys).orderBy(position)
    start = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(0))
    return df.select(*keys, position).distinct().withColumn("_s", start).withColumn("_g", F.sum("_s").over(w.rowsBetween(*_ALL))).groupBy(*keys, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_g")


def next_event(events: DataFrame, as_of: str, owner: str = "owner") -> DataFrame:
    """Per owner at a moment: the next start and seconds to it, seconds to the end of a running event, and the events
    that still start that day."""
    now = F.lit(as_of).cast("timestamp")
    seconds = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a)
    later, on = F.col("start") > now, (F.col("start") <= now) & (F.col("end") > now)
    return events.groupBy(owner).agg(F.min(F.when(later, F.col("start"))).alias("next_start"), F.min(F.when(later, seconds(now, "start"))).alias("seconds_to_next"), F.max(F.when(on, seconds(now, "end"))).alias("seconds_to_end"), F.count_if(later & (F.to_date("start") == F.to_date(now))).alias("left_today"))


def free_slots(events: DataFrame, first: str, last: str, open_hour: int = 9, close_hour: int = 18, minutes: int = 30, weekdays: tuple[int, ...] = (2, 3, 4, 5, 6), owner: str = "owner") -> DataFrame:
    """(owner, slot_start, slot_end): gaps of at least ``minutes`` within working hours; weekdays count from Sunday = 1."""
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).filter(F.dayofweek("day").isin(*weekdays))
    at = lambda h: F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + h * 3600)
    work = events.select(owner).distinct().join(F.broadcast(days)).select(owner, "day", at(open_hour).alias("open"), at(close_hour).alias("close"))
    by_day = events.filter("start < end").select(owner, "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day"))
    busy = work.join(by_day, [owner, "day"]).select(owner, "day", "open", "close", F.greatest("start", "open").alias("s"), F.least("end", "close").alias("e")).filter("s < e")
    marks = busy.select(owner, "day", "close", "s", "e").union(work.select(owner, "day", "close", F.col("open").alias("s"), F.col("open").alias("e")))
    w = Window.partitionBy(owner, "day").orderBy("s", "e")
    gaps = marks.withColumn("slot_start", F.max("e").over(w.rowsBetween(*_ALL))).withColumn("slot_end", F.coalesce(F.lead("s").over(w), F.col("close")))
    return gaps.filter(F.unix_timestamp("slot_end") - F.unix_timestamp("slot_start") >= minutes * 60).select(owner, "slot_start", "slot_end")


def session_tree(nodes: DataFrame, most_depth: int = 1000) -> DataFrame:
    """(id, depth, place): roots, then children, the newest first; place is the order of display. nodes: id, parent,
    updated (long). One join a level, each written to the shared folder, until a level is empty; nodes of a cycle have no
    root and aren't listed. A deeper tree than ``most_depth`` raises an error."""
    key = lambda: F.concat(F.lpad((F.lit(10**15) - F.col("updated")).cast("string"), 16, "0"), F.lpad(F.col("id").cast("string"), 12, "0"))
    ids = nodes.select(F.col("id").alias("parent"))
    level = nodes.filter("parent is null").union(nodes.filter("parent is not null").join(ids, "parent", "left_anti").select(nodes.columns)).select("id", F.lit(0).alias("depth"), key().alias("path"))
    spark = nodes.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "tree")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    level = written(level)
    out = level
    for depth in range(1, most_depth):
        level = written(nodes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("_p")), "parent").select("id", F.lit(depth).alias("depth"), F.concat("_p", key()).alias("path")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError(f"the tree is deeper than {most_depth}")


def commonality(df: DataFrame, bad: Column, keys: list[str], lot: str) -> DataFrame:
    """Share of bad lots among the lots that passed each step and equipment, the largest first."""
    lots = df.groupBy(lot).agg(F.bool_or(bad).alias("_bad"))
    passed = df.select(*keys, lot).distinct().join(lots, lot)
    return passed.groupBy(*keys).agg(F.count("*").alias("lots"), F.count_if("_bad").alias("bad_lots")).withColumn("share", F.col("bad_lots") / F.col("lots")).orderBy(F.desc("share"), F.desc("lots"), *keys)


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key with their number."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= n)


def run_order(runs: DataFrame, as_of: str, stale_seconds: int = 15) -> DataFrame:
    """Runs in progress first, then the most recent; a run in progress without a beat for so long is stale. runs: id,
    started, beat, ended."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    state = F.when(F.col("ended").isNotNull(), "done").when(now - F.unix_timestamp("beat") > stale_seconds, "stale").otherwise("running")
    return runs.withColumn("state", state).orderBy((F.col("state") == "running").desc(), F.desc("started"), "id")
