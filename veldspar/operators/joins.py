"""Joins with key reports, duplicate policies, intervals, ranges, as-of joins, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICES = 1024  # of one interval, at most about


def key_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on the left, those with a partner, and right keys that occur more than once."""
    r = right.groupBy(key).agg(F.count("*").alias("n_right"))
    l = left.groupBy(key).agg(F.count("*").alias("n_left"))
    return l.join(r, key, "full").agg(F.count("n_left").alias("left_keys"), F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias("matched_keys"), F.count_if(F.col("n_right") > 1).alias("duplicate_keys")).withColumn("match_rate", F.col("matched_keys") / F.col("left_keys"))


def first_per_key(df: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.min_by(v, order).alias(v) for v in values])


def last_per_key(df: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def mean_per_key(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def cross_join(left: DataFrame, small: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row of left with every row of small, which travels to the tasks and may have ``most`` rows; more raise an error."""
    n = small.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the small side of a cross join has more than {most} rows")
    return left.crossJoin(F.broadcast(small))


def union_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def overlaps(events: DataFrame, proposed: DataFrame, unit_seconds: int = 1) -> DataFrame:
    """(proposed_id, event_id) with proposed.start < event.end and event.start < proposed.end. Both tables have id,
    start, end; empty intervals overlap nothing.

    Of two intervals that overlap, one holds the other's start. An interval is laid out over the slices of time that it
    touches, a start lies in one slice, and they meet by equal slices, once. Slices of events are half as long as a mean event,
    so that an event has about three, those of the fewer proposed ones an eighth; intervals of more than SLICES of them take slices
    that are SLICES times as long, which starts are then looked up in, too. No slice is shorter than unit_seconds.

    Neither side is broadcast. The pairs are nearly all of what is written: those of an event follow each other, with the
    proposed ones about in the order of their starts, so that neighbours repeat them and files compress."""

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.filter("start < end").select(F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end")).sortWithinPartitions(f"{p}_start")

    def sizes(df: DataFrame, p: str, share: int) -> list[int]:
        """Lengths of slices in microseconds, by level."""
        mean, longest = df.select((F.unix_micros(f"{p}_end") - F.unix_micros(f"{p}_start")).alias("d")).agg(F.avg("d"), F.max("d")).first()
        out = [max(unit_seconds * 1_000_000, int((mean or 0) / share))]
        while (longest or 0) > out[-1] * SLICES:
            out.append(out[-1] * SLICES)
        return out

    def slices(df: DataFrame, p: str, of: list[int]) -> DataFrame:
        first, last = F.unix_micros(f"{p}_start"), F.unix_micros(f"{p}_end") - 1
        level = sum(((last - first >= x * SLICES).cast("int") for x in of[:-1]), F.lit(0))
        size = F.get(F.array(*[F.lit(x).cast("long") for x in of]), level)
        return df.select("*", level.alias("level"), F.explode(F.sequence(first - F.pmod(first, size), last - F.pmod(last, size), size)).alias("slice"))

    def starts(df: DataFrame, p: str, of: list[int]) -> DataFrame:
        first = F.unix_micros(f"{p}_start")
        each = [F.struct(F.lit(i).alias("level"), (first - F.pmod(first, F.lit(x).cast("long"))).alias("slice")) for i, x in enumerate(of)]
        return df.select("*", F.explode(F.array(*each)).alias("_x")).select(*df.columns, "_x.level", "_x.slice")

    e, p = named(events, "event"), named(proposed, "proposed")
    of_e, of_p, keys = sizes(e, "event", 2), sizes(p, "proposed", 8), ["level", "slice"]
    inside = slices(e, "event", of_e).join(starts(p, "proposed", of_e).hint("merge"), keys).filter((F.col("event_start") <= F.col("proposed_start")) & (F.col("proposed_start") < F.col("event_end")))
    around = starts(e, "event", of_p).join(slices(p, "proposed", of_p).hint("merge"), keys).filter((F.col("proposed_start") < F.col("event_start")) & (F.col("event_start") < F.col("proposed_end")))
    return inside.select("proposed_id", "event_id").union(around.select("proposed_id", "event_id"))


def seasons(days: DataFrame, ranges: DataFrame, day: str = "day") -> DataFrame:
    """days with the name of the first range (by its order) that holds the day. ranges: ord, name, first, last; both ends
    are dates as text, mm-dd for every year (wrapping over its end) or yyyy-mm-dd. ranges is a small list."""
    d = F.when(F.length("first") == 5, F.date_format(day, "MM-dd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    inside = F.when(F.col("first") <= F.col("last"), (d >= F.col("first")) & (d <= F.col("last"))).otherwise((d >= F.col("first")) | (d <= F.col("last")))
    distinct = days.select(day).distinct()
    found = distinct.join(F.broadcast(ranges), inside).groupBy(day).agg(F.min_by("name", "ord").alias("season"))
    return days.join(found, day, "left")


def call_nodes(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, node_id): nodes on the call's file, line and column, those whose call line is in the stack first, then
    the smallest id. calls: call_id, file, line, col, stack array<int>; nodes: node_id, file, line, col, call_line.

    Of the nodes of one place and call line only the smallest id can be taken, and of a place only the smallest of all, so
    a call meets these instead of every node of its place. A call line or stack that isn't known for certain comes last."""
    at = ["file", "line", "col"]
    lines = nodes.groupBy(*at, "call_line").agg(F.min("node_id").alias("node_id"))
    places = lines.groupBy(*at).agg(F.min("node_id").alias("_any"), F.min(F.when(F.col("call_line").isNotNull(), F.col("node_id"))).alias("_known"))
    inside = calls.select("call_id", *at, F.explode(F.array_distinct("stack")).alias("call_line")).join(lines, [*at, "call_line"]).select("call_id", F.lit(0).alias("rank"), "node_id")
    known = F.col("stack").isNotNull() & ~F.exists("stack", lambda x: x.isNull()) & F.col("_known").isNotNull()
    outside = calls.join(places, at).select("call_id", F.when(known, 1).otherwise(2).alias("rank"), F.when(known, F.col("_known")).otherwise(F.col("_any")).alias("node_id"))
    return inside.union(outside).groupBy("call_id").agg(F.min(F.struct("rank", "node_id")).alias("_b")).select("call_id", "_b.node_id")


def waived(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """findings (finding_id, app, rule, path) with the first waiver (waiver_id, app, rule, files) that covers them:
    files is the path, a prefix of it that ends in /, or *."""
    w = waivers.withColumnsRenamed({"app": "w_app", "rule": "w_rule"})
    covers = (F.col("files") == "*") | (F.col("files") == F.col("path")) | (F.col("files").endswith("/") & F.startswith("path", "files"))
    hits = findings.join(w, (F.col("app") == F.col("w_app")) & (F.col("rule") == F.col("w_rule")) & covers).groupBy("finding_id").agg(F.min("waiver_id").alias("waiver_id"))
    return findings.join(hits, "finding_id", "left")


def idle_waivers(waivers: DataFrame, judged: DataFrame, as_of: str) -> DataFrame:
    """Waivers that cover nothing or are past their day."""
    used = judged.select("waiver_id").filter("waiver_id is not null").distinct().withColumn("used", F.lit(True))
    return waivers.join(used, "waiver_id", "left").select("waiver_id", F.col("used").isNull().alias("unused"), (F.col("due") < F.lit(as_of).cast("date")).alias("expired")).filter("unused or expired")


def as_of_previous(rows: DataFrame, events: DataFrame, key: str, time: str = "ts", event: str = "event") -> DataFrame:
    """rows with the latest event of their key at or before their time: both tables are united and the last event is
    carried forward, so one sort per key does it."""
    both = rows.withColumn(event, F.lit(None).cast(dict(events.dtypes)[event])).withColumn("_r", F.lit(1)).unionByName(events.select(key, time, event).withColumn("_r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_r", F.col(event).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(event, F.last(event, ignorenulls=True).over(w)).filter("_r = 1").drop("_r")


def references(lines: DataFrame, fragments: DataFrame) -> DataFrame:
    """(line_id, fragment_id, position) of the known references of a line in order of first mention; ids are trimmed,
    lower-cased and lose brackets. lines: line_id, refs array<string>."""
    ids = lines.select("line_id", F.posexplode("refs").alias("position", "raw")).withColumn("fragment_id", F.lower(F.regexp_replace(F.trim("raw"), r"[\[\]]", "")))
    return ids.groupBy("line_id", "fragment_id").agg(F.min("position").alias("position")).join(fragments.select("fragment_id").distinct(), "fragment_id", "left_semi")


def missing_targets(links: DataFrame, paths: DataFrame) -> DataFrame:
    return links.join(paths, links["target"] == paths["path"], "left_anti")


def key_differences(objects: DataFrame, required: list[str], column: str = "props") -> DataFrame:
    """(key, problem, n): required keys that JSON objects lack, and keys they have beyond those."""
    keys = objects.select(F.monotonically_increasing_id().alias("_i"), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("k"))
    wanted = F.array(*[F.lit(k) for k in required])
    lacking = keys.select(F.explode(F.array_except(wanted, "k")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("problem", F.lit("missing"))
    extra = keys.select(F.explode(F.array_except("k", wanted)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("problem", F.lit("unknown"))
    return lacking.union(extra).select("key", "problem", "n")


def range_conflicts(rows: DataFrame, bucket: float) -> DataFrame:
    """(a, b) of rows (id, lo, hi) whose closed ranges overlap, a < b; ranges meet by the buckets they touch."""
    n = lambda c: F.floor(F.col(c) / bucket).cast("long")
    cut = rows.filter("lo <= hi").select("id", "lo", "hi", F.explode(F.sequence(n("lo"), n("hi"))).alias("bucket"), n("lo").alias("first"))
    a, b = cut.alias("a"), cut.alias("b")
    return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & (F.col("a.bucket") == F.greatest("a.first", "b.first"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def reconciled(register: DataFrame, actual: DataFrame, key: str, state: str) -> DataFrame:
    """(key, verdict): unregistered, missing, wrong state or ok."""
    r, a = register.select(key, F.col(state).alias("_r"), F.lit(1).alias("_in_r")), actual.select(key, F.col(state).alias("_a"), F.lit(1).alias("_in_a"))
    return r.join(a, key, "full").select(key, F.when(F.col("_in_r").isNull(), "unregistered").when(F.col("_in_a").isNull(), "missing").when(~F.col("_r").eqNullSafe(F.col("_a")), "wrong state").otherwise("ok").alias("verdict"))
