import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import aggregates, explore, joins, process, scans, verdicts, windows


def values(seed, n=700):
    rng = random.Random(seed)
    keys = ["a"] * 8 + ["b", "c", None]
    return [(rng.choice(keys), i, rng.choice([None, 1.0, 2.0, rng.gauss(0, 3)])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return values(1), spark.createDataFrame(values(1), "k string, o long, v double").repartition(5)


def test_exact_quantiles(spark, rows):
    data, df = rows
    shares = [0.0, 0.1, 0.25, 0.5, 0.995, 1.0]
    got = {r.k: (r.n, r.q) for r in scans.exact_quantiles(df, ["k"], "v", shares).collect()}
    for k in {x[0] for x in data}:
        v = [x[2] for x in data if x[0] == k and x[2] is not None]
        assert got[k][0] == len(v)
        assert np.allclose(got[k][1], np.quantile(v, shares))
    empty = spark.createDataFrame([("z", None)], "k string, v double")
    assert scans.exact_quantiles(empty, ["k"], "v", [0.5]).collect()[0]["q"] is None
    assert scans.exact_quantiles(df, [], "v", [0.5]).first().q == [np.median([x[2] for x in data if x[2] is not None])]


def test_named_percentiles(rows):
    data, df = rows
    r = {x.k: x for x in aggregates.aggregated(df, ["k"], "v", ["sum", "median", "p99.5", "count"]).collect()}
    v = [x[2] for x in data if x[0] is None and x[2] is not None]
    assert np.allclose([r[None]["sum"], r[None]["median"], r[None]["p99.5"], r[None]["count"]], [sum(v), np.median(v), np.quantile(v, 0.995), len(v)])
    with pytest.raises(ValueError, match="p101"):
        aggregates.aggregated(df, ["k"], "v", ["p101"])
    p = explore.profile(df, ["v", "o"]).collect()
    assert {(x.column_name, x.kind) for x in p} == {("v", "double"), ("o", "bigint")}
    assert {x.column_name: x.role for x in explore.roles(df.withColumn("thick_usl", F.lit(1.0)), ["thick_usl", "o"]).collect()}["thick_usl"] == "spec"


@pytest.mark.parametrize("size", [3, 1024])
def test_recursions_by_blocks(rows, size, monkeypatch):
    monkeypatch.setattr(scans, "block_size", lambda keep, most=1024: size)
    data, df = rows
    got_e = {r.k: r for r in process.ewma(df, "k", "o", "v").collect()}
    got_s = {r.k: r.smoothed for r in windows.smoothed(df, "k", "o", "v").collect()}
    clamp = scans.clamped_sums(df.filter("v is not null"), "k", "o", {"up": F.col("v") - 0.5, "down": -F.col("v")}, size)
    got_c = {r.k: (r.up, r.down) for r in clamp.collect()}
    assert set(got_e) == set(got_s) == set(got_c) == {"a", "b", "c"}
    for k in got_e:
        v = [x[2] for x in data if x[0] == k and x[2] is not None]
        z, s, out, up, down, most = np.mean(v), v[0], 0, 0.0, 0.0, [0.0, 0.0]
        for i, x in enumerate(v, 1):
            z = 0.2 * x + 0.8 * z
            out += abs(z - np.mean(v)) > 3 * np.std(v, ddof=1) * np.sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * i)))
            s = 0.7 * s + 0.3 * x if i > 1 else x
            up, down = max(0.0, up + x - 0.5), max(0.0, down - x)
            most = [max(most[0], up), max(most[1], down)]
        assert (got_e[k].n, got_e[k].n_out) == (len(v), out)
        assert np.allclose([got_e[k]["last"], got_s[k], *got_c[k]], [z, s, *most])


@pytest.mark.parametrize("kind", ["long", "string", "double", "timestamp"])
def test_recursions_of_many_keys_are_streams(spark, kind, monkeypatch):
    """Keys of any type, a few rows each: a task folds all of its keys in one call."""
    monkeypatch.setattr(scans, "block_size", lambda keep, most=1024: 2)
    df = spark.range(900).select((F.col("id") % 300).cast("double" if kind == "double" else "long").cast(kind).alias("k"), F.col("id").alias("o"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    e, c, s = process.ewma(df, "k", "o", "v"), process.cusum(df, "k", "o", "v"), windows.smoothed(df, "k", "o", "v")
    assert e.schema["k"].dataType == df.schema["k"].dataType
    want_e, want_s, want_c = [], [], []
    for k in range(300):
        v = [i * 37 % 101 for i in range(k, 900, 300)]
        z, s1, up = np.mean(v), v[0], [0.0]
        for x in v:
            z, s1 = 0.2 * x + 0.8 * z, 0.7 * s1 + 0.3 * x
            up.append(max(0.0, up[-1] + (x - np.mean(v)) / np.std(v, ddof=1) - 0.5))
        want_e.append(z), want_s.append(s1), want_c.append(max(up))
    assert np.allclose([r["last"] for r in e.orderBy(F.col("k").cast("double")).collect()], want_e)
    assert np.allclose([r.smoothed for r in s.orderBy(F.col("k").cast("double")).collect()], want_s)
    assert np.allclose([r.up for r in c.orderBy(F.col("k").cast("double")).collect()], want_c)
    for d in (e, c, s):
        assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_all_kinds(spark):
    rng = random.Random(3)
    spans = [(i, rng.randint(0, 5000), rng.choice([0, 1, 10, 300, 4000])) for i in range(150)] + [(200, 5, 3), (201, 5, 3), (202, 8, 2)]
    df = spark.createDataFrame(spans, "id long, s long, n long").select("id", F.timestamp_micros(F.col("s") * 250_000).alias("start"), F.timestamp_micros((F.col("s") + F.col("n")) * 250_000).alias("end"))
    got = sorted(tuple(r) for r in joins.overlaps(df, df.filter("id % 2 = 0")).collect())
    want = sorted((p[0], e[0]) for p in spans if p[0] % 2 == 0 for e in spans if p[2] and e[2] and p[1] < e[1] + e[2] and e[1] < p[1] + p[2])
    assert got == want


@pytest.mark.parametrize("most", [2, 16, 1024])
def test_overlaps_with_outliers_take_few_rows(spark, monkeypatch, most):
    """Very long and very short intervals, before 1970 too; an event is shuffled a few times, not once for every power of two."""
    monkeypatch.setattr(joins, "SLICES", most)
    rng = random.Random(5)
    spans = [(i, rng.randint(-9000, 9000), rng.choice([0, 1, 40, 60, 900]) if i % 40 else 10**7) for i in range(200)]
    df = spark.createDataFrame(spans, "id long, s long, n long").select("id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + F.col("n")).alias("end"))
    got = joins.overlaps(df, df.filter("id % 2 = 0"))
    want = sorted((p[0], e[0]) for p in spans if p[0] % 2 == 0 for e in spans if p[2] and e[2] and p[1] < e[1] + e[2] and e[1] < p[1] + p[2])
    assert sorted(map(tuple, got.collect())) == want
    even = df.withColumn("end", F.timestamp_seconds(F.unix_seconds("start") + 3000))
    plan = joins.overlaps(even, even.filter("id % 20 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan and "shiftleft" not in plan


def test_overlaps_are_not_broadcast_and_keep_an_events_pairs_together(spark, tmp_path):
    """Pairs are nearly all that is written; the runs of equal events and repeating proposed ones are what files compress."""
    rng = random.Random(8)
    spans = [(i, rng.randint(0, 1000)) for i in range(400)]
    spark.createDataFrame(spans, "id long, s long").select("id", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds(F.col("s") + 500).alias("end")).write.parquet(f"{tmp_path}/spans")
    df = spark.read.parquet(f"{tmp_path}/spans")
    found = joins.overlaps(df, df.filter("id % 2 = 0"))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    parts = found.select("event_id").rdd.glom().collect()
    assert sum(map(len, parts)) == sum(abs(p[1] - e[1]) < 500 for p in spans if p[0] % 2 == 0 for e in spans)
    assert sum(sum(a != b for a, b in zip([None, *p], p)) for p in parts) <= 5 * len(spans)


def test_statistics_leave_incomplete_rows_out(spark):
    full = [("a", float(i), "x" if i % 2 else "y") for i in range(6)] + [("b", float(i) + 2, "x") for i in range(5)]
    holes = [*full, *[("a", None, "x"), (None, 3.0, "y"), ("c", None, None), ("b", None, None)] * 4]
    one, two = (spark.createDataFrame(x, "g string, v double, c string") for x in (full, holes))
    for f in (lambda d: verdicts.kruskal(d, "g", "v"), lambda d: verdicts.anova(d, "g", "v"), lambda d: verdicts.chi_square(d.filter("g is null or c is not null or v is null").withColumn("c", F.when(F.col("v").isNotNull(), F.col("c"))), "g", "c")):
        assert np.allclose([x for x in f(one).first()], [x for x in f(two).first()])
