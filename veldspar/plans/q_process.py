"""Wafer maps and process control (WF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import process as p
from veldspar.plans.registry import M, measures, query, rounded


@query(f"WITH {M} SELECT die_x, die_y, round(avg(price), 6) AS mean, round(count(*) FILTER (bin = 0) / count(*), 6) AS defect_rate, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def wf1_die_map(spark, d):
    return rounded(p.die_map(measures(spark, d), ["die_x", "die_y"], "price", F.col("bin") == 0), 6)


@query(f"WITH {M} SELECT eqp, die_x, die_y, round(avg(price), 6) AS mean FROM m WHERE eqp IN (SELECT DISTINCT eqp FROM m ORDER BY eqp LIMIT 25) GROUP BY 1, 2, 3")
def wf2_gallery(spark, d):
    return rounded(p.gallery(measures(spark, d), "eqp", "price"), 6)


@query(f"WITH {M}, r AS (SELECT *, sqrt(pow(die_x - 15.5, 2) + pow(die_y - 25.5, 2)) / 25 AS r FROM m) SELECT CASE WHEN r <= 0.5 THEN 'centre' WHEN r <= 0.8 THEN 'middle' WHEN r <= 1 THEN 'outer' ELSE 'outside' END AS zone, r > 0.97 AS edge, count(*)::BIGINT AS n, round(avg(price), 4) AS mean FROM r GROUP BY 1, 2")
def wf3_radial_zones(spark, d):
    return rounded(p.radial_zones(measures(spark, d), (15.5, 25.5), 25.0).groupBy("zone", "edge").agg(F.count("*").alias("n"), F.avg("price").alias("mean")))


@query(f"WITH {M} SELECT chamber, die_x, die_y, (max(die_y) OVER w - die_y)::INT AS grid_x, (die_x - min(die_x) OVER w)::INT AS grid_y FROM m WINDOW w AS (PARTITION BY chamber)")
def wf4_grid_fit(spark, d):
    return p.grid_fit(measures(spark, d).select("chamber", "die_x", "die_y"), "chamber", 1)


@query(f"WITH {M} SELECT die_x, die_y, round(avg(price), 6) AS mean, round(count(*) FILTER (qty > 25) / count(*), 6) AS defect_rate, count(*)::BIGINT AS n FROM m WHERE bin = 3 GROUP BY 1, 2")
def wf5_single_bin(spark, d):
    return rounded(p.die_map(measures(spark, d).filter("bin = 3"), ["die_x", "die_y"], "price", F.col("qty") > 25), 6)


@query(f"WITH {M}, l AS (SELECT chamber, wlot, var_samp(price) * (count(*) - 1) AS w, count(*) AS k FROM m GROUP BY 1, 2), s AS (SELECT chamber, sqrt(sum(coalesce(w, 0)) / (sum(k) - count(*))) AS sigma FROM l GROUP BY 1), o AS (SELECT chamber, count(*)::BIGINT AS n, avg(price) AS mu, stddev_samp(price) AS sd FROM m GROUP BY 1) SELECT chamber, n, round(100000 / (6 * sigma), 6) AS cp, round(least(105000 - mu, mu - 5000) / (3 * sigma), 6) AS cpk, round(least(105000 - mu, mu - 5000) / (3 * sd), 6) AS ppk FROM s JOIN o USING (chamber)")
def wf6_capability(spark, d):
    return rounded(p.capability(measures(spark, d), ["chamber"], "wlot", "price", 5000, 105000), 6)


@query(f"WITH {M} SELECT chamber, round(avg(price) - 3 * stddev_samp(price), 3) AS low, round(avg(price), 3) AS mean, round(avg(price) + 3 * stddev_samp(price), 3) AS high, round(regr_slope(price, qty), 3) AS slope, round(regr_intercept(price, qty), 3) AS intercept, round(regr_r2(price, qty), 6) AS r2 FROM m GROUP BY 1")
def wf7_reference_lines(spark, d):
    return rounded(rounded(p.reference_lines(measures(spark, d), ["chamber"], "qty", "price"), 6, "r2"), 3, "low", "mean", "high", "slope", "intercept")


@query(f"WITH {M} SELECT lot, part, step, round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 6) AS z FROM m WINDOW w AS (PARTITION BY wlot)")
def wf8_normalised(spark, d):
    return rounded(p.normalised(measures(spark, d), "wlot", "price").select("lot", "part", "step", "z"), 6)


_ORD = "ORDER BY ts, lot, step, part"


@query(f"WITH {M}, x AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY eqp {_ORD})) AS mr FROM m), g AS (SELECT eqp, avg(price) AS c, avg(mr) AS r FROM x GROUP BY 1) SELECT eqp, round(c, 4) AS centre, round(r, 4) AS mr_bar, round(c - 2.66 * r, 4) AS lcl, round(c + 2.66 * r, 4) AS ucl, round(3.267 * r, 4) AS mr_ucl FROM g")
def wf9_individuals(spark, d):
    return rounded(p.individuals(measures(spark, d), "eqp", ["ts", "lot", "step", "part"], "price"))


_TABLE = ", ".join(map(str, p.XBAR_R))


@query(f"WITH {M}, g AS (SELECT eqp, lot, count(*)::INT AS size, avg(price) AS xbar, max(price) - min(price) AS r FROM m GROUP BY 1, 2), s AS (SELECT eqp, size, count(*)::BIGINT AS subgroups, avg(xbar) AS c, avg(r) AS rb FROM g GROUP BY 1, 2), t(size, a2, d3, d4) AS (VALUES {_TABLE}) SELECT eqp, size, subgroups, round(c, 7) AS centre, round(rb, 7) AS r_bar, round(c - a2 * rb, 7) AS lcl, round(c + a2 * rb, 7) AS ucl, round(d3 * rb, 7) AS r_lcl, round(d4 * rb, 7) AS r_ucl FROM s JOIN t USING (size)")
def wf10_xbar_r(spark, d):
    return rounded(p.xbar_r(measures(spark, d), "eqp", "lot", "price"), 7)


_SEQ = f"x AS (SELECT eqp, price AS v, row_number() OVER (PARTITION BY eqp {_ORD}) AS n, avg(price) OVER (PARTITION BY eqp) AS mu, stddev_samp(price) OVER (PARTITION BY eqp) AS sd FROM m)"


def _sequence(spark, d):
    return measures(spark, d).withColumn("o", F.struct("ts", "lot", "step", "part"))


@query(f"WITH RECURSIVE {M}, {_SEQ}, r AS (SELECT eqp, n, 0.2 * v + 0.8 * mu AS z, mu, sd FROM x WHERE n = 1 UNION ALL SELECT x.eqp, x.n, 0.2 * v + 0.8 * z, x.mu, x.sd FROM r JOIN x ON x.eqp = r.eqp AND x.n = r.n + 1) SELECT eqp, count(*)::INT AS n, round(arg_max(z, n), 4) AS last, count(*) FILTER (abs(z - mu) > 3 * sd * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * n))))::INT AS n_out FROM r GROUP BY 1")
def wf11_ewma(spark, d):
    return rounded(p.ewma(_sequence(spark, d), "eqp", "o", "price"))


@query(f"WITH {M}, x AS (SELECT *, (price - avg(price) OVER (PARTITION BY eqp)) / stddev_samp(price) OVER (PARTITION BY eqp) AS z FROM m), f AS (SELECT *, " + ", ".join(f"sum((z * {s} > {k})::INT) OVER (PARTITION BY eqp {_ORD} ROWS {n - 1} PRECEDING) AS c{k}{'p' if s > 0 else 'm'}" for k, n in ((2, 3), (1, 5), (0, 8)) for s in (1, -1)) + " FROM x) SELECT eqp, count(*) FILTER (abs(z) > 3)::BIGINT AS r1, count(*) FILTER ((c2p >= 2 OR c2m >= 2) AND abs(z) > 2)::BIGINT AS r2, count(*) FILTER ((c1p >= 4 OR c1m >= 4) AND abs(z) > 1)::BIGINT AS r3, count(*) FILTER (c0p >= 8 OR c0m >= 8)::BIGINT AS r4 FROM f GROUP BY 1")
def wf12_western_electric(spark, d):
    w = p.western_electric(measures(spark, d), "eqp", ["ts", "lot", "step", "part"], "price")
    return w.groupBy("eqp").agg(*[F.count_if(f"rule{k}").alias(f"r{k}") for k in (1, 2, 3, 4)])


@query(f"WITH RECURSIVE {M}, {_SEQ}, r AS (SELECT eqp, n, greatest(0, (v - mu) / sd - 0.5) AS u, greatest(0, -(v - mu) / sd - 0.5) AS w FROM x WHERE n = 1 UNION ALL SELECT x.eqp, x.n, greatest(0, u + (v - mu) / sd - 0.5), greatest(0, w - (v - mu) / sd - 0.5) FROM r JOIN x ON x.eqp = r.eqp AND x.n = r.n + 1) SELECT eqp, round(max(u), 6) AS up, round(max(w), 6) AS down, max(u) > 5 OR max(w) > 5 AS alarm FROM r GROUP BY 1")
def wf13_cusum(spark, d):
    return rounded(p.cusum(_sequence(spark, d), "eqp", "o", "price"), 6)


@query(f"WITH {M}, g AS (SELECT step, avg(price) AS golden FROM m GROUP BY 1), u AS (SELECT eqp, step, avg(price) AS v FROM m GROUP BY 1, 2) SELECT eqp, round(corr(v, golden), 6) AS similarity, round(sqrt(sum(pow(v - golden, 2))), 3) AS distance FROM u JOIN g USING (step) GROUP BY 1")
def wf14_profile_similarity(spark, d):
    return rounded(rounded(p.profile_similarity(measures(spark, d), "eqp", "step", "price"), 6, "similarity"), 3, "distance")


@query()
def wf15_kmeans(spark, d):
    rows = measures(spark, d).select((F.col("price") / 100000).alias("a"), (F.col("qty") / 50).alias("b"))
    return p.kmeans(rows, ["a", "b"]).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT eqp, round(avg(price) FILTER (ts < TIMESTAMP '1996-01-01'), 4) AS before, round(avg(price) FILTER (ts >= TIMESTAMP '1996-01-01'), 4) AS after, count(*) FILTER (ts < TIMESTAMP '1996-01-01')::BIGINT AS n_before, count(*) FILTER (ts >= TIMESTAMP '1996-01-01')::BIGINT AS n_after, round(avg(price) FILTER (ts >= TIMESTAMP '1996-01-01') - avg(price) FILTER (ts < TIMESTAMP '1996-01-01'), 4) AS shift FROM m GROUP BY 1")
def wf16_before_after(spark, d):
    return rounded(p.before_after(measures(spark, d), "1996-01-01", "ts", "eqp", "price"))


_Q = "s AS (SELECT chamber, count(*)::DOUBLE AS s0, sum(qty) AS s1, sum(pow(qty, 2)) AS s2, sum(pow(qty, 3)) AS s3, sum(pow(qty, 4)) AS s4, sum(price) AS t0, sum(qty * price) AS t1, sum(qty * qty * price) AS t2 FROM m GROUP BY 1), x AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM s)"


@query(f"WITH {M}, {_Q} SELECT chamber, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det, 3) AS a, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det, 3) AS b, round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 4) AS c FROM x")
def wf17_quadratic(spark, d):
    return rounded(rounded(p.quadratic(measures(spark, d), "chamber", "qty", "price"), 4, "c"), 3, "a", "b")
