"""Aggregation (AG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import aggregates as a
from veldspar.plans.registry import M, measures, query, rounded, table


@query(f"WITH {M} SELECT chamber, step, round(avg(price), 4) AS mean_price FROM m GROUP BY 1, 2")
def ag1_two_key_mean(spark, d):
    return rounded(a.group_means(measures(spark, d), ["chamber", "step"], ["price"]))


_MANY = ["price", "qty", "disc", "bin", "die_x", "die_y", "part", "eqp"]


@query(f"WITH {M} SELECT step, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in _MANY) + " FROM m GROUP BY 1")
def ag2_many_means(spark, d):
    return rounded(a.group_means(measures(spark, d), ["step"], _MANY))


@query(f"WITH {M} SELECT chamber, round(sum(price), 2) AS sum, round(avg(price), 5) AS avg, count(price)::BIGINT AS count, min(price) AS min, max(price) AS max, round(median(price), 5) AS median, round(stddev_samp(price), 5) AS sd, round(var_samp(price), 0) AS var, count(DISTINCT price)::BIGINT AS unique, round(stddev_samp(price) / sqrt(count(price)), 5) AS se, round(quantile_cont(price, 0.25), 5) AS q1, round(quantile_cont(price, 0.75), 5) AS q3, round(quantile_cont(price, 0.1), 5) AS p10, round(quantile_cont(price, 0.9), 5) AS p90 FROM m GROUP BY 1")
def ag3_aggregate_set(spark, d):
    return rounded(rounded(rounded(a.aggregated(measures(spark, d), ["chamber"], "price", a.NAMES), 5), 0, "var"), 2, "sum")


_BOX = "b AS (SELECT step, count(price)::BIGINT AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM m GROUP BY 1), f AS (SELECT *, 2.5 * q1 - 1.5 * q3 AS fence_low, 2.5 * q3 - 1.5 * q1 AS fence_high FROM b)"


@query(f"WITH {M}, {_BOX} SELECT step, n, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(fence_low, 6) AS fence_low, round(fence_high, 6) AS fence_high, min(price) FILTER (price BETWEEN fence_low AND fence_high) AS whisker_low, max(price) FILTER (price BETWEEN fence_low AND fence_high) AS whisker_high, count(*) FILTER (price < fence_low)::BIGINT AS n_below, count(*) FILTER (price > fence_high)::BIGINT AS n_above FROM m JOIN f USING (step) GROUP BY ALL")
def ag4_box_exact(spark, d):
    return rounded(a.whiskers(measures(spark, d), ["step"], "price"), 6)


@query(f"WITH {M}, w AS (SELECT bin AS step, lot, pow(price / 100000, 6) * 1000000 AS price FROM m), {_BOX.replace('FROM m', 'FROM w')} SELECT step, lot, round(price, 0) AS price, side FROM (SELECT *, row_number() OVER (PARTITION BY step, side ORDER BY CASE side WHEN 'high' THEN -price ELSE price END, lot) r FROM (SELECT step, lot, price, CASE WHEN price > fence_high THEN 'high' WHEN price < fence_low THEN 'low' END AS side FROM w JOIN f USING (step)) WHERE side IS NOT NULL) WHERE r <= 20")
def ag4_outliers(spark, d):
    w = measures(spark, d).select(F.col("bin").alias("step"), "lot", (F.pow(F.col("price") / 100000, F.lit(6)) * 1000000).alias("price"))
    return rounded(a.outliers(w, ["step"], "price", ["lot"], 20), 0)


@query()
def ag5_box_approximate(spark, d):
    return rounded(a.box(measures(spark, d), ["step"], "price", exact=False)).withColumn("approximate", F.lit(True))


@query(f"WITH {M} SELECT wlot, chamber, round(avg(price), 7) AS lot_mean, count(price)::BIGINT AS n FROM m GROUP BY 1, 2")
def ag6_lot_fold(spark, d):
    return rounded(a.lot_fold(measures(spark, d), ["wlot", "chamber"], "price"), 7)


@query(f"WITH {M} SELECT chamber, count(*)::BIGINT AS n, count(DISTINCT wlot)::BIGINT AS n_lot, count(DISTINCT (wlot, step))::BIGINT AS n_wafer FROM m GROUP BY 1")
def ag7_lots_below(spark, d):
    return a.lots_below(measures(spark, d), "chamber", "wlot", "step")


@query(f"WITH {M} SELECT step, sum(qty) FILTER (chamber = 'A') AS \"A\", sum(qty) FILTER (chamber = 'N') AS \"N\", sum(qty) FILTER (chamber = 'R') AS \"R\" FROM m GROUP BY 1")
def ag8_cross_table(spark, d):
    return a.cross_table(measures(spark, d), "step", "chamber", ["A", "N", "R"], F.sum("qty"))


@query(f"WITH {M} SELECT step, round(avg(price) FILTER (chamber = 'A'), 4) AS \"chamber_A\", round(avg(price) FILTER (chamber = 'R'), 4) AS \"chamber_R\" FROM m GROUP BY 1")
def ag9_pivot(spark, d):
    return rounded(a.pivot_conditional(measures(spark, d), "step", "chamber", ["A", "R"], "price"))


@query(f"WITH {M} SELECT variable, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM (SELECT 'price' AS variable, price AS value FROM m UNION ALL SELECT 'qty', qty FROM m UNION ALL SELECT 'disc', disc FROM m UNION ALL SELECT 'die_x', die_x FROM m) GROUP BY 1")
def ag10_unpivot(spark, d):
    return rounded(a.unpivoted(measures(spark, d), ["lot", "step"], ["price", "qty", "disc", "die_x"]).groupBy("variable").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query(f"WITH {M} SELECT floor((price - 900) / 1000)::INT AS bucket, count(*)::BIGINT AS n FROM m GROUP BY 1")
def ag11_even_bins(spark, d):
    return measures(spark, d).groupBy(a.even_bins("price", 900, 1000).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT (CASE WHEN price < 5000 THEN 0 WHEN price < 20000 THEN 1 WHEN price < 60000 THEN 2 ELSE 3 END)::INT AS bucket, count(*)::BIGINT AS n FROM m GROUP BY 1")
def ag12_limit_bins(spark, d):
    return measures(spark, d).groupBy(a.limit_bins("price", [5000, 20000, 60000]).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('week', ts)::TIMESTAMP AS week, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def ag13_time_bins(spark, d):
    return measures(spark, d).groupBy(F.date_trunc("month", "ts").alias("month"), F.date_trunc("week", "ts").alias("week")).agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT least(floor((qty - 10) / 30 * 256), 255)::INT AS gx, least(floor((price - 5000) / 60000 * 256), 255)::INT AS gy, count(*)::BIGINT AS n, round(ln(1 + count(*)), 6) AS weight FROM m WHERE qty BETWEEN 10 AND 40 AND price BETWEEN 5000 AND 65000 GROUP BY 1, 2")
def ag14_density(spark, d):
    return rounded(a.density(measures(spark, d), "qty", "price", (10, 40), (5000, 65000)), 6)


@query("SELECT floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 21600)::INT AS pixel, min(value) AS low, max(value) AS high, arg_min(ts, (value, event_id)) AS low_at, arg_max(ts, (value, event_id)) AS high_at FROM events GROUP BY 1")
def ag15_decimation(spark, d):
    return a.decimated(table(spark, d, "events"), "ts", "value", "2024-01-01", 21600, "event_id")


@query("WITH c AS (SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1) SELECT p_brand, n, round(sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c), 6) AS cumulative FROM c")
def ag16_pareto(spark, d):
    return rounded(a.pareto(table(spark, d, "part"), "p_brand"), 6)


@query(f"WITH {M}, c AS (SELECT step, chamber, count(*)::BIGINT AS n FROM m GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY step), 6) AS share FROM c")
def ag16_stacked_shares(spark, d):
    return rounded(a.shares(measures(spark, d), "step", "chamber"), 6)


@query(f"WITH {M} SELECT eqp, step, grouping(eqp, step)::BIGINT AS level, round(sum(qty), 2) AS total, count(*)::BIGINT AS n FROM m GROUP BY ROLLUP (eqp, step)")
def ag17_subtotals(spark, d):
    return rounded(a.subtotals(measures(spark, d), "eqp", "step", "qty"), 2)


@query(f"WITH {M} SELECT chamber, recipe, step, round(avg(price), 4) AS mean, (SELECT min(price) FROM m) AS axis_low, (SELECT max(price) FROM m) AS axis_high FROM m GROUP BY 1, 2, 3")
def ag18_trellis(spark, d):
    return rounded(a.trellis(measures(spark, d), ["chamber", "recipe"], "step", "price"), 4, "mean")


@query(f"WITH {M} SELECT date_trunc('quarter', ts)::TIMESTAMP AS bucket, chamber, round(avg(price), 4) AS mean, count(*)::BIGINT AS n FROM m GROUP BY 1, 2")
def ag19_trend(spark, d):
    return rounded(a.trend(measures(spark, d), "ts", "quarter", "chamber", "price"))


def messages(spark, d):
    """events as session messages."""
    e = table(spark, d, "events")
    n = F.round(F.col("value") * 10).cast("long")
    tokens = F.struct((n % 101).alias("input"), (n % 37).alias("output"), (n % 11).alias("reasoning"), F.struct((n % 7).alias("read"), (n % 5).alias("write")).alias("cache"))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "view"), "assistant").when(F.col("event_type") == "click", "user").otherwise("system").alias("role"), F.when(n % 3 > 0, F.concat(F.lit("agent"), n % 3)).alias("agent"), F.when(n % 4 > 0, F.concat(F.lit("model"), n % 4)).alias("model"), tokens.alias("tokens"), F.col("value").alias("cost"))


_MSG = "g AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type IN ('purchase', 'view') THEN 'assistant' WHEN event_type = 'click' THEN 'user' ELSE 'system' END AS role, round(value * 10)::BIGINT AS k, value AS cost FROM events)"


@query(f"WITH {_MSG} SELECT session, coalesce(sum(k % 101) FILTER (role = 'assistant'), 0)::BIGINT AS tokens_in, coalesce(sum(k % 37) FILTER (role = 'assistant'), 0)::BIGINT AS tokens_out, coalesce(sum(k % 11) FILTER (role = 'assistant'), 0)::BIGINT AS reasoning, coalesce(sum(k % 7 + k % 5) FILTER (role = 'assistant'), 0)::BIGINT AS cache, round(coalesce(sum(cost) FILTER (role = 'assistant'), 0), 4) AS cost, arg_max('agent' || k % 3, seq) FILTER (k % 3 > 0) AS agent, coalesce(arg_max('model' || k % 4, seq) FILTER (role = 'assistant' AND k % 4 > 0), arg_min('model' || k % 4, seq) FILTER (role = 'user' AND k % 4 > 0)) AS model FROM g GROUP BY 1")
def ag20_session_totals(spark, d):
    return rounded(a.session_totals(messages(spark, d)))


@query("WITH s AS (SELECT user_id % 4 AS instance, user_id AS session, arg_max(event_type, event_id) = 'view' AS busy, sum(round(value)::BIGINT) AS tokens, sum(value) AS cost, 'agent' || user_id % 3 AS agent, avg(value) AS rtt, user_id % 4 <> 3 AS online FROM events GROUP BY user_id) SELECT instance, count(*)::BIGINT AS sessions, count(*) FILTER (busy)::BIGINT AS busy, sum(tokens)::BIGINT AS tokens, round(sum(cost), 3) AS cost, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, round(avg(rtt), 3) AS rtt, count(DISTINCT instance) FILTER (online)::BIGINT AS online FROM s GROUP BY ROLLUP (instance)")
def ag21_fleet(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg((F.max_by("event_type", "event_id") == "view").alias("busy"), F.sum(F.round("value").cast("long")).alias("tokens"), F.sum("value").alias("cost"), F.avg("value").alias("rtt"))
    s = s.selectExpr("user_id % 4 instance", "user_id session", "busy", "tokens", "cost", "concat('agent', user_id % 3) agent", "rtt", "user_id % 4 <> 3 online")
    return rounded(a.fleet(s.withColumn("instance", F.col("instance"))), 3)


@query("WITH s AS (SELECT 'f' || l_partkey % 50 || ':' || l_linenumber AS tag, sum(l_extendedprice) AS total_ms, count(*)::BIGINT AS n, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_suppkey)) AS last_rows, bool_or(l_quantity >= 50) AS failed FROM lineitem GROUP BY 1) SELECT tag, round(total_ms, 2) AS total_ms, n, last_rows, failed, round(total_ms / (SELECT max(total_ms) FROM s), 6) AS ratio FROM s")
def ag23_run_summary(spark, d):
    calls = table(spark, d, "lineitem").selectExpr("concat('f', l_partkey % 50, ':', l_linenumber) tag", "struct(l_shipdate, l_orderkey, l_suppkey) t", "l_extendedprice ms", "l_suppkey rows", "l_quantity < 50 ok")
    return rounded(rounded(a.run_summary(calls), 6, "ratio"), 2, "total_ms")


@query("SELECT 'f' || l_partkey % 50 AS tag, arg_max(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS last_rows, arg_max(l_quantity::INT, (l_shipdate, l_orderkey, l_linenumber)) AS last_columns, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def ag23_run_shapes(spark, d):
    calls = table(spark, d, "lineitem").selectExpr("concat('f', l_partkey % 50) tag", "struct(l_shipdate, l_orderkey, l_linenumber) t", "l_extendedprice ms", "l_suppkey rows", "cast(l_quantity as int) columns", "true ok")
    return a.run_summary(calls).select("tag", "last_rows", "last_columns", "n")


@query("WITH u AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, user_id, sum(round(value)::BIGINT)::BIGINT AS damage FROM events GROUP BY 1, 2) SELECT *, greatest(0.0, 30000 - total) AS remaining, total >= 30000 AS cleared FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY damage DESC, user_id)::INT AS rank, (sum(damage) OVER (PARTITION BY week))::BIGINT AS total FROM u)")
def ag25_leaderboard(spark, d):
    s = table(spark, d, "events").select(F.date_trunc("week", "ts").alias("week"), "user_id", F.round("value").cast("long").alias("damage"))
    return a.leaderboard(s, 30000)


@query("WITH c AS (SELECT user_id AS owner, ts::DATE AS day, (sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS counter FROM events), l AS (SELECT owner, day, max(counter) AS counter FROM c GROUP BY 1, 2) SELECT owner, day, gain FROM (SELECT owner, day, counter - coalesce(lag(counter) OVER (PARTITION BY owner ORDER BY day), 0) AS gain FROM l) WHERE gain > 0")
def ag26_diary(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return a.diary(table(spark, d, "events").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day"), F.sum(F.round("value").cast("long")).over(w).alias("counter")))


@query(f"WITH {M} SELECT recipe, count(price)::BIGINT AS count, round(avg(price), 4) AS avg, min(price) AS min, max(price) AS max FROM m GROUP BY 1")
def ag27_summary_table(spark, d):
    return rounded(a.aggregated(measures(spark, d), ["recipe"], "price", ["count", "avg", "min", "max"]))
