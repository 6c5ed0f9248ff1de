"""Windows, sorting, limits (WN, SO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import windows as w
from veldspar.plans.q_joins import _CAL, calendar
from veldspar.plans.registry import M, measures, query, rounded, table


@query(f"WITH {M} SELECT lot, part, step, price, round(price - avg(price) OVER (PARTITION BY lot), 6) AS deviation FROM m")
def wn1_lot_deviation(spark, d):
    return rounded(w.deviation(measures(spark, d).select("lot", "part", "step", "price"), "price", ["lot"]), 6, "deviation")


@query(f"WITH {M} SELECT lot, part, step, max(price) OVER (PARTITION BY step, chamber) AS top FROM m")
def wn2_over_two_keys(spark, d):
    return w.over(measures(spark, d), F.max("price"), ["step", "chamber"], "top").select("lot", "part", "step", "top")


@query(f"WITH {M} SELECT lot, part, step, round(price / (SELECT max(price) FROM m), 6) AS relative FROM m")
def wn3_over_all(spark, d):
    return w.over_all(measures(spark, d), F.max("price"), "top").select("lot", "part", "step", F.round(F.col("price") / F.col("top"), 6).alias("relative"))


@query("SELECT event_id, (sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM events")
def wn4_running(spark, d):
    e = table(spark, d, "events").withColumn("v", F.round("value").cast("long"))
    return w.running(e, F.sum("v"), ["user_id"], ["ts", "event_id"], "total").select("event_id", "total")


@query(f"WITH {M} SELECT lot, part, step, qty, rank() OVER (PARTITION BY step ORDER BY qty DESC)::INT AS rank, dense_rank() OVER (PARTITION BY step ORDER BY qty DESC)::INT AS dense_rank FROM m")
def wn5_ranks(spark, d):
    return w.ranks(measures(spark, d).select("lot", "part", "step", "qty"), ["step"], F.desc("qty"))


@query("SELECT event_id, lag(value) OVER x AS previous, lead(value) OVER x AS next, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS last_periods FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn6_neighbours(spark, d):
    return rounded(w.neighbours(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "previous", "next", "last_periods"), 6, "last_periods")


@query(f"WITH {M} SELECT chamber, round(avg(dev), 6) AS column_context, round(avg(price) - (SELECT avg(price) FROM m WHERE qty > 40), 6) AS axis_context FROM (SELECT *, price - avg(price) OVER () AS dev FROM m) WHERE qty > 40 GROUP BY 1")
def wn7_context(spark, d):
    m = w.over_all(measures(spark, d), F.avg("price"), "grand").withColumn("dev", F.col("price") - F.col("grand")).filter("qty > 40")
    seen = w.over_all(m, F.avg("price"), "seen")
    return rounded(seen.groupBy("chamber").agg(F.avg("dev").alias("column_context"), (F.avg("price") - F.first("seen")).alias("axis_context")), 6)


@query("WITH x AS (SELECT DISTINCT user_id AS owner, ts::DATE AS day FROM events) SELECT owner, min(day) AS first, max(day) AS last, count(*)::BIGINT AS length FROM (SELECT *, day - (row_number() OVER (PARTITION BY owner ORDER BY day))::INT AS i FROM x) GROUP BY owner, i")
def wn8_streaks(spark, d):
    return w.streaks(table(spark, d, "events").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("day")))


@query("WITH e AS (SELECT event_id, user_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT event_id, round(greatest(0, least(b + value, 1000) - greatest(b, 0)) + greatest(0, least(b + value, 3000) - greatest(b, 1000)) * 0.25 + greatest(0, b + value - greatest(b, 3000)) * 0.05, 6) AS weighted FROM e")
def wn9_tiered(spark, d):
    tiers = [(1000.0, 1.0), (3000.0, 0.25), (float("inf"), 0.05)]
    return rounded(w.tiered(table(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], tiers).select("event_id", "weighted"), 6)


@query("SELECT event_id, (t // 500 - (t - v) // 500)::BIGINT AS granted FROM (SELECT event_id, round(value)::BIGINT AS v, (sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS t FROM events)")
def wn10_carried(spark, d):
    e = table(spark, d, "events").withColumn("v", F.round("value").cast("long"))
    return w.carried(e, "v", 500, ["user_id"], ["ts", "event_id"]).select("event_id", "granted")


_COUNTER = "t AS (SELECT user_id AS session, event_id AS seq, (sum(round(value)::BIGINT - 30) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS total, CASE WHEN user_id % 10 > 0 THEN min(ts) OVER (PARTITION BY user_id) + to_days((user_id % 5)::INT) END AS created FROM events)"


@query(f"WITH {_COUNTER} SELECT session, seq, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY session ORDER BY seq), CASE WHEN created >= TIMESTAMP '2024-01-03' - INTERVAL 5 SECOND THEN 0 ELSE total END))::BIGINT AS delta FROM t WHERE created IS NOT NULL")
def wn11_token_deltas(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    by = Window.partitionBy("user_id")
    t = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.sum(F.round("value").cast("long") - 30).over(by.orderBy("event_id")).alias("total"), F.when(F.col("user_id") % 10 > 0, F.timestamp_seconds(F.unix_timestamp(F.min("ts").over(by)) + (F.col("user_id") % 5) * 86400)).alias("created"))
    return w.token_deltas(t, "2024-01-03").select("session", "seq", "delta")


@query("SELECT event_id, user_id, event_type, was FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was <> event_type")
def wn12_transitions(spark, d):
    return w.transitions(table(spark, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "was")


@query("WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT user_id, n, value AS s FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, 0.7 * s + 0.3 * value FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, round(arg_max(s, n), 6) AS smoothed FROM r GROUP BY 1")
def wn13_smoothed(spark, d):
    return rounded(w.smoothed(table(spark, d, "events"), "user_id", "event_id", "value"), 6)


@query("WITH i AS (SELECT l_suppkey AS session, l_orderkey AS seq, list(DISTINCT 'c' || l_partkey % 6) AS items, coalesce(list(DISTINCT 'c' || l_partkey % 6) FILTER (l_partkey % 6 < 3), []) AS done FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(items) OVER x AS wi, lag(done) OVER x AS wd FROM i WINDOW x AS (PARTITION BY session ORDER BY seq)) SELECT session, seq, len(list_filter(done, lambda c: NOT coalesce(list_contains(wd, c), false)))::INT AS completed, wi IS NOT NULL AND NOT list_has_any(items, wi) AS new_list FROM p")
def wn14_completions(spark, d):
    item = F.struct(F.concat(F.lit("c"), F.col("l_partkey") % 6).alias("content"), F.when(F.col("l_partkey") % 6 < 3, "completed").otherwise("pending").alias("status"))
    return w.completions(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("session"), F.col("l_orderkey").alias("seq")).agg(F.collect_set(item).alias("items")))


_ACC = "a AS (SELECT 't' || user_id % 20 AS table_name, event_id AS seq, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS kind FROM events)"


@query(f"WITH {_ACC} SELECT table_name, seq, kind, (sum(n) OVER (PARTITION BY table_name ORDER BY seq))::BIGINT AS version FROM (SELECT *, coalesce((kind = 'write' AND lag(kind) OVER (PARTITION BY table_name ORDER BY seq) = 'read')::INT, 0) AS n FROM a)")
def wn15_versions(spark, d):
    return w.versions(table(spark, d, "events").selectExpr("concat('t', user_id % 20) table_name", "event_id seq", "case when event_type in ('purchase', 'signup') then 'write' else 'read' end kind"))


@query("WITH x AS (SELECT DISTINCT l_suppkey AS k, dayofyear(l_shipdate) AS pos FROM lineitem WHERE l_quantity > 35), g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY pos) AS g FROM (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 2)::INT, 0) AS n FROM x)) SELECT k, min(pos)::INT AS first, max(pos)::INT AS last FROM g GROUP BY k, g")
def wn16_bands(spark, d):
    return w.bands(table(spark, d, "lineitem").filter("l_quantity > 35").select(F.col("l_suppkey").alias("k"), F.dayofyear("l_shipdate").alias("pos")), ["k"], "pos")


@query(f"WITH {_CAL}, n AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS t) SELECT owner, min(\"start\") FILTER (\"start\" > t) AS next_start, (min(floor(epoch(\"start\"))::BIGINT - floor(epoch(t))::BIGINT) FILTER (\"start\" > t))::BIGINT AS seconds_to_next, (max(floor(epoch(\"end\"))::BIGINT - floor(epoch(t))::BIGINT) FILTER (\"start\" <= t AND \"end\" > t))::BIGINT AS seconds_to_end, count(*) FILTER (\"start\" > t AND \"start\"::DATE = t::DATE)::BIGINT AS left_today FROM c, n GROUP BY 1")
def wn17_next_event(spark, d):
    return w.next_event(calendar(spark, d), "2024-01-15 12:00:00")


@query(f"WITH {_CAL}, days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS day), work AS (SELECT owner, day, day + INTERVAL 9 HOUR AS o, day + INTERVAL 18 HOUR AS x FROM (SELECT DISTINCT owner FROM c), days WHERE isodow(day) <= 5), mk AS (SELECT work.owner, day, x, greatest(\"start\", o) AS s, least(\"end\", x) AS e FROM work JOIN c ON c.owner = work.owner AND \"start\" < x AND \"end\" > o WHERE \"start\" < \"end\" UNION ALL SELECT owner, day, x, o, o FROM work), g AS (SELECT owner, max(e) OVER w AS slot_start, coalesce(lead(s) OVER w, x) AS slot_end FROM mk WINDOW w AS (PARTITION BY owner, day ORDER BY s, e)) SELECT * FROM g WHERE floor(epoch(slot_end)) - floor(epoch(slot_start)) >= 1800")
def wn18_free_slots(spark, d):
    return w.free_slots(calendar(spark, d), "2024-01-08", "2024-01-14")


@query("WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_custkey // 3 END AS parent, (c_acctbal * 100)::BIGINT + 1000000 AS updated FROM customer), k AS (SELECT *, lpad((1000000000000000 - updated)::VARCHAR, 16, '0') || lpad(id::VARCHAR, 12, '0') AS key FROM n), t AS (SELECT id, 0 AS depth, key AS path FROM k WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT k.id, depth + 1, path || key FROM t JOIN k ON k.parent = t.id AND k.id <> t.id) SELECT id, depth::INT AS depth, path FROM t")
def so1_session_tree(spark, d):
    return w.session_tree(table(spark, d, "customer").selectExpr("c_custkey id", "case when c_custkey % 7 > 0 and c_custkey div 3 <> c_custkey then c_custkey div 3 end parent", "cast(round(c_acctbal * 100) as bigint) + 1000000 updated"))


@query(f"WITH {M}, b AS (SELECT lot, bool_or(price > 100000) AS bad FROM m GROUP BY 1) SELECT step, eqp, count(*)::BIGINT AS lots, count(*) FILTER (bad)::BIGINT AS bad_lots, round(count(*) FILTER (bad) / count(*), 6) AS share FROM (SELECT DISTINCT step, eqp, lot FROM m) JOIN b USING (lot) GROUP BY 1, 2")
def so2_commonality(spark, d):
    return rounded(w.commonality(measures(spark, d), F.col("price") > 100000, ["step", "eqp"], "lot"), 6)


@query("SELECT 'app' || o_custkey % 5 AS app, o_orderpriority AS rule, o_orderkey AS line FROM orders WHERE o_totalprice > 400000 ORDER BY 1, 2, 3")
def so3_findings_order(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 400000").selectExpr("concat('app', o_custkey % 5) app", "o_orderpriority rule", "o_orderkey line").orderBy("app", "rule", "line")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations QUALIFY n <= 3")
def so4_outline(spark, d):
    return w.first_rows(table(spark, d, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "n")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS n FROM documents QUALIFY n <= 8")
def so5_section_cap(spark, d):
    return w.first_rows(table(spark, d, "documents"), ["source"], ["doc_id"], 8).select("source", "doc_id", "n")


@query("WITH r AS (SELECT user_id AS id, min(ts) AS started, max(ts) AS beat, max(ts) FILTER (event_type = 'error' AND user_id % 3 = 0) AS ended FROM events GROUP BY 1) SELECT id, CASE WHEN ended IS NOT NULL THEN 'done' WHEN floor(epoch(TIMESTAMP '2024-01-30 21:00:00')) - floor(epoch(beat)) > 86400 THEN 'stale' ELSE 'running' END AS state FROM r")
def so6_run_order(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("started"), F.max("ts").alias("beat"), F.max(F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), F.col("ts"))).alias("ended"))
    return w.run_order(e, "2024-01-30 21:00:00", 86400).select("id", "state")
