"""Joins and set operations (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import joins as j
from veldspar.plans.registry import M, measures, query, rounded, table


@query("WITH l AS (SELECT o_custkey AS k FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) n FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT *, round(matched_keys / left_keys, 4) AS match_rate FROM (SELECT count(l.k)::BIGINT AS left_keys, count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL)::BIGINT AS matched_keys, count(*) FILTER (n > 1)::BIGINT AS duplicate_keys FROM l FULL JOIN r USING (k))")
def jn1_key_report(spark, d):
    return rounded(j.key_report(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k"))


_KINDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}


@query("WITH c AS (SELECT * FROM customer WHERE c_acctbal > 5000), o AS (SELECT * FROM orders WHERE o_totalprice > 100000) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*)::BIGINT AS n FROM c {v} o ON c_custkey = o_custkey" for k, v in _KINDS.items()))
def jn2_join_kinds(spark, d):
    c, o = table(spark, d, "customer").filter("c_acctbal > 5000"), table(spark, d, "orders").filter("o_totalprice > 100000")
    parts = [c.join(o, c.c_custkey == o.o_custkey, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in _KINDS]
    return j.union_rows(*parts)


@query("SELECT c_custkey, r_regionkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey) AS home FROM customer CROSS JOIN region")
def jn2_cross(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    pairs = j.cross_join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "region").select("r_regionkey"), 100)
    return pairs.join(nations, "c_nationkey", "left").select("c_custkey", "r_regionkey", F.col("n_regionkey").eqNullSafe(F.col("r_regionkey")).alias("home"))


@query("SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS first_price, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS last_price, round(avg(l_extendedprice), 7) AS mean_price FROM lineitem GROUP BY 1")
def jn3_duplicate_policy(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    a = j.first_per_key(li, "l_orderkey", F.col("o"), ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "first_price")
    b = j.last_per_key(li, "l_orderkey", F.col("o"), ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "last_price")
    m = j.mean_per_key(li, "l_orderkey", ["l_extendedprice"]).withColumnRenamed("l_extendedprice", "mean_price")
    return rounded(a.join(b, "l_orderkey").join(m, "l_orderkey"), 7, "mean_price")


@query("WITH a AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer), b AS (SELECT nullif(s_nationkey, 3) AS k, count(*) n FROM supplier GROUP BY 1) SELECT a.k, count(*)::BIGINT AS customers, max(n)::BIGINT AS suppliers FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1")
def jn4_null_safe_join(spark, d):
    a = table(spark, d, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"), "c_custkey")
    b = table(spark, d, "supplier").select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return j.null_safe_join(a, b, ["k"]).groupBy("k").agg(F.count("*").alias("customers"), F.max("n").alias("suppliers"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def jn5_union_rows(spark, d):
    return j.union_rows(table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment"), table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance"))


_CAL = "c AS (SELECT event_id AS id, user_id AS owner, ts AS \"start\", ts + to_microseconds((value * 60000000)::BIGINT) AS \"end\", event_type FROM events)"


def calendar(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("long")).alias("end"), "event_type")


@query(f"WITH {_CAL} SELECT p.id AS proposed_id, e.id AS event_id FROM c p JOIN c e ON p.\"start\" < e.\"end\" AND e.\"start\" < p.\"end\" WHERE p.id % 20 = 0 AND e.id <> p.id AND p.\"start\" < p.\"end\" AND e.\"start\" < e.\"end\"")
def jn6_overlaps(spark, d):
    c = calendar(spark, d)
    return j.overlaps(c, c.filter("id % 20 = 0")).filter("proposed_id <> event_id")  # the stated query set against all rows


_SEASONS = [(0, "new year", "12-28", "01-03"), (1, "spring", "03-01", "05-31"), (2, "launch", "2024-01-10", "2024-01-20"), (3, "winter", "12-01", "02-29")]


@query("WITH s(ord, name, f, l) AS (VALUES " + ", ".join(map(str, _SEASONS)) + "), y AS (SELECT DISTINCT ts::DATE AS day FROM events), h AS (SELECT day, arg_min(name, ord) AS season FROM (SELECT day, s.*, CASE WHEN length(f) = 5 THEN strftime(day, '%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS t FROM y, s) WHERE CASE WHEN f <= l THEN t BETWEEN f AND l ELSE t >= f OR t <= l END GROUP BY day) SELECT y.day, season, n FROM (SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1) y LEFT JOIN h USING (day)")
def jn7_seasons(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return j.seasons(days, spark.createDataFrame(_SEASONS, "ord int, name string, first string, last string"))


_NODES = "n AS (SELECT p_partkey AS node_id, p_brand AS file, p_size AS line, p_partkey % 3 AS col, p_partkey % 7 AS call_line FROM part), k AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, p_brand AS file, p_size AS line, p_partkey % 3 AS col, [l_orderkey % 7, l_linenumber] AS stack FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45)"


@query(f"WITH {_NODES} SELECT call_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY list_contains(stack, call_line) DESC, node_id) r FROM k JOIN n USING (file, line, col)) WHERE r = 1")
def jn8_call_nodes(spark, d):
    p = table(spark, d, "part")
    nodes = p.selectExpr("p_partkey node_id", "p_brand file", "p_size line", "p_partkey % 3 col", "p_partkey % 7 call_line")
    calls = table(spark, d, "lineitem").filter("l_quantity > 45").join(p, F.col("p_partkey") == F.col("l_partkey")).selectExpr("l_orderkey * 10 + l_linenumber call_id", "p_brand file", "p_size line", "p_partkey % 3 col", "array(l_orderkey % 7, cast(l_linenumber as bigint)) stack")
    return j.call_nodes(calls, nodes)


_FIND = "f AS (SELECT DISTINCT app || rule || path AS finding_id, * FROM (SELECT 'app' || l_suppkey % 5 AS app, l_returnflag AS rule, 'src/' || l_linestatus || '/f' || l_partkey % 20 AS path FROM lineitem WHERE l_quantity > 40)), w AS (SELECT s_suppkey AS waiver_id, 'app' || s_suppkey % 7 AS app, ['A', 'N', 'R', 'X'][1 + s_suppkey % 4] AS rule, CASE s_suppkey % 3 WHEN 0 THEN 'src/' || ['F', 'O'][1 + s_suppkey % 2] || '/' WHEN 1 THEN 'src/O/f' || s_suppkey % 20 ELSE CASE WHEN s_suppkey % 11 = 0 THEN '*' ELSE 'src/F/f1' END END AS files, DATE '2024-01-01' + (s_suppkey % 60)::INT AS due FROM supplier)"


def _findings(spark, d):
    f = table(spark, d, "lineitem").filter("l_quantity > 40").selectExpr("concat('app', l_suppkey % 5) app", "l_returnflag rule", "concat('src/', l_linestatus, '/f', l_partkey % 20) path").distinct().withColumn("finding_id", F.concat("app", "rule", "path"))
    w = table(spark, d, "supplier").selectExpr("s_suppkey waiver_id", "concat('app', s_suppkey % 7) app", "element_at(array('A', 'N', 'R', 'X'), cast(1 + s_suppkey % 4 as int)) rule", "case s_suppkey % 3 when 0 then concat('src/', element_at(array('F', 'O'), cast(1 + s_suppkey % 2 as int)), '/') when 1 then concat('src/O/f', s_suppkey % 20) else case when s_suppkey % 11 = 0 then '*' else 'src/F/f1' end end files", "date_add(date'2024-01-01', cast(s_suppkey % 60 as int)) due")
    return f, w


_WAIVED = f"{_FIND}, j AS (SELECT f.*, (SELECT min(waiver_id) FROM w WHERE w.app = f.app AND w.rule = f.rule AND (files = '*' OR files = path OR (files LIKE '%/' AND starts_with(path, files)))) AS waiver_id FROM f)"


@query(f"WITH {_WAIVED} SELECT * FROM j")
def jn9_waived(spark, d):
    return j.waived(*_findings(spark, d)).select("finding_id", "app", "rule", "path", "waiver_id")


@query(f"WITH {_WAIVED} SELECT * FROM (SELECT waiver_id, waiver_id NOT IN (SELECT waiver_id FROM j WHERE waiver_id IS NOT NULL) AS unused, due < DATE '2024-01-21' AS expired FROM w) WHERE unused OR expired")
def jn10_idle_waivers(spark, d):
    f, w = _findings(spark, d)
    return j.idle_waivers(w, j.waived(f, w), "2024-01-21")


@query("SELECT o_orderkey, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = o_custkey % 50 AND l_quantity = 50 AND l_shipdate <= o_orderdate) AS event FROM orders")
def jn11_as_of(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("eqp"), F.col("o_orderdate").alias("ts"))
    ev = table(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").alias("eqp"), F.col("l_shipdate").alias("ts"), F.col("l_shipdate").alias("event"))
    return j.as_of_previous(o, ev, "eqp").select("o_orderkey", "event")


@query("WITH l AS (SELECT l_orderkey AS line_id, list('[P' || l_partkey % 40 || ']' ORDER BY l_linenumber, l_partkey % 40) AS refs FROM lineitem GROUP BY 1), f AS (SELECT DISTINCT 'p' || p_partkey % 30 AS fragment_id FROM part), e AS (SELECT line_id, unnest(list_transform(refs, lambda r: lower(replace(replace(r, '[', ''), ']', '')))) AS fragment_id, unnest(range(len(refs))) AS p FROM l) SELECT line_id, fragment_id, min(p)::INT AS position FROM e WHERE fragment_id IN (SELECT fragment_id FROM f) GROUP BY 1, 2")
def jn12_references(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey line_id", "struct(l_linenumber n, l_partkey % 40 k, concat('[P', l_partkey % 40, ']') r) s").groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]).alias("refs"))
    return j.references(li, table(spark, d, "part").selectExpr("concat('p', p_partkey % 30) fragment_id"))


@query("WITH k AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"#?]*)', 1)) AS target FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, target FROM k WHERE target NOT IN (SELECT path FROM p)")
def jn13_missing_links(spark, d):
    p = table(spark, d, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), F.lit(1))).alias("target")).distinct()
    return j.missing_targets(links, p.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).distinct())


@query("WITH k AS (SELECT json_keys(props) AS k FROM events) SELECT key, problem, count(*)::BIGINT AS n FROM (SELECT 'source' AS key, 'missing' AS problem FROM k WHERE NOT list_contains(k, 'source') UNION ALL SELECT u, 'unknown' FROM (SELECT unnest(k) AS u FROM k) WHERE u NOT IN ('source')) GROUP BY 1, 2")
def jn14_key_differences(spark, d):
    return j.key_differences(table(spark, d, "events"), ["source"])


@query("WITH r AS (SELECT s_suppkey AS id, s_acctbal AS lo, s_acctbal + s_suppkey % 50 AS hi FROM supplier) SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id < y.id AND x.lo <= y.hi AND y.lo <= x.hi")
def jn15_range_conflicts(spark, d):
    return j.range_conflicts(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal lo", "s_acctbal + s_suppkey % 50 hi"), 100.0)


@query("WITH r AS (SELECT c_custkey AS k, c_nationkey AS s FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey AS k, c_nationkey + (c_custkey % 7 = 0)::INT AS s FROM customer WHERE c_custkey % 11 <> 0) SELECT k, CASE WHEN r.s IS NULL THEN 'unregistered' WHEN a.s IS NULL THEN 'missing' WHEN r.s <> a.s THEN 'wrong state' ELSE 'ok' END AS verdict FROM r FULL JOIN a USING (k)")
def jn16_reconcile(spark, d):
    c = table(spark, d, "customer")
    return j.reconciled(c.filter("c_custkey % 5 <> 0").selectExpr("c_custkey k", "c_nationkey s"), c.filter("c_custkey % 11 <> 0").selectExpr("c_custkey k", "c_nationkey + cast(c_custkey % 7 = 0 as int) s"), "k", "s")
