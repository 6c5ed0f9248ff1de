"""Calculated columns (SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import calc as c
from veldspar.plans.registry import query, rounded, table


@query("SELECT o_orderkey, round(o_totalprice * 2 - 1, 4) AS a, CASE WHEN o_custkey % 5 <> 0 THEN round(o_totalprice / (o_custkey % 5), 4) END AS b, round(pow(o_custkey % 10, 3), 4) AS p, o_totalprice > 1000 AND NOT o_orderstatus IN ('F', 'P') AS t FROM orders")
def sc1_arithmetic(spark, d):
    price, k = F.col("o_totalprice"), F.col("o_custkey")
    return rounded(table(spark, d, "orders").select("o_orderkey", (price * 2 - 1).alias("a"), c.divide(price, k % 5).alias("b"), F.pow(k % 10, F.lit(3)).alias("p"), ((price > 1000) & ~F.col("o_orderstatus").isin("F", "P")).alias("t")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END::INT AS code, nullif(o_orderstatus, 'P') IS NULL AS missing, coalesce(nullif(o_orderstatus, 'P'), '-') AS filled FROM orders")
def sc2_conditions(spark, d):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, d, "orders").select("o_orderkey", c.if_(F.col("o_totalprice") > 200000, "big", "small").alias("size"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("code"), s.isNull().alias("missing"), c.substitute_null(s, "-").alias("filled"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS l10, round(exp(c_custkey % 5), 6) AS e, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, (c_custkey % 7)::BIGINT AS m, sign(c_acctbal)::DOUBLE AS g FROM customer")
def sc3_math(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.abs(b).alias("a"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.round(F.ln(F.abs(b) + 1), 6).alias("l"), F.round(F.log10(F.abs(b) + 1), 6).alias("l10"), F.round(F.exp(F.col("c_custkey") % 5), 6).alias("e"), F.floor(b).alias("f"), F.ceil(b).alias("c"), (F.col("c_custkey") % 7).alias("m"), F.signum(b).alias("g"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name)::INT AS n, left(p_type, 3) AS lf, right(p_type, 3) AS r, substring(p_type, 2, 4) AS m, p_brand || '/' || p_type AS cat, instr(p_type, 'S')::INT AS f, replace(p_type, 'E', 'e') AS sub, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS rx, regexp_extract(p_brand, '([0-9]+)', 1) AS ex FROM part")
def sc4_strings(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower(t).alias("l"), F.length("p_name").alias("n"), c.left(t, 3).alias("lf"), c.right(t, 3).alias("r"), c.mid(t, 2, 4).alias("m"), F.concat("p_brand", F.lit("/"), t).alias("cat"), F.instr(t, "S").alias("f"), F.replace(t, F.lit("E"), F.lit("e")).alias("sub"), F.regexp_replace("p_brand", "[0-9]+", "#").alias("rx"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("ex"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, weekofyear(o_orderdate)::INT AS w, (dayofweek(o_orderdate) + 1)::INT AS dw, o_orderdate + INTERVAL 36 HOUR AS later, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT AS days FROM orders")
def sc5_dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.day(t).alias("d"), F.weekofyear(t).alias("w"), F.dayofweek(t).alias("dw"), F.timestamp_add("HOUR", F.lit(36), t).alias("later"), F.timestamp_diff("DAY", F.lit("1995-01-01").cast("timestamp"), t).alias("days"))


@query("SELECT p_partkey, try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS i, try_cast(p_type AS DOUBLE) AS x, p_size::VARCHAR AS s, try_strptime('2024-01-' || p_size, '%Y-%m-%d') AS t FROM part")
def sc6_casts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("bigint").alias("i"), F.col("p_type").try_cast("double").alias("x"), F.col("p_size").cast("string").alias("s"), F.try_to_timestamp(F.concat(F.lit("2024-01-"), F.col("p_size")), F.lit("yyyy-MM-d")).alias("t"))


@query("SELECT o_orderkey, CASE WHEN r <= 1 THEN 1.0 WHEN r <= 2 THEN 2.0 WHEN r <= 2.5 THEN 2.5 WHEN r <= 5 THEN 5.0 ELSE 10.0 END * p AS ceiling FROM (SELECT o_orderkey, pow(10.0, floor(log10(o_totalprice)))::DOUBLE AS p, round(o_totalprice / pow(10.0, floor(log10(o_totalprice))), 9) AS r FROM orders)")
def sc8_nice_ceiling(spark, d):
    return table(spark, d, "orders").select("o_orderkey", c.nice_ceiling(F.col("o_totalprice")).alias("ceiling"))


@query("SELECT doc_id, length(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(8203), ''), chr(160), ' '))::INT AS n FROM documents")
def sc9_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(c.normalised(F.col("text"))).alias("n"))


@query("SELECT item_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM benchmark")
def sc10_fragment_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", c.fragment_key(F.col("text")).alias("key"))


_NUM = "list_transform(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda n: regexp_replace(regexp_replace(regexp_replace(replace(n, ',', ''), '^0+(\\d)', '\\1'), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''))"


@query(f"SELECT doc_id, array_to_string({_NUM}, ' ') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def sc11_numbers(spark, d):
    return table(spark, d, "documents").filter(F.col("text").rlike("[0-9]")).select("doc_id", F.array_join(c.canonical_numbers(F.col("text")), " ").alias("numbers"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(password|passwd|pwd|token|secret|api_?key)(\\s*[=:]\\s*)[^\\s&;,]+', '\\1\\2***', 'g'), '(://[^/\\s:@]+:)[^@\\s/]+@', '\\1***@', 'g') AS text FROM documents WHERE contains(text, '=')")
def sc12_redacted(spark, d):
    return table(spark, d, "documents").filter(F.contains("text", F.lit("="))).select("doc_id", c.redacted(F.col("text")).alias("text"))


_RGB = "x AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 11 % 256 AS b FROM part), y AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM x), h AS (SELECT *, CASE WHEN top > low THEN CASE WHEN top = r THEN (60.0 * (g - b) / (top - low) + 360) % 360 WHEN top = g THEN 60.0 * (b - r) / (top - low) + 120 ELSE 60.0 * (r - g) / (top - low) + 240 END END AS hue FROM y)"


@query(f"WITH {_RGB} SELECT p_partkey, round(hue::DOUBLE, 6) AS hue, round((CASE WHEN top > 0 THEN (top - low) / top ELSE 0 END)::DOUBLE, 6) AS sat, round(least(abs(hue - 200), 360 - abs(hue - 200))::DOUBLE, 6) AS gap, CASE WHEN hue IS NULL THEN 'grey' WHEN hue < 15 OR hue >= 345 THEN 'red' WHEN hue < 45 THEN 'orange' WHEN hue < 70 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 200 THEN 'cyan' WHEN hue < 260 THEN 'blue' WHEN hue < 300 THEN 'purple' ELSE 'pink' END AS name FROM h")
def sc13_hue(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_partkey * 37 % 256 r", "cast(p_size * 5 % 256 as bigint) g", "p_partkey * 11 % 256 b")
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    h = c.hue(*rgb)
    return rounded(p.select("p_partkey", h.alias("hue"), c.saturation(*rgb).alias("sat"), c.hue_gap(h, F.lit(200.0)).alias("gap"), c.hue_name(h).alias("name")), 6)


def log_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", F.concat(F.lit("note "), F.col("event_id"))).otherwise(F.concat(F.element_at(F.array(F.lit("DEBUG"), F.lit("INFO"), F.lit("ERROR")), (F.col("event_id") % 3 + 1).cast("int")), F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" +"), F.floor("value"), F.lit("ms user="), F.col("user_id"), F.lit(' type="'), F.col("event_type"), F.lit('"'))).alias("line"))


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN ['DEBUG', 'INFO', 'ERROR'][event_id % 3 + 1] END AS level, CASE WHEN event_type <> 'view' THEN date_trunc('second', ts)::TIMESTAMP END AS time, CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT END AS ms, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS user_name, CASE WHEN event_type <> 'view' THEN event_type END AS type FROM events")
def sc14_log_fields(spark, d):
    f = log_lines(spark, d).withColumn("f", c.log_fields(F.col("line")))
    return f.select("event_id", "f.level", "f.time", "f.ms", F.col("f.fields")["user"].alias("user_name"), F.col("f.fields")["type"].alias("type"))


@query("SELECT event_id FROM events WHERE (event_type = 'view' OR event_id % 3 > 0) AND (event_type = 'purchase' OR event_type = 'view' AND contains('note ' || event_id, 'purchase'))")
def sc15_log_filter(spark, d):
    f = log_lines(spark, d)
    return f.filter(c.log_passes(c.log_fields(F.col("line"))["level"], F.col("line"), "INFO", "Purchase")).select("event_id")


@query("SELECT o_orderkey, substring(CASE WHEN o_custkey % 3 = 0 THEN 'title ' || o_orderkey WHEN o_custkey % 3 = 1 THEN o_orderpriority || ' ' || o_orderstatus || ', ' || o_custkey ELSE 'why ' || o_orderkey END, 1, 80) AS label FROM orders")
def sc16_wait_label(spark, d):
    k = F.col("o_custkey") % 3
    return table(spark, d, "orders").select("o_orderkey", c.wait_label(F.when(k == 0, F.concat(F.lit("title "), "o_orderkey")).otherwise(""), F.when(k == 1, F.col("o_orderpriority")), F.array("o_orderstatus", F.col("o_custkey").cast("string")), F.concat(F.lit("why "), "o_orderkey")).alias("label"))


_SQLS = ["SELECT a FROM t{k}", "select the best", "insert into t{k} select 1", "-- note\nupdate t{k} set a = 1", "Delete from t{k}", "drop it", "with x as (select 1) select 2", "create table t{k} (a int)"]


@query("SELECT o_orderkey, o_orderkey % 8 IN (0, 2, 3, 4, 6, 7) AS is_sql FROM orders")
def sc17_sql_likeness(spark, d):
    forms = F.array(*[F.lit(s) for s in _SQLS])
    text = F.replace(F.element_at(forms, (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", c.looks_like_sql(text).alias("is_sql"))


@query("SELECT o_orderkey, 'x [p' || o_orderkey % 5 || '] y [P2, p3]' AS answer, CASE WHEN o_orderkey % 5 IN (2, 3) THEN CASE WHEN o_orderkey % 5 = 2 THEN 'p2 p3' ELSE 'p3 p2' END ELSE 'p' || o_orderkey % 5 || ' p2 p3' END AS refs FROM orders")
def sc18_references(spark, d):
    raw = F.concat(F.lit("<think>[p9]\nhm</think> x [p"), F.col("o_orderkey") % 5, F.lit("] y [P2, p3]"))
    answer = c.without_reasoning(raw)
    return table(spark, d, "orders").select("o_orderkey", answer.alias("answer"), F.array_join(c.inline_references(answer), " ").alias("refs"))


@query()
def sc19_report_lines(spark, d):
    body = F.concat(F.lit('Here:\n```json\n{"lines": [{"sec": 1, "line": "total '), F.col("o_orderkey"), F.lit('", "sources": ["p1"]}, {"section": 2, "text": "b"}]}\n```'))
    return table(spark, d, "orders").select("o_orderkey", F.explode(c.report_lines(body)).alias("l")).select("o_orderkey", "l.section", "l.text", F.array_join("l.refs", " ").alias("refs"))
