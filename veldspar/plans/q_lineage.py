"""Lineage over statements generated from orders (LN, AG22): the twin states the expected edges by formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import lineage as g
from veldspar.plans.registry import query, rounded, table


#: Statements of more shapes, with what is expected of them: reads, joins (kind, table), tests (kind, text), columns (table,
#: column), CTE reads (cte, table), and the flags star, aggregate, window, distinct, limit. #t, #u and #v are numbers of tables.
SHAPES = [
    ("SELECT EXTRACT(YEAR FROM d) AS y, CAST(v AS DECIMAL(10,2)) FROM t#t WHERE TRIM(both FROM x) = 'a' AND p IS NOT DISTINCT FROM q LIMIT 3", ["t#t"], [], [("filter", "TRIM(both FROM x) = 'a'"), ("filter", "p IS NOT DISTINCT FROM q")],
     [("t#t", c) for c in "dvxpq"], [], (False, False, False, False, True)),
    ("SELECT DISTINCT a FROM {schema}.o#u WHERE a = 1 AND b = 2 OR c = CASE WHEN d = 1 OR e = 2 THEN 1 ELSE 0 END", ["{schema}.o#u"], [], [("or", "a = 1 AND b = 2 OR c = CASE WHEN d = 1 OR e = 2 THEN 1 ELSE 0 END")],
     [("{schema}.o#u", c) for c in "abcde"], [], (False, False, False, True, False)),
    ("SELECT a.x FROM t#t a, u#u b NATURAL JOIN v1 LEFT ANTI JOIN v2 ON v2.k = a.k LEFT SEMI JOIN v3 ON v3.k = b.k WHERE (a.p = 1 OR b.q = 2) AND a.r = b.r", ["t#t", "u#u", "v1", "v2", "v3"], [("CROSS", "u#u"), ("NATURAL", "v1"), ("LEFT ANTI", "v2"), ("LEFT SEMI", "v3")],
     [("join", "v2.k = a.k"), ("join", "v3.k = b.k"), ("filter", "(a.p = 1 OR b.q = 2)"), ("join", "a.r = b.r")], [("t#t", c) for c in "xkpr"] + [("u#u", c) for c in "kqr"] + [("v2", "k"), ("v3", "k")], [], (False, False, False, False, False)),
    ("SELECT * FROM (SELECT a, rank() OVER (PARTITION BY g ORDER BY a) AS n FROM t#t) x JOIN (u#u u FULL OUTER JOIN v#v w ON u.k = w.k) ON x.a = u.a", ["t#t", "u#u", "v#v"], [("INNER", "u#u"), ("FULL", "v#v")], [("join", "u.k = w.k"), ("join", "x.a = u.a")],
     [("t#t", "a"), ("t#t", "g"), ("u#u", "k"), ("u#u", "a"), ("v#v", "k")], [], (True, False, True, False, False)),
    ("WITH p AS MATERIALIZED (SELECT k FROM t#t WHERE ((((((((z)))))))) > 1), q AS (SELECT p.k FROM p JOIN v#v w USING (k)) SELECT k FROM q WHERE k IN (SELECT max(s.k) FROM u#u s WHERE s.j = q.j)", ["t#t", "v#v", "u#u"], [("INNER", "v#v")],
     [("filter", "((((((((z)))))))) > 1"), ("sub", "k IN (SELECT max(s.k) FROM u#u s WHERE s.j = q.j)"), ("join", "s.j = q.j")], [("t#t", "k"), ("t#t", "z"), ("p", "k"), ("v#v", "k"), ("q", "k"), ("u#u", "k"), ("u#u", "j"), ("q", "j")], [("p", "t#t"), ("q", "t#t"), ("q", "v#v")], (False, True, False, False, False)),
]


def texts(spark, d):
    k = F.col("o_orderkey")
    n = lambda prefix, v: F.concat(F.lit(prefix), v)
    k5 = k % 5
    select = F.concat(F.lit("SELECT a.x, sum(b.y) AS s FROM "), F.when(k5 == 0, "c").otherwise(n("t", (k + 1) % 20)), F.lit(" a "), F.when(k % 3 == 0, "LEFT OUTER JOIN").otherwise("JOIN"), n(" u", k % 7), n(" b ON a.id = b.id WHERE a.v > ", k % 9), F.lit(" AND b.w BETWEEN 1 AND 5 AND a.z = 'FROM x; y'\nGROUP BY a.x"))
    main = F.when(k5 == 0, F.concat(n("CREATE TABLE t", k % 20), n(" AS WITH c AS (SELECT * FROM v", k % 4), F.lit(") "), select)).when(k5 <= 2, F.concat(n("INSERT INTO t", k % 20), F.lit(" "), select)).when(k5 == 3, select).otherwise(F.concat(n("UPDATE t", k % 20), n(" SET x = 1 WHERE id = ", k)))
    shape = F.element_at(F.array(*[F.lit(x[0]) for x in SHAPES]), F.greatest(_shape(k), F.lit(1)))
    filled = F.replace(F.replace(F.replace(shape, F.lit("#t"), ((k + 1) % 20).cast("string")), F.lit("#u"), (k % 7).cast("string")), F.lit("#v"), (k % 4).cast("string"))
    whole = F.when(_shape(k) > 0, filled).otherwise(main)
    orders = table(spark, d, "orders").repartition(spark.sparkContext.defaultParallelism)  # one file, but a statement takes time
    return orders.select(k.alias("text_id"), F.concat(whole, F.when(k % 4 == 0, F.concat(n("; /* ; */ DELETE FROM t", k % 20), F.lit(" WHERE id = 1 -- done; really"))).otherwise("")).alias("sql"))


def _shape(k):
    return F.when(k % 5 == 3, F.floor(k / 5) % (len(SHAPES) + 1)).otherwise(0).cast("int")


def stmts(spark, d):
    return g.statements(texts(spark, d))


def _quoted(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _expected(column: int) -> str:
    """VALUES of what is expected of the shapes, by their numbers."""
    rows = [(h, *((x,) if isinstance(x, str) else x)) for h, shape in enumerate(SHAPES, 1) for x in shape[column]]
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + ")"


def _filled(x: str) -> str:
    return f"replace(replace(replace({x}, '#t', ((k + 1) % 20)::VARCHAR), '#u', (k % 7)::VARCHAR), '#v', (k % 4)::VARCHAR)"


def _counted(column: int) -> str:
    return "CASE h " + " ".join(f"WHEN {h} THEN {len(x[column])}" for h, x in enumerate(SHAPES, 1))


_S = f"""k AS (SELECT o_orderkey AS k, o_orderkey % 5 AS f, CASE WHEN o_orderkey % 5 = 3 THEN (o_orderkey // 5) % {len(SHAPES) + 1} ELSE 0 END AS h FROM orders),
s AS (SELECT k AS text_id, 0 AS pos, CASE WHEN f = 0 THEN 'create' WHEN f <= 2 THEN 'insert' WHEN f = 3 THEN 'select' ELSE 'update' END AS kind, h FROM k UNION ALL SELECT k, 1, 'delete', 0 FROM k WHERE k % 4 = 0),
r AS (SELECT k AS text_id, 0 AS pos, 'v' || k % 4 AS table_name FROM k WHERE f = 0 UNION ALL SELECT k, 0, 't' || (k + 1) % 20 FROM k WHERE f BETWEEN 1 AND 3 AND h = 0 UNION ALL SELECT k, 0, 'u' || k % 7 FROM k WHERE f < 4 AND h = 0
 UNION ALL SELECT k, 0, {_filled('x.t')} FROM k JOIN {_expected(1)} x(h, t) USING (h)),
w AS (SELECT text_id, pos, 't' || text_id % 20 AS table_name FROM s WHERE kind <> 'select')"""


@query(f"WITH {_S} SELECT text_id, count(*)::BIGINT AS n FROM s GROUP BY 1")
def ln1_statements(spark, d):
    return stmts(spark, d).groupBy("text_id").agg(F.count("*").alias("n"))


@query(f"WITH {_S} SELECT text_id, pos::INT AS pos, kind FROM s")
def ln2_kinds(spark, d):
    return stmts(spark, d).select("text_id", "pos", g.kind(F.col("sql")).alias("kind"))


@query(f"WITH {_S} SELECT text_id, pos::INT AS pos, table_name FROM r")
def ln3_reads(spark, d):
    return g.reads(stmts(spark, d))


@query(f"WITH {_S} SELECT text_id, pos::INT AS pos, table_name FROM w")
def ln4_writes(spark, d):
    return g.writes(stmts(spark, d))


@query(f"WITH {_S} SELECT k AS text_id, 0::INT AS pos, 'c' AS cte, 'v' || k % 4 AS table_name FROM k WHERE f = 0 UNION ALL SELECT k, 0, x.c, {_filled('x.t')} FROM k JOIN {_expected(5)} x(h, c, t) USING (h)")
def ln5_cte_reads(spark, d):
    return g.cte_closure(stmts(spark, d))


@query(f"WITH {_S} SELECT k AS text_id, 0::INT AS pos, CASE WHEN k % 3 = 0 THEN 'LEFT' ELSE 'INNER' END AS kind, 'u' || k % 7 AS table_name FROM k WHERE f < 4 AND h = 0 UNION ALL SELECT k, 0, x.j, {_filled('x.t')} FROM k JOIN {_expected(2)} x(h, j, t) USING (h)")
def ln6_joins(spark, d):
    return g.joins(stmts(spark, d))


@query(f"WITH {_S} SELECT k AS text_id, 0::INT AS pos, u.kind, replace(u.text, '#', (k % 9)::VARCHAR) AS text FROM k, (VALUES ('join', 'a.id = b.id'), ('filter', 'a.v > #'), ('filter', 'b.w BETWEEN 1 AND 5'), ('filter', 'a.z = ''FROM x; y''')) u(kind, text) WHERE f < 4 AND h = 0 UNION ALL SELECT k, 0, x.p, {_filled('x.t')} FROM k JOIN {_expected(3)} x(h, p, t) USING (h) UNION ALL SELECT k, 0, 'filter', 'id = ' || k FROM k WHERE f = 4 UNION ALL SELECT k, 1, 'filter', 'id = 1' FROM k WHERE k % 4 = 0")
def ln7_predicates(spark, d):
    return g.predicates(stmts(spark, d))


@query(f"""WITH {_S} SELECT k AS text_id, 0::INT AS pos, CASE split_part(c, '.', 1) WHEN 'a' THEN CASE WHEN f = 0 THEN 'c' ELSE 't' || (k + 1) % 20 END ELSE 'u' || k % 7 END AS table_name, split_part(c, '.', 2) AS column_name FROM k, (SELECT unnest(['a.x', 'b.y', 'a.id', 'b.id', 'a.v', 'b.w', 'a.z']) AS c) WHERE f < 4 AND h = 0
UNION ALL SELECT k, 0, 'v' || k % 4, '*' FROM k WHERE f = 0 UNION ALL SELECT k, 0, {_filled('x.t')}, x.c FROM k JOIN {_expected(4)} x(h, t, c) USING (h)""")
def ln8_columns(spark, d):
    return g.columns_used(stmts(spark, d))


@query(f"WITH {_S} SELECT text_id, pos::INT AS pos, kind = 'create' AS star, kind NOT IN ('update', 'delete') AS aggregate, false AS \"window\", false AS \"distinct\", false AS \"limit\" FROM s WHERE h = 0 UNION ALL SELECT text_id, pos, x.* EXCLUDE (h) FROM s JOIN (VALUES {', '.join(str((h, *x[6])) for h, x in enumerate(SHAPES, 1))}) x(h, a, b, c, d, e) USING (h)")
def ln9_flags(spark, d):
    return g.flags(stmts(spark, d))


@query(f"WITH {_S} SELECT table_name AS source, 'q' || text_id || '.' || pos AS target, 'read' AS kind FROM r UNION ALL SELECT 'q' || text_id || '.' || pos, table_name, 'write' FROM w")
def ln10_graph(spark, d):
    return g.graph(stmts(spark, d))


@query(f"WITH {_S} SELECT table_name, CASE WHEN bool_or(x) AND bool_or(NOT x) THEN 'temp' WHEN bool_or(x) THEN 'source' ELSE 'sink' END AS role FROM (SELECT table_name, true AS x FROM r UNION ALL SELECT table_name, false FROM w) GROUP BY 1")
def ln11_roles(spark, d):
    return g.roles(stmts(spark, d))


@query("WITH o AS (SELECT o_custkey AS file, o_orderkey AS seq, 'r' || o_orderkey % 3 AS name, 'r' || (o_orderkey + 1) % 3 AS wants FROM orders) SELECT c.file, c.seq AS consumer, c.wants AS name, max(p.seq) AS producer FROM o c JOIN o p ON p.file = c.file AND p.name = c.wants AND p.seq < c.seq GROUP BY 1, 2, 3")
def ln12_parameters(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey file", "o_orderkey seq", "concat('r', o_orderkey % 3) name", "concat('SELECT 1 WHERE x = {r', (o_orderkey + 1) % 3, '} OR y = {r', (o_orderkey + 1) % 3, '}') sql")
    return g.parameter_edges(o.select("file", "seq", "sql"), o.select("file", "seq", "name"))


def _code(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("a = pd.read_csv('in"), F.col("p_partkey") % 9, F.lit(".csv')\nb = a.merge(c, on=['k'], how='left')\nd = concat([a, b])\nd.to_parquet('out"), F.col("p_partkey") % 5, F.lit("')")).alias("code"))


@query("SELECT p_partkey AS text_id, unnest(['merge', 'concat']) AS op, unnest(['left', 'inner']) AS how, unnest(['''k''', '']) AS keys FROM part")
def ln13_merges(spark, d):
    return g.merges(_code(spark, d))


@query("SELECT p_partkey AS text_id, unnest(['input', 'output']) AS side, unnest(['read_csv', 'to_parquet']) AS call, unnest(['in' || p_partkey % 9 || '.csv', 'out' || p_partkey % 5]) AS target FROM part")
def ln14_inputs_outputs(spark, d):
    return g.inputs_outputs(_code(spark, d))


@query(f"WITH {_S} SELECT table_name, text_id, bool_or(x) AS read, bool_or(NOT x) AS written FROM (SELECT table_name, text_id, true AS x FROM r UNION ALL SELECT table_name, text_id, false FROM w) GROUP BY 1, 2")
def ln15_summary(spark, d):
    return g.summary(stmts(spark, d))


@query("WITH e AS (SELECT event_id AS call_id, ts, CASE WHEN event_type <> 'error' THEN ts + to_microseconds((value * 1000)::BIGINT) END AS ended, max(ts) OVER (PARTITION BY user_id) AS run_end, event_type <> 'view' AS ok FROM events) SELECT call_id, round((epoch_us(coalesce(ended, run_end)) - epoch_us(ts)) / 1000, 3) AS ms, ended IS NULL OR NOT ok AS failed FROM e")
def ln16_finished_calls(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    calls = e.select(F.col("event_id").alias("call_id"), F.col("ts").alias("started"), F.when(F.col("event_type") != "error", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long"))).alias("ended"), F.max("ts").over(Window.partitionBy("user_id")).alias("run_end"), (F.col("event_type") != "view").alias("ok"))
    return rounded(g.finished_calls(calls), 3)


@query(f"""WITH {_S}, t AS (SELECT text_id, count(DISTINCT table_name) AS tables FROM (SELECT text_id, table_name FROM r UNION ALL SELECT text_id, table_name FROM w) GROUP BY 1)
SELECT k AS text_id, (1 + (k % 4 = 0)::INT)::BIGINT AS queries, coalesce(tables, 0)::BIGINT AS tables, ({_counted(2)} ELSE (f < 4)::INT END)::BIGINT AS joins, ({_counted(3)} ELSE CASE WHEN f < 4 THEN 4 ELSE 1 END END + (k % 4 = 0)::INT)::BIGINT AS predicates,
((f <> 3)::INT + (k % 4 = 0)::INT)::BIGINT AS writes, (h = 2)::BIGINT AS params FROM k LEFT JOIN t ON text_id = k""")
def ag22_lineage_counts(spark, d):
    return g.counts(stmts(spark, d))


@query("SELECT p_partkey AS text_id, 2::BIGINT AS merges, 1::BIGINT AS inputs, 1::BIGINT AS outputs FROM part")
def ag22_code_counts(spark, d):
    return g.code_counts(_code(spark, d))
