"""Properties and known answers where SQL has no twin, and small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from veldspar.functions import calc
from veldspar.operators import evidence, explore, joins, lineage, verdicts, windows
from veldspar.plans import catalog
from veldspar.sources import files

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(name, spark):
    assert catalog.queries()[name](spark, SF).count() >= 0


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    effects = [abs(r.effect) for r in rows]
    assert rows and effects == sorted(effects, reverse=True)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "numbers"), [("1,500 and 09", ["1500", "9"]), ("3.50 0.0 7", ["3.5", "0", "7"]), ("none", []), ("12,34", ["12", "34"])])
def test_canonical_numbers(spark, text, numbers):
    assert one(spark, calc.canonical_numbers(F.lit(text))) == numbers


def test_fragments_keep_their_text(spark):
    text = "\n".join(["Short.", "Another line. " * 60, "> quoted", "---", "word" * 200, "end"])
    df = spark.createDataFrame([("t", 1, text), ("t", 2, ""), ("t", 3, "a\tb\n1\t2\n3\t4")], "topic string, paste_id long, text string")
    got = {}
    for r in evidence.fragments(df).orderBy("paste_id", "position").collect():
        got.setdefault(r.paste_id, []).append(r.text)
    assert all(len(x) <= evidence.LONGEST for x in got[1])
    letters = lambda s: "".join(s.split())
    assert letters("".join(got[1])) == letters(text.replace("> quoted", "").replace("---", ""))
    assert 2 not in got and got[3] == ["a: 1 · b: 2", "a: 3 · b: 4"]


@pytest.mark.parametrize(("text", "kind"), [("a\tb\nc\td", "table"), ("From: x\nSubject: y\nhi", "mail"), ("10:00 a\n10:01 b\n10:02 c", "chat"), ("", "text"), ("plain", "text")])
def test_kinds(spark, text, kind):
    assert one(spark, evidence.kind(F.lit(text))) == kind


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert sorted(r.deviation for r in windows.deviation(df, "v", ["k"]).collect()) == [-1.0, 0.0, 1.0]
    assert joins.null_safe_join(df, df.select("k", F.col("v").alias("w")), ["k"]).count() == 5


def test_token_deltas(spark):
    rows = [(1, 1, "2024-01-01", 100), (1, 2, "2024-01-01", 90), (1, 3, "2024-01-01", 95), (2, 1, "2024-02-01", 7), (3, 1, None, 50)]
    df = spark.createDataFrame(rows, "session int, seq int, created string, total int").withColumn("created", F.col("created").cast("timestamp"))
    got = {(r.session, r.seq): r.delta for r in windows.token_deltas(df, "2024-01-15").collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 5, (2, 1): 7}


CLOSED = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(t * t + 2), 3: lambda t: 1 - 2 / math.pi * (t / math.sqrt(3) / (1 + t * t / 3) + math.atan(t / math.sqrt(3)))}


@pytest.mark.parametrize("df", CLOSED)
@pytest.mark.parametrize("t", [0.0, 0.01, 0.5, 2.0, 12.0, 300.0])
def test_t_distribution(t, df):
    assert abs(verdicts.t_two_sided(t, df) - CLOSED[df](t)) < 1e-9


def test_permutations_do_not_depend_on_partitions(spark):
    lots = spark.createDataFrame([(i, "A" if i % 2 else "B", float(i * 37 % 11 + (i % 2) * 4)) for i in range(40)], "lot long, grp string, x double")
    a, b = (verdicts.permutation_test(x, "grp", "x", "lot", 200).first() for x in (lots, lots.repartition(7)))
    assert a == b and a.p_value < 0.05


def test_lineage_of_awkward_statements(spark):
    sql = "/* ; FROM no */ INSERT OVERWRITE TABLE a SELECT ';' FROM a JOIN b USING (k); WITH RECURSIVE r AS (SELECT 1 FROM s), q AS (SELECT * FROM r) SELECT * FROM q; MERGE INTO m USING u ON m.k = u.k; DROP TABLE x"
    stmts = lineage.statements(spark.createDataFrame([(1, sql)], "text_id long, sql string"))
    assert [r.k for r in stmts.orderBy("pos").select(lineage.kind(F.col("sql")).alias("k")).collect()] == ["insert", "select", "merge", "drop"]
    assert {(r.pos, r.table_name) for r in lineage.writes(stmts).collect()} == {(0, "a"), (2, "m")}
    assert {(r.pos, r.table_name) for r in lineage.reads(stmts).collect()} >= {(0, "a"), (0, "b"), (1, "s"), (2, "u")}
    assert {(r.cte, r.table_name) for r in lineage.cte_closure(stmts).collect()} == {("r", "s"), ("q", "s")}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a = {r.id for r in explore.sample_rows(df, ["id"], 50).collect()}
    assert a == {r.id for r in explore.sample_rows(df.repartition(9), ["id"], 50).collect()} and len(a) == 50


def test_delimited_load(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름;값\n가;1,5\n나;x\nNA;2\n".encode("cp949"))
    got = files.load_delimited(spark, str(tmp_path / "a.csv"), sep=";", encoding="cp949", null="NA", decimal=",", schema="`이름` string, `값` double").collect()
    assert [tuple(r) for r in got] == [("가", 1.5), ("나", None), (None, 2.0)]


def stmts_of(spark, sql):
    return lineage.statements(spark.createDataFrame([(1, sql)], "text_id long, sql string"))


def test_lineage_of_lists_quotes_and_nested_bodies(spark):
    sql = 'SELECT x.k, 표.값 FROM a x, "Sch"."Big" AS y , 표 JOIN `d` ON x.k = d.k WHERE f(x.v) > 1; WITH c AS (SELECT sum(coalesce(x, 1)) FROM t WHERE y IN (SELECT y FROM u)), d (p) AS (SELECT p FROM c JOIN generate_series(1, 2) ON 1 = 1) SELECT * FROM d'
    stmts = stmts_of(spark, sql)
    assert {(r.pos, r.table_name) for r in lineage.reads(stmts).collect()} == {(0, "a"), (0, "sch.big"), (0, "표"), (0, "d"), (1, "t"), (1, "u")}
    assert {(r.cte, r.table_name) for r in lineage.cte_closure(stmts).collect()} == {("c", "t"), ("c", "u"), ("d", "t"), ("d", "u")}
    assert {(r.table_name, r.column_name) for r in lineage.columns_used(stmts).filter("pos = 0").collect()} == {("a", "k"), ("a", "v"), ("표", "값"), ("d", "k")}
    counted = lineage.counts(stmts).first()
    assert (counted.queries, counted.tables, counted.joins, counted.writes) == (2, 6, 4, 0)  # two of them are commas


def test_recursive_tables_settle(spark):
    sql = "WITH RECURSIVE r AS (SELECT 1 FROM s UNION ALL SELECT 1 FROM r JOIN z ON 1 = 1) SELECT * FROM r"
    assert {(r.cte, r.table_name) for r in lineage.cte_closure(stmts_of(spark, sql)).collect()} == {("r", "s"), ("r", "z")}


def test_parameters_come_from_the_last_earlier_producer(spark):
    producers = spark.createDataFrame([("f", 1, "a"), ("f", 3, "a"), ("f", 5, "a"), ("g", 1, "a")], "file string, seq long, name string")
    texts = spark.createDataFrame([("f", 5, "{a} {a} {b}"), ("f", 1, "{a}"), ("g", 9, "{a}")], "file string, seq long, sql string")
    assert {(r.file, r.consumer, r.name, r.producer) for r in lineage.parameter_edges(texts, producers).collect()} == {("f", 5, "a", 3), ("g", 9, "a", 1)}


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 1.0, 3.0] + [float(i) for i in range(10, 500)]
    got = {r.v: r.rank for r in verdicts.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "rank").collect()}
    ordered = sorted(v for v in values if v is not None)
    assert got == {v: (2 * ordered.index(v) + ordered.count(v) + 1) / 2 for v in ordered}


def test_quotas_by_brute_force(spark):
    rows = [(None if i % 7 == 0 else f"t{i % 3}", i, i * 37 % 90, i % 5) for i in range(300)]
    used, expected = {}, set()
    for t, i, c, f in rows:
        chars, frags = used.get(t, (0, 0))
        if c <= 80 and chars + c <= 900 and frags + f <= 60:
            used[t] = (chars + c, frags + f)
            expected.add((t, i))
    df = spark.createDataFrame(rows, "topic string, paste_id long, chars long, frags long").repartition(5)
    assert {tuple(r) for r in evidence.within_quota(df, 80, 900, 60).collect()} == expected


def test_deep_trees_raise(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(5)], "id long, parent long, updated long")
    assert sorted((r.id, r.depth) for r in windows.session_tree(nodes).collect()) == [(i, i) for i in range(5)]
    with pytest.raises(RuntimeError):
        windows.session_tree(nodes, most_depth=3)


def test_colours_in_all_forms(spark):
    text = "#fff; #0A0b0C rgb(1, 20,300) rgba(0,0,0,.5) &#123; x#abc #12345 ##123456 #abcd"
    assert one(spark, evidence.colours(F.lit(text))) == ["ffffff", "0a0b0c", "0114ff", "000000"]


def test_cross_joins_check_the_small_side(spark):
    assert joins.cross_join(spark.range(50), spark.range(3).toDF("k"), 3).count() == 150
    with pytest.raises(ValueError):
        joins.cross_join(spark.range(50), spark.range(4).toDF("k"), 3)


def test_first_lines_of_secrets(spark):
    keys = ["sk-" + "a1B_" * 6, "ghp_" + "Ab1" * 12, "AKIA" + "A1B2" * 4, "xoxb-" + "12345-abcde", "-----BEGIN EC " + "PRIVATE KEY-----"]
    df = spark.createDataFrame([(i, "first\n" * i + k + "\n" + k) for i, k in enumerate(keys)] + [(9, "AKIA" + "a1b2" * 4), (10, ""), (11, None)], "doc_id long, text string")
    assert {tuple(r) for r in evidence.first_lines(df, evidence.SECRETS).select("doc_id", "rule", "line").collect()} == {(i, n, i + 1) for i, n in enumerate(evidence.SECRETS)}


def test_text_corpus_reads_cells(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n\n# 가\n")
    (tmp_path / "b.ipynb").write_text('{"cells": [{"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": ["a = 1\\n", "b"]}, {"cell_type": "code", "source": []}, {"cell_type": "code", "source": ["c"]}]}')
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n\n# 가\n", "b.ipynb": "a = 1\nb\n\nc"}


def test_report_lines_survive_fences_and_aliases(spark):
    assert catalog.queries()["sc19_report_lines"](spark, SF).limit(1).count() == 1


def test_call_nodes_of_a_crowded_place(spark):
    """Against the window over all nodes of a call's place; the plan has none, so that a place may hold any number."""
    from pyspark.sql import Window

    nodes = spark.range(400).selectExpr("id node_id", "'f' file", "cast(id % 2 as int) line", "0 col", "if(id % 5 = 0, null, id % 11) call_line")
    calls = spark.range(60).selectExpr("id call_id", "'f' file", "cast(id % 3 as int) line", "0 col", "case id % 4 when 0 then null when 1 then array(id % 13, null) when 2 then array(id % 13, id % 7) else array() end stack")
    w = Window.partitionBy("call_id").orderBy(F.array_contains("stack", F.col("call_line")).desc(), "node_id")
    want = calls.join(nodes, ["file", "line", "col"]).withColumn("n", F.row_number().over(w)).filter("n = 1").select("call_id", "node_id")
    found = joins.call_nodes(calls, nodes)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_grid_fit_holds_no_source_in_a_task(spark):
    from veldspar.operators import process

    df = spark.createDataFrame([("a", 3, 5), ("a", 7, 9), (None, 2, 2), (None, 4, 3)], "source string, die_x int, die_y int")
    found = process.grid_fit(df, "source", 1)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("die_x", "grid_x", "grid_y").collect())) == [(2, 1, 0), (3, 4, 0), (4, 0, 2), (7, 0, 4)]
