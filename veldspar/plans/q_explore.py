"""Sources, sinks, projection, filters, sampling, profiling (IO, PF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import explore as x
from veldspar.plans.registry import M, measures, query, rounded, table
from veldspar.sources import files
from veldspar.sources.scratch import shared_folder


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice, o_orderpriority FROM orders")
def io1_delimited_load(spark, d):
    path = shared_folder(spark, "io1")
    o = table(spark, d, "orders").select("o_orderkey", F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("o_totalprice"), "o_orderpriority")
    o.write.csv(path, header=True, sep=";", encoding="UTF-16LE", nullValue="NA")
    return files.load_delimited(spark, path, sep=";", encoding="UTF-16LE", null="NA", decimal=",", schema="o_orderkey long, o_totalprice double, o_orderpriority string")


@query("SELECT doc_id, text, lang FROM documents")
def io1_quoted_load(spark, d):
    path = shared_folder(spark, "io1q")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = table(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce(quoted(F.col("text")), F.lit("NA")), F.coalesce(quoted(F.col("lang")), F.lit("NA"))).alias("line"))
    cells.mapInPandas(_with_header, "line string").write.option("lineSep", "\n").text(path)
    return files.load_delimited(spark, path, null="NA", schema="doc_id long, text string, lang string", multiline=True)


def _with_header(chunks):
    import pandas as pd

    yield pd.DataFrame({"line": ["doc_id,text,lang"]})
    yield from chunks


@query("SELECT * FROM (SELECT 'o_orderpriority' AS column_name, count(*) FILTER (o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL)::BIGINT AS n_lost FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (try_cast(o_totalprice::VARCHAR AS DOUBLE) IS NULL) FROM orders) t, LATERAL (SELECT n_lost > 0 AS stays_text)")
def io2_demotion(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("string").alias("o_totalprice"))
    return files.demotions(o, ["o_orderpriority", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders")
def io3_pruned_read(spark, d):
    return files.pruned(spark, f"{d}/orders.parquet", "o_orderkey", "o_totalprice")


@query()
def io6_text_corpus(spark, d):
    path = shared_folder(spark, "io6")
    table(spark, d, "benchmark").select("text").repartition(4).write.text(path)
    return files.load_corpus(spark, path).select(F.length("text").alias("n_chars"), F.element_at(F.split("path", "/"), -1).endswith(".txt").alias("is_text"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-06'")
def io7_export_days(spark, d):
    return files.export_days(table(spark, d, "events"), "2024-01-02", "2024-01-05", ["event_id", "ts", "event_type"])


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def io8_csv_export(spark, d):
    path = shared_folder(spark, "io8")
    files.export_csv(table(spark, d, "nation"), path)
    return spark.read.csv(path, header=True).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n <= 3")
def io9_keep_last(spark, d):
    o = table(spark, d, "orders")
    return files.keep_last(o, "o_custkey", F.struct("o_orderdate", "o_orderkey").desc(), 3).select("o_custkey", "o_orderkey")


@query(f"WITH {M} SELECT lot, step, price FROM m WHERE chamber IN ('A', 'R') AND qty BETWEEN 10 AND 20 AND contains(lower(recipe), 'f')")
def pf1_filter_set(spark, d):
    kept = x.all_of(F.col("chamber").isin("A", "R"), x.between("qty", 10, 20), x.contains("recipe", "F"))
    return x.in_list(measures(spark, d).filter(kept), "chamber", ["A", "R"]).select("lot", "step", "price")


@query(f"WITH {M} SELECT count(*)::BIGINT AS n FROM m WHERE price BETWEEN 1000 AND 20000")
def pf2_range_count(spark, d):
    return measures(spark, d).filter(x.between("price", 1000, 20000)).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, trunc(o_totalprice)::BIGINT AS price FROM orders")
def pf3_column_edits(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return x.edited(o, rename={"o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "price"}, cast={"o_totalprice": "bigint"}, replace={"o_orderstatus": {"F": "done", "O": "open"}}, drop=("o_orderpriority",))


_P = "SELECT '{c}' AS column_name, 'double' AS kind, count(*)::BIGINT AS n, round(count(*) FILTER ({c} IS NULL) / count(*), 4) AS missing, round(min({c})::DOUBLE, 4) AS low, round(max({c})::DOUBLE, 4) AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q2, round(quantile_cont({c}, 0.75), 4) AS q3, count(DISTINCT {c})::BIGINT AS n_distinct FROM m"


@query(f"WITH {M} " + " UNION ALL ".join(_P.format(c=c) for c in ("price", "qty", "disc")))
def pf4_profile(spark, d):
    return rounded(x.profile(measures(spark, d), ["price", "qty", "disc"]))


@query()
def pf5_roles(spark, d):
    return x.roles(measures(spark, d), ["lot", "step", "chamber", "ts", "price", "bin", "die_x", "die_y"])


@query()
def pf6_sample_rows(spark, d):
    return x.sample_rows(measures(spark, d).filter("chamber = 'A'"), ["lot", "step"])


@query()
def pf7_sample_share(spark, d):
    return x.sample_share(measures(spark, d), ["lot", "step"], kept=F.col("qty") > 10).select("lot", "step", "qty")


@query(f"WITH {M}, v AS (SELECT * FROM m WHERE qty > 10) SELECT 'chamber' AS facet, chamber AS value, count(*)::BIGINT AS n, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM v GROUP BY 2 UNION ALL SELECT 'step', step::VARCHAR, count(*), NULL, NULL FROM v GROUP BY 2 UNION ALL SELECT 'price', NULL, count(price), min(price), max(price) FROM v UNION ALL SELECT 'disc', NULL, count(disc), min(disc), max(disc) FROM v")
def pf8_facets(spark, d):
    return x.facets(measures(spark, d).filter("qty > 10"), ["chamber", "step"], ["price", "disc"])


@query(f"WITH {M} SELECT step, chamber, count(*)::BIGINT AS n, count(*) FILTER (price > 50000)::BIGINT AS n_marked FROM m GROUP BY 1, 2")
def pf9_linked_marking(spark, d):
    return x.marked_counts(measures(spark, d), ["step", "chamber"], F.col("price") > 50000)


@query(f"WITH {M}, k AS (SELECT DISTINCT eqp FROM m WHERE qty = 50 AND disc > 0.09) SELECT eqp, count(*)::BIGINT AS n FROM m WHERE eqp IN (SELECT eqp FROM k) GROUP BY 1")
def pf10_frozen_marking(spark, d):
    m = measures(spark, d)
    return x.within(m, x.frozen_keys(m, (F.col("qty") == 50) & (F.col("disc") > 0.09), ["eqp"])).groupBy("eqp").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT *, n_before <> n_after AS changed FROM (SELECT count(*) FILTER (price > 50000)::BIGINT AS n_before, count(*) FILTER (price > 50000 AND chamber <> 'N')::BIGINT AS n_after FROM m)")
def pf11_marking_drift(spark, d):
    return x.marking_drift(measures(spark, d), F.col("price") > 50000, F.col("chamber") != "N")


@query(f"WITH {M}, a AS (SELECT DISTINCT lot FROM m WHERE price > 90000), b AS (SELECT DISTINCT lot FROM m WHERE price < 2000) SELECT mark, count(*)::BIGINT AS n, round(avg(price), 4) AS mean FROM m JOIN (SELECT lot, 'A' AS mark FROM a UNION ALL SELECT lot, 'B' FROM b WHERE lot NOT IN (SELECT lot FROM a)) USING (lot) GROUP BY 1")
def pf12_two_groups(spark, d):
    m = measures(spark, d)
    a, b = x.frozen_keys(m, F.col("price") > 90000, ["lot"]), x.frozen_keys(m, F.col("price") < 2000, ["lot"])
    return rounded(x.two_groups(m, a, b).groupBy("mark").agg(F.count("*").alias("n"), F.avg("price").alias("mean")))


@query("SELECT user_id % 4 AS inst, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n <= 20")
def pf13_latest(spark, d):
    e = table(spark, d, "events").withColumn("inst", F.col("user_id") % 4)
    return x.latest(e, F.struct("ts", "event_id").desc(), 20, ["inst"]).select("inst", "user_id", "event_id")


@query("WITH c AS (SELECT p_brand, count(*) c FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, p_brand) n FROM c) SELECT CASE WHEN n <= 12 THEN p_brand ELSE 'other' END AS category, sum(c)::BIGINT AS n FROM r GROUP BY 1")
def pf14_top_categories(spark, d):
    return x.top_categories(table(spark, d, "part"), "p_brand", 12)


@query()
def pf15_size_regime(spark, d):
    m = measures(spark, d)
    regime = x.size_regime(m.count())
    return rounded(x.profile(m, ["price"], exact=regime != "approximate")).withColumn("regime", F.lit(regime))
