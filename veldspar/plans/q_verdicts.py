"""Statistical verdicts (SV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import verdicts as v
from veldspar.plans.registry import M, measures, query, rounded

_G = "g AS (SELECT wlot AS lot, eqp, step, ts, chamber, price + CASE WHEN eqp % 2 = 0 THEN 500 ELSE 0 END AS x, qty, bin, CASE WHEN eqp % 2 = 0 THEN 'A' ELSE 'B' END AS grp FROM m), l AS (SELECT lot, grp, avg(x) AS x FROM g GROUP BY 1, 2)"


def groups(spark, d):
    m = measures(spark, d)
    return m.select(F.col("wlot").alias("lot"), "eqp", "step", "ts", "chamber", (F.col("price") + F.when(F.col("eqp") % 2 == 0, 500).otherwise(0)).alias("x"), "qty", "bin", F.when(F.col("eqp") % 2 == 0, "A").otherwise("B").alias("grp"))


def lots(spark, d):
    return groups(spark, d).groupBy("lot", "grp").agg(F.avg("x").alias("x"))


@query()
def sva_permutation(spark, d):
    return rounded(v.permutation_test(lots(spark, d), "grp", "x", "lot"), 6)


@query(f"WITH {M}, {_G}, s AS (SELECT avg(x) FILTER (grp = 'A') AS ma, avg(x) FILTER (grp = 'B') AS mb, var_samp(x) FILTER (grp = 'A') AS va, var_samp(x) FILTER (grp = 'B') AS vb, count(*) FILTER (grp = 'A')::BIGINT AS n_a, count(*) FILTER (grp = 'B')::BIGINT AS n_b FROM l) SELECT round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, n_a, n_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 4) AS effect, round(100 * (ma - mb) / 100000, 4) AS percent_of_spec FROM s")
def svb_effect_size(spark, d):
    return rounded(v.effect_size(lots(spark, d), "grp", "x", 100000))


_WELCH = "s AS (SELECT avg(x) FILTER (grp = 'A') - avg(x) FILTER (grp = 'B') AS diff, var_samp(x) FILTER (grp = 'A') / count(*) FILTER (grp = 'A') AS a, var_samp(x) FILTER (grp = 'B') / count(*) FILTER (grp = 'B') AS b, count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb FROM {t}), w AS (SELECT diff, diff / sqrt(a + b) AS t, pow(a + b, 2) / (a * a / (na - 1) + b * b / (nb - 1)) AS df FROM s)"


@query(f"WITH {M}, {_G}, {_WELCH.format(t='l')} SELECT round(diff, 3) AS diff, round(t, 4) AS t, round(df, 3) AS df FROM w")
def svc_welch(spark, d):
    return rounded(rounded(v.welch(lots(spark, d), "grp", "x").drop("p_value"), 3, "diff", "df"), 4, "t")


_AN = "q AS (SELECT chamber, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM g GROUP BY 1), z AS (SELECT sum(n)::BIGINT AS n, count(*)::BIGINT AS k, (sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n)) / (count(*) - 1) AS msb, sum((n - 1) * var) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM q)"


@query(f"WITH {M}, {_G}, {_AN} SELECT n, k, round(msb / 1000) AS ms_between, round(msw / 1000) AS ms_within, round(msb / msw, 4) AS f, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM z")
def svc_anova(spark, d):
    a = v.anova(groups(spark, d), "chamber", "x")
    return a.select("n", "k", F.round(F.col("ms_between") / 1000).alias("ms_between"), F.round(F.col("ms_within") / 1000).alias("ms_within"), F.round("f", 4).alias("f"), F.round("icc", 6).alias("icc"))


_RK = "r AS (SELECT grp, qty, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS r FROM g)"


@query(f"WITH {M}, {_G}, {_RK}, s AS (SELECT count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY grp), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM g GROUP BY qty)), h AS (SELECT 12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1) AS h, sum(n) AS n FROM s) SELECT round(h, 4) AS h, round(h / (1 - ties / (n * n * n - n)), 4) AS h_corrected FROM h, t")
def svc_kruskal(spark, d):
    return rounded(v.kruskal(groups(spark, d), "grp", "qty"))


#: A seventh of the rows has no value, a fifth of the lots no group.
_HOLES = "o AS (SELECT CASE WHEN lot % 5 > 0 THEN grp END AS grp, CASE WHEN (lot + step) % 7 > 0 THEN qty END AS qty, CASE WHEN (lot + step) % 7 > 0 THEN bin END AS bin FROM g), gq AS (SELECT grp, qty FROM o WHERE grp IS NOT NULL AND qty IS NOT NULL), gb AS (SELECT grp, bin FROM o WHERE grp IS NOT NULL AND bin IS NOT NULL)"


def _holes(spark, d):
    x = F.col("lot") + F.col("step")
    return groups(spark, d).select(F.when(F.col("lot") % 5 > 0, F.col("grp")).alias("grp"), *[F.when(x % 7 > 0, F.col(c)).alias(c) for c in ("qty", "bin")])


@query(f"WITH {M}, {_G}, {_HOLES}, r AS (SELECT grp, qty, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS r FROM gq), s AS (SELECT count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY grp), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM gq GROUP BY qty)), h AS (SELECT 12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1) AS h, sum(n) AS n FROM s) SELECT round(h, 4) AS h, round(h / (1 - ties / (n * n * n - n)), 4) AS h_corrected FROM h, t")
def svc_kruskal_nulls(spark, d):
    return rounded(v.kruskal(_holes(spark, d), "grp", "qty"))


@query(f"WITH {M}, {_G}, {_HOLES}, c AS (SELECT grp, bin, count(*) AS o FROM gb GROUP BY 1, 2), e AS (SELECT a.grp, b.bin, r * c::DOUBLE / (SELECT count(*) FROM gb) AS e FROM (SELECT grp, count(*) AS r FROM gb GROUP BY 1) a, (SELECT bin, count(*) AS c FROM gb GROUP BY 1) b) SELECT round(sum(pow(coalesce(o, 0) - e, 2) / e), 6) AS chi2, ((count(DISTINCT grp) - 1) * (count(DISTINCT bin) - 1))::BIGINT AS df FROM e LEFT JOIN c USING (grp, bin)")
def svc_chi_square_nulls(spark, d):
    return rounded(v.chi_square(_holes(spark, d), "grp", "bin"), 6)


@query(f"WITH {M}, {_G}, {_HOLES}, q AS (SELECT grp, count(*) AS n, avg(qty) AS mean, var_samp(qty) AS var FROM gq GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*)::BIGINT AS k, round((sum(n * mean * mean) - sum(n * mean) * sum(n * mean) / sum(n)) / (count(*) - 1) / (sum((n - 1) * var) / (sum(n) - count(*))), 4) AS f FROM q")
def svc_anova_nulls(spark, d):
    return v.anova(_holes(spark, d), "grp", "qty").select("n", "k", F.round("f", 4).alias("f"))


@query(f"WITH {M}, {_G}, c AS (SELECT grp, bin, count(*) AS o FROM g GROUP BY 1, 2), e AS (SELECT a.grp, b.bin, r * c::DOUBLE / (SELECT count(*) FROM g) AS e FROM (SELECT grp, count(*) AS r FROM g GROUP BY 1) a, (SELECT bin, count(*) AS c FROM g GROUP BY 1) b) SELECT round(sum(pow(coalesce(o, 0) - e, 2) / e), 6) AS chi2, ((count(DISTINCT grp) - 1) * (count(DISTINCT bin) - 1))::BIGINT AS df FROM e LEFT JOIN c USING (grp, bin)")
def svc_chi_square(spark, d):
    return rounded(v.chi_square(groups(spark, d), "grp", "bin"), 6)


@query(f"WITH {M}, {_G} SELECT round(regr_r2(x, qty) / (1 - regr_r2(x, qty)) * (count(*) - 2), 3) AS f, count(*)::BIGINT AS n FROM g")
def svc_regression(spark, d):
    return rounded(v.regression_f(groups(spark, d), "qty", "x"), 3)


@query(f"WITH {M}, {_G}, r AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS a, rank() OVER (ORDER BY bin) + (count(*) OVER (PARTITION BY bin) - 1) / 2 AS b FROM g) SELECT round(corr(a, b), 6) AS rho, count(*)::BIGINT AS n FROM r")
def svc_spearman(spark, d):
    return rounded(v.spearman(groups(spark, d), "qty", "bin"), 6)


@query(f"WITH {M}, {_G}, {_AN.replace('chamber', 'lot')} SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM z")
def svd_icc(spark, d):
    return rounded(v.anova(groups(spark, d), "lot", "x").select("icc"), 6)


@query(f"WITH {M}, {_G}, {_WELCH.format(t='l')} SELECT round(diff, 3) AS diff, round((diff + 2000) / (diff / t), 4) AS t_low, round((diff - 2000) / (diff / t), 4) AS t_high, round(df, 3) AS df FROM w")
def sve_equivalence(spark, d):
    return rounded(rounded(v.equivalence(lots(spark, d), "grp", "x", 2000), 4, "t_low", "t_high"), 3, "diff", "df")


_P = "t AS (SELECT p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 100000 AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) AS pm, p * count(*) OVER (PARTITION BY p_brand) / rank() OVER (PARTITION BY p_brand ORDER BY p) AS raw FROM t)"


@query(f"WITH {_P} SELECT p_partkey, round(least(1, pm), 9) AS bonferroni, round(least(1, min(raw) OVER (PARTITION BY p_brand ORDER BY p DESC)), 9) AS bh FROM r")
def svf_corrections(spark, d):
    from veldspar.plans.registry import table

    t = table(spark, d, "part").selectExpr("p_partkey", "p_brand", "(p_partkey * 7919 % 1000 + 1) / 100000 p")
    return rounded(v.corrected(t, "p_brand").select("p_partkey", "bonferroni", "bh"), 9)


@query(f"WITH {M}, {_G} SELECT chamber, count(DISTINCT lot)::BIGINT AS lots, count(DISTINCT lot) >= 5 AS enough FROM g GROUP BY 1")
def svg_minimum_size(spark, d):
    return v.minimum_size(groups(spark, d), "chamber", "lot")


@query(f"WITH {M}, {_G}, c AS (SELECT bin, 100.0 * count(*) FILTER (grp = 'A') / (SELECT count(*) FROM g WHERE grp = 'A') AS a, 100.0 * count(*) FILTER (grp = 'B') / (SELECT count(*) FROM g WHERE grp = 'B') AS b FROM g GROUP BY 1) SELECT round(max(abs(a - b)), 6) AS difference, max(abs(a - b)) >= 20 AS confounded FROM c")
def svh_confounding(spark, d):
    return rounded(v.confounding(groups(spark, d), "grp", "bin"), 6)


@query(f"WITH {M}, {_G}, s AS (SELECT step, avg(x) FILTER (grp = 'A') - avg(x) FILTER (grp = 'B') AS diff, least(count(*) FILTER (grp = 'A'), count(*) FILTER (grp = 'B')) AS w FROM g GROUP BY 1), t AS (SELECT sum(diff * w) / sum(w) AS weighted FROM s) SELECT round(any_value(weighted), 4) AS weighted, count(*)::BIGINT AS strata, count(*) FILTER (sign(diff) = sign(weighted))::BIGINT AS same_sign, count(*) FILTER (sign(diff) = sign(weighted)) * 3 >= count(*) * 2 AS kept FROM s, t")
def svi_stratified(spark, d):
    return rounded(v.stratified(groups(spark, d), "step", "grp", "x"))


@query()
def svj_replication(spark, d):
    return rounded(v.replication(groups(spark, d), "ts", "grp", "x"))


@query()
def svk_power(spark, d):
    return rounded(v.power(v.effect_size(lots(spark, d), "grp", "x", 100000)))


_CHK = "c AS (SELECT p_partkey AS claim, p_partkey % 100 / 1000 AS p, p_size / 25 AS effect, p_partkey % 11 = 0 AS against, p_partkey % 13 = 0 AS withheld, p_partkey % 3 AS missing FROM part), b AS (SELECT *, CASE WHEN withheld THEN 'withheld' WHEN against THEN 'against' WHEN p < 0.01 AND effect >= 0.8 THEN 'strong' WHEN p < 0.05 AND effect >= 0.5 THEN 'moderate' ELSE 'weak' END AS g FROM c)"


@query(f"WITH {_CHK} SELECT claim, CASE WHEN g = 'strong' AND missing = 1 THEN 'moderate' WHEN g IN ('strong', 'moderate') AND missing > 1 THEN 'weak' ELSE g END AS grade FROM b")
def svl_grades(spark, d):
    from veldspar.plans.registry import table

    return v.grades(table(spark, d, "part").selectExpr("p_partkey claim", "p_partkey % 100 / 1000 p", "p_size / 25 effect", "p_partkey % 11 = 0 against", "p_partkey % 13 = 0 withheld", "p_partkey % 3 missing")).select("claim", "grade")


@query("SELECT l_suppkey AS bundle, count(DISTINCT (l_linenumber, l_returnflag, l_linestatus))::BIGINT AS m FROM lineitem GROUP BY 1")
def svm_looks(spark, d):
    from veldspar.plans.registry import table

    return v.looks(table(spark, d, "lineitem").selectExpr("l_suppkey bundle", "l_linenumber measure", "l_returnflag split", "l_linestatus scope"))


@query(f"WITH {M}, {_G}, p AS (SELECT lot, avg(x) FILTER (chamber = 'A') - avg(x) FILTER (chamber = 'R') AS d FROM g GROUP BY 1) SELECT count(d)::BIGINT AS lots, round(avg(d), 4) AS diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t FROM p WHERE d IS NOT NULL")
def svn_paired(spark, d):
    g = groups(spark, d).withColumn("side", F.when(F.col("chamber") == "A", "A").when(F.col("chamber") == "R", "B"))
    return rounded(v.paired(g, "lot", "side", "x"))


@query(f"WITH {M}, {_G}, p AS (SELECT DISTINCT eqp, grp FROM g) SELECT count(*) = count(DISTINCT eqp) AS a_fixes_b, count(*) = count(DISTINCT grp) AS b_fixes_a, count(*) = count(DISTINCT eqp) AND count(*) = count(DISTINCT grp) AS aliased FROM p")
def svn_aliased(spark, d):
    return v.aliased(groups(spark, d), "eqp", "grp")


@query(f"WITH {M} SELECT wlot, count(*)::BIGINT AS n, count(*) < 30 AS small FROM m GROUP BY 1")
def svo_small_categories(spark, d):
    return v.small_categories(measures(spark, d), "wlot")


@query(f"WITH {M}, {_G}, {_WELCH.format(t='g').replace('s AS', 's1 AS').replace('w AS', 'w1 AS').replace('FROM s)', 'FROM s1)')}, {_WELCH.format(t='l')} SELECT round(w1.t, 4) AS t_rows, round(w.t, 4) AS t_lots FROM w1, w")
def svp_nested_gap(spark, d):
    return rounded(v.nested_gap(groups(spark, d), "lot", "grp", "x"))


@query()
def svq_cache_key(spark, d):
    return groups(spark, d).groupBy("chamber").agg(F.count("*").alias("n")).select("chamber", v.cache_key(F.concat(F.lit("box by "), "chamber"), F.col("n"), F.lit("qty > 10")).alias("key"))
