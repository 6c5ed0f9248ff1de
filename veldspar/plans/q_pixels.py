"""Pixel analytics (PX) over the embeddings, taken as 8 x 8 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import pixels as p
from veldspar.plans.registry import query, rounded, table


def grey(spark, d):
    """(image, x, y, v) of every vector with 64 components."""
    e = table(spark, d, "embeddings").filter(F.size("embedding") == 64)
    return e.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "v")).select("image", (F.col("pos") % 8).alias("x"), F.expr("pos div 8").alias("y"), F.col("v").cast("double").alias("v"))


def marked(spark, d):
    """Pixels above 0.1 in size, clusters by sign."""
    return grey(spark, d).filter("abs(v) > 0.1").select("image", "x", "y", F.when(F.col("v") > 0, 1).otherwise(2).alias("cluster"))


def colours(spark, d):
    """(image, x, y, r, g, b): quantised values as colours."""
    level = F.least(F.greatest(F.floor((F.col("v") + 0.2) * 10), F.lit(0)), F.lit(4)).cast("int")
    return grey(spark, d).select("image", "x", "y", (level * 60).alias("r"), F.when(level > 2, 200).otherwise(20).alias("g"), ((4 - level) * 50).alias("b"))


_G = "g AS (SELECT vec_id AS image, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings WHERE len(embedding) = 64), px AS (SELECT image, (pos % 8)::INT AS x, (pos // 8)::INT AS y, v FROM g), mk AS (SELECT image, x, y, CASE WHEN v > 0 THEN 1 ELSE 2 END AS cluster FROM px WHERE abs(v) > 0.1), lv AS (SELECT image, x, y, least(greatest(floor((v + 0.2) * 10), 0), 4)::INT AS k FROM px), co AS (SELECT image, x, y, k * 60 AS r, CASE WHEN k > 2 THEN 200 ELSE 20 END AS g, (4 - k) * 50 AS b FROM lv)"
_BG = "h AS (SELECT image, r, g, b, count(*) AS n, count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) AS e FROM co GROUP BY ALL), o AS (SELECT image, arg_max({'r': r, 'g': g, 'b': b}, (e, -r, -g, -b)) AS e, arg_max({'r': r, 'g': g, 'b': b}, (n, -r, -g, -b)) AS c FROM h GROUP BY 1), f AS (SELECT h.image, any_value(o.e) AS e, any_value(o.c) AS c, sum(CASE WHEN pow(r - o.e.r, 2) + pow(g - o.e.g, 2) + pow(b - o.e.b, 2) > 3600 THEN n ELSE 0 END) AS fe, sum(CASE WHEN pow(r - o.c.r, 2) + pow(g - o.c.g, 2) + pow(b - o.c.b, 2) > 3600 THEN n ELSE 0 END) AS fc FROM h JOIN o USING (image) GROUP BY 1), bg AS (SELECT image, CASE WHEN fc < fe THEN c ELSE e END AS p FROM f)"


@query(f"WITH {_G}, {_BG} SELECT image, p.r AS bg_r, p.g AS bg_g, p.b AS bg_b FROM bg")
def px1_background(spark, d):
    return p.background(colours(spark, d))


@query(f"WITH {_G}, {_BG}, k AS (SELECT co.*, pow(r - p.r, 2) + pow(g - p.g, 2) + pow(b - p.b, 2) > 3600 AS fg FROM co JOIN bg USING (image)) SELECT image, x, y FROM k WHERE fg AND image IN (SELECT image FROM k GROUP BY 1 HAVING count(*) FILTER (fg) / count(*) <= 0.5)")
def px2_foreground(spark, d):
    c = colours(spark, d)
    return p.foreground(c, p.background(c)).select("image", "x", "y")


@query(f"WITH {_G}, {_BG}, k AS (SELECT co.*, pow(r - p.r, 2) + pow(g - p.g, 2) + pow(b - p.b, 2) > 3600 AS fg FROM co JOIN bg USING (image)) SELECT image, x, y FROM k WHERE fg AND image IN (SELECT image FROM k GROUP BY 1 HAVING count(*) FILTER (fg) / count(*) <= 0.95)")
def px2_foreground_lenient(spark, d):
    c = colours(spark, d)
    return p.foreground(c, p.background(c), most=0.95).select("image", "x", "y")


@query()
def px3_hue_clusters(spark, d):
    return p.hue_clusters(colours(spark, d))


@query()
def px4_assigned(spark, d):
    c = colours(spark, d)
    return p.assigned(c, p.hue_clusters(c)).select("image", "x", "y", "cluster")


@query()
def px5_absorbed(spark, d):
    fringe = marked(spark, d).withColumn("cluster", F.when((F.col("x") + F.col("y")) % 3 == 0, -1).otherwise(F.col("cluster")))
    return p.absorbed(fringe)


@query(f"WITH RECURSIVE {_G}, f AS (SELECT image, x, y FROM px WHERE v BETWEEN -0.1 AND 0), fr(image, s, x, y) AS (SELECT image, y * 8 + x, x, y FROM f UNION SELECT r.image, r.s, n.x, n.y FROM fr r JOIN f n ON n.image = r.image AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1), fc AS (SELECT image, x, y, min(s) AS c FROM fr GROUP BY ALL), z AS (SELECT image, x, y FROM px WHERE v > 0.25), t AS (SELECT DISTINCT fc.image, fc.c FROM fc JOIN z ON z.image = fc.image AND abs(z.x - fc.x) <= 1 AND abs(z.y - fc.y) <= 1) SELECT image, x, y, 0 AS cluster FROM z UNION ALL SELECT image, x, y, 0 FROM fc SEMI JOIN t USING (image, c)")
def px5_absorbed_faint(spark, d):
    g = grey(spark, d)
    return p.absorbed_faint(g.filter("v > 0.25").select("image", "x", "y", F.lit(0).alias("cluster")), g.filter("v between -0.1 and 0").select("image", "x", "y"), width=8)


_CC = "c0 AS (SELECT image, cluster, x, y, y * 8 + x AS p FROM mk), reach(image, cluster, s, x, y) AS (SELECT image, cluster, p, x, y FROM c0 UNION SELECT r.image, r.cluster, r.s, n.x, n.y FROM reach r JOIN c0 n ON n.image = r.image AND n.cluster = r.cluster AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1), cc AS (SELECT image, cluster, x, y, min(s)::BIGINT AS component FROM reach GROUP BY ALL)"
_R = f"WITH RECURSIVE {_G}, {_CC}"
_GEO = "ge AS (SELECT image, cluster, component, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*)::BIGINT AS area, avg(x) AS cx, avg(y) AS cy FROM cc GROUP BY ALL)"


def parts(spark, d):
    return p.components(marked(spark, d), width=8)


@query(f"{_R} SELECT image, cluster, x, y, component FROM cc")
def px6_components(spark, d):
    return parts(spark, d).select("image", "cluster", "x", "y", "component")


@query(f"{_R}, {_GEO} SELECT image, cluster, component, x0, x1, y0, y1, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(area / ((x1 - x0 + 1) * (y1 - y0 + 1)), 6) AS fill, round((x1 - x0 + 1) / (y1 - y0 + 1), 6) AS aspect FROM ge")
def px7_geometry(spark, d):
    return rounded(p.geometry(parts(spark, d)), 6)


@query(f"WITH {_G}, r AS (SELECT image, y, count(DISTINCT x) AS n FROM mk GROUP BY 1, 2), w AS (SELECT image, max(x) - min(x) + 1 AS w FROM mk GROUP BY 1), k AS (SELECT image, y FROM r JOIN w USING (image) WHERE n >= greatest(5, 0.4 * w)), s AS (SELECT *, sum(b) OVER (PARTITION BY image ORDER BY y) AS i FROM (SELECT *, coalesce((y - lag(y) OVER (PARTITION BY image ORDER BY y) > 2)::INT, 0) AS b FROM k)) SELECT image, min(y) AS first, max(y) AS last FROM s GROUP BY image, i HAVING max(y) - min(y) + 1 <= 2")
def px8_line_bands(spark, d):
    return p.line_bands(marked(spark, d), least=5, thickest=2)


@query(f"WITH {_G}, r AS (SELECT image, x, count(DISTINCT y) AS n FROM mk GROUP BY 1, 2), w AS (SELECT image, max(y) - min(y) + 1 AS w FROM mk GROUP BY 1), k AS (SELECT image, x FROM r JOIN w USING (image) WHERE n >= greatest(5, 0.4 * w)), s AS (SELECT *, sum(b) OVER (PARTITION BY image ORDER BY x) AS i FROM (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY image ORDER BY x) > 2)::INT, 0) AS b FROM k)) SELECT image, min(x) AS first, max(x) AS last FROM s GROUP BY image, i HAVING max(x) - min(x) + 1 <= 2")
def px8_vertical_bands(spark, d):
    return p.line_bands(marked(spark, d), least=5, thickest=2, vertical=True)


_EXT = "u AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS i FROM (SELECT DISTINCT image, y, x FROM mk)), q AS (SELECT image, y, min(x) AS f, max(x) AS l FROM u GROUP BY image, y, i HAVING count(*) >= 3), ex AS (SELECT image, y, min(f) AS first, max(l) AS last FROM q GROUP BY 1, 2)"


@query(f"WITH {_G}, {_EXT} SELECT * FROM ex")
def px9_line_extent(spark, d):
    return p.line_extent(marked(spark, d), 3)


@query(f"WITH {_G}, {_EXT}, fr AS (SELECT image, min(x) AS lo, max(x) AS hi FROM mk WHERE x BETWEEN 2 AND 5 GROUP BY 1) SELECT image, y, coalesce(greatest(first, lo), first) AS first, coalesce(least(last, hi), last) AS last FROM ex LEFT JOIN fr USING (image) WHERE coalesce(greatest(first, lo), first) <= coalesce(least(last, hi), last)")
def px10_trimmed(spark, d):
    m = marked(spark, d)
    return p.trimmed(p.line_extent(m, 3), m.filter("x between 2 and 5").select("image", "x").distinct())


@query(f"{_R}, {_GEO}, i AS (SELECT image, cluster, component, count(*) FILTER (pow((x + 0.5 - x0 - (x1 - x0 + 1) / 2) / ((x1 - x0 + 1) / 2), 2) + pow((y + 0.5 - y0 - (y1 - y0 + 1) / 2) / ((y1 - y0 + 1) / 2), 2) <= 1 + 1e-9) AS inside FROM cc JOIN ge USING (image, cluster, component) GROUP BY ALL) SELECT image, cluster, component, area, (x1 - x0 + 1) / (y1 - y0 + 1) BETWEEN 0.7 AND 1.43 AND area / ((x1 - x0 + 1) * (y1 - y0 + 1)) BETWEEN 0.6 AND 0.95 AS is_round, inside >= 0.9 * area AS is_disc FROM ge JOIN i USING (image, cluster, component)")
def px11_round_parts(spark, d):
    return p.round_parts(parts(spark, d))


_POLAR = "(round(degrees(atan2(y - cy, x - cx)), 9) + 360) % 360"
_RINGS = f"ho AS (SELECT * EXCLUDE (cx, cy), (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0 + y1 - y0 + 2) / 4 AS radius, greatest(0.6, 0.05 * (x1 - x0 + y1 - y0 + 2) / 4) AS tolerance FROM ge WHERE least(x1 - x0, y1 - y0) + 1 >= 2.4 AND abs(x1 - x0 - y1 + y0) <= 0.2 * (greatest(x1 - x0, y1 - y0) + 1) AND area / ((x1 - x0 + 1) * (y1 - y0 + 1)) <= 0.5 QUALIFY row_number() OVER (PARTITION BY image ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1) DESC, component, cluster) = 1), ri AS (SELECT image, cluster, ho.component, radius, count(DISTINCT floor(({_POLAR}) / 5)) / 72 AS covered FROM cc JOIN ho USING (image, cluster) WHERE abs(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) - radius) <= tolerance GROUP BY ALL HAVING count(DISTINCT floor(({_POLAR}) / 5)) / 72 >= 0.05)"


def found_rings(spark, d, found):
    sizes = grey(spark, d).groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return p.rings(found, sizes, least_share=0.05, square=0.2, most_fill=0.5, stroke=(0.6, 0.05))


@query(f"{_R}, {_GEO}, {_RINGS} SELECT image, cluster, component, round(radius, 6) AS radius, round(covered, 6) AS covered FROM ri")
def px12_rings(spark, d):
    return rounded(found_rings(spark, d, parts(spark, d)).select("image", "cluster", "component", "radius", "covered"), 6)


@query(f"{_R}, {_GEO}, {_RINGS}, de AS (SELECT c.image, radians(({_POLAR})) AS a, floor(({_POLAR}) / 5)::INT AS slot FROM cc c JOIN ho USING (image, cluster, component) JOIN ri USING (image, cluster, component) WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) >= 0.2 * ho.radius AND sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < ho.radius - tolerance AND NOT EXISTS (SELECT 1 FROM mk o WHERE o.image = c.image AND o.cluster <> c.cluster AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1)), th AS (SELECT b.image, b.slot, count(*)::BIGINT AS n, sum(sin(a)) AS s, sum(cos(a)) AS c FROM (SELECT DISTINCT image, slot FROM de) b JOIN de ON de.image = b.image AND (de.slot - b.slot + 72) % 72 IN (0, 1, 71) GROUP BY 1, 2) SELECT image, round((degrees(atan2(s, c)) + 360) % 360, 4) AS angle, n FROM th WHERE n >= 1 QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, slot) = 1")
def px13_ring_notch(spark, d):
    found = parts(spark, d)
    return rounded(p.ring_notches(found, found_rings(spark, d, found), inner=0.2, clear=1, least=1), 4)


@query()
def px13_notch(spark, d):
    angles = grey(spark, d).filter("abs(v) < 0.05").groupBy("image", F.pmod(F.col("x") * 9 + F.col("y"), F.lit(72)).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return rounded(p.notch(angles), 4)


@query()
def px14_text_rows(spark, d):
    return p.text_rows(p.geometry(parts(spark, d)))


_TEXT = "bo AS (SELECT image, component, area, x0, x1, y0, y1, y1 - y0 + 1 AS h, (y0 + y1) / 2 AS ce, (x1 - x0 + 1) / (y1 - y0 + 1) BETWEEN 0.7 AND 1.43 AND area / ((x1 - x0 + 1) * (y1 - y0 + 1)) >= 0.7 AS is_round FROM ge)"


def boxes(found):
    g = p.geometry(found)
    return g.withColumn("is_round", F.col("aspect").between(0.7, 1.43) & (F.col("fill") >= 0.7))


@query(f"{_R}, {_GEO}, {_TEXT}, pa AS (SELECT a.image, a.component AS i, b.component AS j FROM bo a JOIN bo b ON a.image = b.image AND (a.x0, a.component) < (b.x0, b.component) AND b.x0 - a.x1 <= 1.3 * greatest(a.h, b.h) AND abs(a.ce - b.ce) <= 0.4 * greatest(a.h, b.h) AND greatest(a.h, b.h) <= 1.67 * least(a.h, b.h)), bi AS (SELECT image, i, j FROM pa UNION ALL SELECT image, j, i FROM pa), go(image, s, n) AS (SELECT image, component, component FROM bo UNION SELECT go.image, go.s, bi.j FROM go JOIN bi ON bi.image = go.image AND bi.i = go.n), ru AS (SELECT image, n AS component, min(s) AS run FROM go GROUP BY 1, 2), ok AS (SELECT image, run FROM ru JOIN bo USING (image, component) GROUP BY 1, 2 HAVING count(*) >= 2 AND NOT bool_and(is_round)) SELECT image, component, run FROM ru SEMI JOIN ok USING (image, run)")
def px14_text_runs(spark, d):
    return p.text_runs(boxes(parts(spark, d)))


@query()
def px14_aligned_boxes(spark, d):
    return p.aligned_boxes(boxes(parts(spark, d)))


@query(f"{_R}, {_GEO}, m AS (SELECT image, median(area) AS m FROM ge GROUP BY 1) SELECT image, median(area)::DOUBLE AS unit FROM ge JOIN m USING (image) WHERE area <= 3 * m GROUP BY 1")
def px15_unit_areas(spark, d):
    return p.unit_areas(p.geometry(parts(spark, d)))


@query(f"{_R}, {_GEO}, m AS (SELECT image, median(area) AS m FROM ge GROUP BY 1), un AS (SELECT image, median(area) AS unit FROM ge JOIN m USING (image) WHERE area <= 3 * m GROUP BY 1) SELECT image, cluster, component, greatest(1, round_even(area / unit, 0))::INT AS points FROM ge JOIN un USING (image) WHERE area >= 0.25 * unit")
def px16_point_counts(spark, d):
    g = p.geometry(parts(spark, d))
    return p.point_counts(g, p.unit_areas(g)).select("image", "cluster", "component", "points")


@query()
def px17_without_halos(spark, d):
    neutral = parts(spark, d).withColumn("cluster", F.when(F.col("cluster") == 2, 0).otherwise(1))
    return p.without_halos(neutral).select("image", "x", "y", "cluster")


@query()
def px18_depth(spark, d):
    return p.depth(parts(spark, d).filter("cluster = 1"), 2).select("image", "x", "y", "depth")


_DENSE = "mk AS (SELECT image, x, y, 1 AS cluster FROM px WHERE v > -0.12)"
_GD = _G[: _G.index("mk AS")] + _DENSE
_CORES = "gr AS (SELECT a AS x, b AS y FROM range(-1, 9) t(a), range(-1, 9) u(b)), ds AS (SELECT c.image, c.component, c.x, c.y, min(3 * greatest(abs(c.x - g.x), abs(c.y - g.y)) + least(abs(c.x - g.x), abs(c.y - g.y)))::INT AS distance FROM cc c JOIN gr g ON NOT EXISTS (SELECT 1 FROM cc o WHERE o.image = c.image AND o.component = c.component AND o.x = g.x AND o.y = g.y) GROUP BY ALL)"


def dense(spark, d):
    """All but the darkest pixels, in one cluster."""
    return p.components(grey(spark, d).filter("v > -0.12").select("image", "x", "y", F.lit(1).alias("cluster")), width=8)


@query(f"WITH RECURSIVE {_GD}, {_CC}, {_CORES} SELECT image, component, x, y, distance FROM ds")
def px18_chamfer(spark, d):
    return p.chamfer(dense(spark, d)).select("image", "component", "x", "y", "distance")


@query(f"WITH RECURSIVE {_GD}, {_CC}, {_CORES}, k AS (SELECT image, component, x, y, distance, (y * 8 + x)::BIGINT AS p FROM ds WHERE distance >= 6), kr(image, s, x, y) AS (SELECT image, p, x, y FROM k UNION SELECT r.image, r.s, n.x, n.y FROM kr r JOIN k n ON n.image = r.image AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1), kc AS (SELECT image, x, y, min(s) AS marker FROM kr GROUP BY ALL), m AS (SELECT image, component, marker, avg(x) AS cx, avg(y) AS cy, count(*)::BIGINT AS core, max(distance) / 3 + 0.5 AS reach FROM kc JOIN k USING (image, x, y) GROUP BY ALL) SELECT m.image, m.component, m.marker, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, any_value(core) AS core, round(any_value(reach), 6) AS reach, count(*)::BIGINT AS body FROM m JOIN cc ON cc.image = m.image AND cc.component = m.component AND sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= reach GROUP BY ALL")
def px18_markers(spark, d):
    found = dense(spark, d)
    marks = p.markers(p.chamfer(found), found.select("image").distinct().withColumn("thickness", F.lit(1.0)), width=8)
    body = p.marker_bodies(found, marks).groupBy("image", "component", "marker").agg(F.count("*").alias("body"))
    return rounded(marks.join(body.hint("merge"), ["image", "component", "marker"]).select("image", "component", "marker", "cx", "cy", "core", "reach", "body"), 6)


@query(f"{_R}, cl AS (SELECT image, component, x, count(*) AS run FROM cc WHERE cluster = 1 GROUP BY ALL), im AS (SELECT image, max(x) - min(x) + 1 AS w FROM cc WHERE cluster = 1 GROUP BY 1), c AS (SELECT image, component, count(*)::BIGINT AS columns, max(x) - min(x) + 1 AS span, quantile_cont(run, 0.2) AS thickness FROM cl GROUP BY 1, 2) SELECT image, component, columns, round(thickness::DOUBLE, 6) AS thickness FROM c JOIN im USING (image) WHERE span >= 0.4 * w AND columns >= 0.9 * span")
def px19_curves(spark, d):
    return rounded(p.curves(parts(spark, d).filter("cluster = 1")), 6)


_CELL = "bx AS (SELECT image, min(x) AS x0, max(x) - min(x) + 1 AS w, min(y) AS y0, max(y) - min(y) + 1 AS h FROM mk GROUP BY 1), ce AS (SELECT image, floor((x - x0) * 3 / w)::INT AS cell_x, floor((y - y0) * 2 / h)::INT AS cell_y, cluster, count(*)::BIGINT AS n FROM mk JOIN bx USING (image) GROUP BY ALL)"


@query(f"WITH {_G}, {_CELL} SELECT * FROM ce")
def px20_cells(spark, d):
    return p.cells(marked(spark, d), 3, 2)


@query(f"WITH {_G}, {_CELL}, t AS (SELECT *, 7 * n / sum(n) OVER (PARTITION BY image) AS e FROM ce), f AS (SELECT *, floor(e) AS fl, 7 - sum(floor(e)) OVER (PARTITION BY image) AS le FROM t) SELECT image, cell_x, cell_y, cluster, (fl + (row_number() OVER (PARTITION BY image ORDER BY round(e - fl, 9) DESC, cell_x, cell_y, cluster) <= le)::INT)::BIGINT AS allocated FROM f")
def px21_allocated(spark, d):
    shares = p.cells(marked(spark, d), 3, 2).withColumn("total", F.lit(7))
    return p.allocated(shares, ["image"], ["cell_x", "cell_y", "cluster"], "n", "total").select("image", "cell_x", "cell_y", "cluster", "allocated")


@query()
def px22_slopes(spark, d):
    return rounded(p.slopes(marked(spark, d), 4), 4)


@query(f"{_R}, {_GEO}, {_EXT}, {_RINGS}, li AS (SELECT image, count(*)::BIGINT AS lines FROM ex GROUP BY 1), wa AS (SELECT DISTINCT image AS wafer FROM ri) SELECT image, cluster, count(DISTINCT component)::BIGINT AS points, coalesce(any_value(lines), 0)::BIGINT AS lines, CASE WHEN any_value(wafer) IS NOT NULL THEN 'wafer' WHEN coalesce(any_value(lines), 0) > 0 THEN 'chart' ELSE 'unknown' END AS kind FROM cc LEFT JOIN li USING (image) LEFT JOIN wa ON wafer = image GROUP BY 1, 2")
def px23_legend(spark, d):
    found = parts(spark, d)
    return p.legend(p.geometry(found), p.line_extent(marked(spark, d), 3), found_rings(spark, d, found))
