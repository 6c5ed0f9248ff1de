"""Document evidence (DC, AG24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import evidence as e
from veldspar.plans.registry import query, table

_T = "d AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN replace(text, ' | ', chr(9)) WHEN 1 THEN 'From: a' || chr(10) || 'Subject: s' || doc_id || chr(10) || '> quoted' || chr(10) || text WHEN 2 THEN '10:0' || doc_id % 10 || ' hi' || chr(10) || '10:11 you' || chr(10) || '10:12 there' || chr(10) || '---' || chr(10) || text ELSE text END AS text FROM documents)"


def pastes(spark, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    text = F.when(k == 0, F.replace(t, F.lit(" | "), F.lit("\t"))).when(k == 1, F.concat(F.lit("From: a\nSubject: s"), F.col("doc_id"), F.lit("\n> quoted\n"), t)).when(k == 2, F.concat(F.lit("10:0"), F.col("doc_id") % 10, F.lit(" hi\n10:11 you\n10:12 there\n---\n"), t)).otherwise(t)
    return table(spark, d, "documents").select("doc_id", "source", text.alias("text"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_KIND = f"CASE WHEN len({_LINES}) >= 2 AND len(list_filter({_LINES}, lambda x: contains(x, chr(9)))) >= greatest(2, floor(len({_LINES}) * 0.6)) THEN 'table' WHEN len(regexp_extract_all(text, '(?im)^\\s*(from|to|cc|sent|date|subject)\\s*:')) >= 2 THEN 'mail' WHEN len(regexp_extract_all(text, '(?im)^\\s*\\d{{1,2}}:\\d{{2}}\\s*(AM|PM)?\\s')) >= 3 THEN 'chat' ELSE 'text' END"
_KIND = _KIND.replace("{{", "{").replace("}}", "}")


@query("WITH " + _T + f" SELECT doc_id, {_KIND} AS kind FROM d")
def dc1_kind(spark, d):
    return pastes(spark, d).select("doc_id", e.kind(F.col("text")).alias("kind"))


@query("WITH " + _T + " SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '>')))::INT AS quotes, (SELECT count(DISTINCT g) FROM (SELECT u, sum(CASE WHEN u = '' OR regexp_full_match(u, '[\\s\\-=_*~·•.#]{3,}') THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g FROM (SELECT unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS u, unnest(range(len(string_split(text, chr(10))))) AS i) WHERE NOT starts_with(u, '>')) WHERE u <> '' AND NOT regexp_full_match(u, '[\\s\\-=_*~·•.#]{3,}'))::INT AS blocks FROM d")
def dc2_blocks(spark, d):
    return pastes(spark, d).select("doc_id", e.quotes(F.col("text")).alias("quotes"), F.size(e.blocks(F.col("text"))).alias("blocks"))


@query()
def dc3_packed(spark, d):
    return pastes(spark, d).select("doc_id", F.posexplode(e.packed_blocks(F.col("text"))).alias("position", "text"))


@query()
def dc4_cut(spark, d):
    return pastes(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > e.LONGEST).select("doc_id", F.posexplode(e.cut(F.col("line"))).alias("position", "text"))


@query()
def dc5_merged(spark, d):
    return e.fragments(pastes(spark, d).select(F.col("source").alias("topic"), F.col("doc_id").alias("paste_id"), "text"))


@query("SELECT p_partkey, p_name || ': ' || p_brand || ' · size: ' || p_size AS text FROM part")
def dc6_table_rows(spark, d):
    t = F.concat("p_name", F.lit("\tsize\n"), "p_brand", F.lit("\t"), "p_size")
    return table(spark, d, "part").select("p_partkey", F.explode(e.table_rows(t)).alias("text"))


@query()
def dc7_title(spark, d):
    return pastes(spark, d).select("doc_id", e.title(F.col("text")).alias("title"))


_FR = "f AS (SELECT source AS topic, doc_id AS paste_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS position FROM documents), k AS (SELECT *, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM f), z AS (SELECT topic, key, min((paste_id, position)) AS at, arg_min(text, (paste_id, position)) AS text, count(*)::BIGINT - 1 AS duplicates FROM k WHERE length(key) >= 2 GROUP BY 1, 2)"


def line_fragments(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("paste_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))


@query(f"WITH {_FR} SELECT topic, md5(key) AS key, duplicates FROM z")
def dc8_deduplicated(spark, d):
    return e.deduplicated(line_fragments(spark, d)).select("topic", F.md5("key").alias("key"), "duplicates")


@query("WITH RECURSIVE p AS (SELECT source AS topic, doc_id AS paste_id, length(text) AS c, len(string_split(text, chr(10))) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), r AS (SELECT topic, paste_id, n, c <= 20000 AS ok, CASE WHEN c <= 20000 THEN c ELSE 0 END AS tc, CASE WHEN c <= 20000 THEN f ELSE 0 END AS tf FROM p WHERE n = 1 UNION ALL SELECT p.topic, p.paste_id, p.n, c <= 20000 AND tc + c <= 60000 AND tf + f <= 300, tc + CASE WHEN c <= 20000 AND tc + c <= 60000 AND tf + f <= 300 THEN c ELSE 0 END, tf + CASE WHEN c <= 20000 AND tc + c <= 60000 AND tf + f <= 300 THEN f ELSE 0 END FROM r JOIN p ON p.topic = r.topic AND p.n = r.n + 1) SELECT topic, paste_id FROM r WHERE ok")
def dc9_quota(spark, d):
    p = table(spark, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("paste_id"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("frags"))
    return e.within_quota(p, 20000, 60000, 300)


@query("WITH " + _T + f", {_FR} SELECT topic, sum(length(p.text))::BIGINT AS chars, 0::BIGINT AS quotes, any_value(z.dup)::BIGINT AS duplicates FROM documents p JOIN (SELECT topic, sum(duplicates) AS dup FROM z GROUP BY 1) z ON z.topic = p.source GROUP BY 1")
def ag24_paste_totals(spark, d):
    return e.paste_totals(line_fragments(spark, d), table(spark, d, "documents").select(F.col("source").alias("topic"), "text"))


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.concat_ws(" ", F.lit("n"), F.min("l_partkey").cast("string"), F.max("l_suppkey").cast("string"), F.lit("7")).alias("text")).select(F.col("l_orderkey").alias("line_id"), "text"), li.select(F.col("l_orderkey").alias("line_id"), F.concat(F.lit("0"), F.col("l_partkey"), F.lit(".0 and more")).alias("text"))


@query("WITH l AS (SELECT l_orderkey AS line_id, min(l_partkey) AS a, max(l_suppkey) AS b, list(l_partkey) AS have FROM lineitem GROUP BY 1) SELECT line_id, b::VARCHAR AS numbers FROM l WHERE b >= 10 AND NOT list_contains(have, b)")
def dc10_unsupported(spark, d):
    lines, cited = _lines(spark, d)
    return e.unsupported(lines, cited).select("line_id", F.array_join("numbers", " ").alias("numbers"))


@query("SELECT o_orderkey AS line_id, CASE WHEN o_custkey % 7 = 0 THEN 'user' WHEN o_custkey % 5 = 3 THEN 'gap' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) THEN 'err' WHEN o_custkey % 5 = 1 THEN 'infer' WHEN o_custkey % 5 = 2 THEN 'check' ELSE 'ok' END AS state FROM orders")
def dc11_verdicts(spark, d):
    lines = table(spark, d, "orders").selectExpr("o_orderkey line_id", "case when o_custkey % 7 = 0 then 'user' else 'model' end origin", "element_at(array('fact', 'infer', 'check', 'gap', 'odd'), cast(o_custkey % 5 + 1 as int)) kind")
    return e.verdicts(lines, table(spark, d, "lineitem").filter("l_quantity > 40").selectExpr("l_orderkey line_id"))


@query("WITH f AS (SELECT l_suppkey AS report, l_partkey % 50 AS fragment_id, min((l_orderkey, l_linenumber)) AS use FROM lineitem GROUP BY 1, 2) SELECT report, fragment_id, row_number() OVER (PARTITION BY report ORDER BY use, fragment_id)::INT AS number FROM f")
def dc12_citations(spark, d):
    return e.citations(table(spark, d, "lineitem").selectExpr("l_suppkey report", "l_orderkey line_no", "l_linenumber position", "l_partkey % 50 fragment_id"))


@query("SELECT source AS topic, doc_id AS paste_id, unnest(range(1, least(3, len(string_split(text, chr(10)))) + 1))::INT AS n, 'fact' AS kind FROM documents")
def dc13_outline(spark, d):
    return e.outline(line_fragments(spark, d))


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 13 = 0 THEN 'uncited' WHEN o_custkey % 4 = 0 THEN 'match' WHEN o_custkey % 4 = 1 THEN CASE WHEN round(o_totalprice) = o_totalprice THEN 'match' ELSE 'rounded' END WHEN o_custkey % 4 = 2 THEN 'percent' ELSE 'sign' END AS verdict FROM orders")
def dc14_number_check(spark, d):
    o = table(spark, d, "orders")
    k, v = F.col("o_custkey") % 4, F.col("o_totalprice")
    claims = o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("calc_id"), F.when(k == 0, v).when(k == 1, F.round(v)).when(k == 2, F.round(v * 100)).otherwise(-v).alias("value"), F.lit(0).alias("digits"))
    return e.number_check(claims, o.filter("o_custkey % 13 <> 0").selectExpr("o_orderkey calc_id", "o_totalprice result"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS numbers FROM orders")
def dc15_claimed_numbers(spark, d):
    text = F.concat(F.lit("3rd of 2024-05, top 10, EQP-17, #4: "), "o_custkey")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(e.claimed_numbers(text), " ").alias("numbers"))


@query("SELECT doc_id, 'aws' AS rule, list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\bAKIA[0-9A-Z]{16}\\b')), true)::BIGINT AS line FROM documents WHERE regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b')")
def dc16_secret_lines(spark, d):
    return e.first_lines(table(spark, d, "documents"), {"aws": e.SECRETS["aws"]} | e.SECRETS)


_FIRST = {"mail": "[a-z0-9.]+@[a-z0-9]+[.][a-z]+", "number": "[0-9]{5,}", "license": "[Ll]icense"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '{r}')), true)::BIGINT AS line FROM documents WHERE regexp_matches(text, '{r}')" for n, r in _FIRST.items()))
def dc16_first_lines(spark, d):
    return e.first_lines(table(spark, d, "documents"), _FIRST)


@query("WITH c AS (SELECT p_partkey AS page_id, lower(printf('%02x%02x%02x', p_partkey * 37 % 256, p_size * 5 % 256, p_partkey * 11 % 256)) AS colour, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 11 % 256 AS b FROM part), h AS (SELECT *, CASE WHEN greatest(r, g, b) > least(r, g, b) THEN CASE WHEN greatest(r, g, b) = r THEN (60.0 * (g - b) / (r - least(g, b)) + 360) % 360 WHEN greatest(r, g, b) = g THEN 60.0 * (b - r) / (g - least(r, b)) + 120 ELSE 60.0 * (r - g) / (b - least(r, g)) + 240 END END AS hue FROM c) SELECT page_id, colour FROM h WHERE hue IS NOT NULL AND NOT (hue BETWEEN 180.5 AND 260.5 OR hue BETWEEN 20.5 AND 60.5)")
def dc17_off_palette(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.format_string("color: #%02X%02X%02X;", F.col("p_partkey") * 37 % 256, (F.col("p_size") * 5 % 256).cast("long"), F.col("p_partkey") * 11 % 256).alias("text"))
    return e.off_palette(p, [(180.5, 260.5), (20.5, 60.5)])


@query("WITH f AS (SELECT p_partkey AS page_id, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 11 % 256 AS b FROM part), c AS (SELECT DISTINCT *, lower(printf('%02x%02x%02x', r, g, b)) AS colour FROM (SELECT * FROM f UNION ALL SELECT page_id, r // 16 * 17, g // 16 * 17, b // 16 * 17 FROM f)), h AS (SELECT *, CASE WHEN greatest(r, g, b) > least(r, g, b) THEN CASE WHEN greatest(r, g, b) = r THEN (60.0 * (g - b) / (r - least(g, b)) + 360) % 360 WHEN greatest(r, g, b) = g THEN 60.0 * (b - r) / (g - least(r, b)) + 120 ELSE 60.0 * (r - g) / (b - least(r, g)) + 240 END END AS hue FROM c) SELECT page_id, colour FROM h WHERE hue IS NOT NULL AND NOT (hue BETWEEN 180.5 AND 260.5 OR hue BETWEEN 20.5 AND 60.5)")
def dc17_colour_forms(spark, d):
    r, g, b = F.col("p_partkey") * 37 % 256, (F.col("p_size") * 5 % 256).cast("long"), F.col("p_partkey") * 11 % 256
    digit = lambda c: F.lower(F.hex(F.floor(c / 16)))
    text = F.concat(F.format_string("a { color: rgba( %d ,%d, %d, 0.5) } &#123; b { color: #", r, g, b), digit(r), digit(g), digit(b), F.lit("; } #12345 x#abc"))
    return e.off_palette(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), text.alias("text")), [(180.5, 260.5), (20.5, 60.5)])


@query("SELECT DISTINCT page_id, regexp_replace(t, '[?#].*$', '') AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1)) AS t FROM pages) WHERE NOT regexp_matches(t, '^[a-z]+:|^//|^#')")
def dc18_links(spark, d):
    return e.links(table(spark, d, "pages").select("page_id", F.col("html").alias("text")))


@query("WITH l AS (SELECT DISTINCT l_suppkey AS owner, 'f' || l_partkey % 60 AS path FROM lineitem WHERE l_quantity < 15) SELECT owner, path FROM (SELECT DISTINCT owner FROM l), (VALUES ('f1'), ('f2'), ('f59')) v(path) WHERE (owner, path) NOT IN (SELECT owner, path FROM l)")
def dc19_required_files(spark, d):
    return e.required_files(table(spark, d, "lineitem").filter("l_quantity < 15").selectExpr("l_suppkey owner", "concat('f', l_partkey % 60) path").distinct(), ["f1", "f2", "f59"])


@query("SELECT conv_id, turn, used FROM (SELECT *, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS used FROM conversations) WHERE used <= 2000")
def dc20_context_budget(spark, d):
    return e.context_budget(table(spark, d, "conversations"), 2000).select("conv_id", "turn", "used")


@query("SELECT sha256(text) AS digest, count(DISTINCT source)::BIGINT AS owners, count(*)::BIGINT AS copies FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def dc21_shared_copies(spark, d):
    return e.shared_copies(table(spark, d, "documents"), "source")


@query("SELECT source, sum(length(text))::BIGINT AS chars, sum(length(text)) > 100000 AS over FROM documents GROUP BY 1")
def dc22_size_budget(spark, d):
    return e.over_budget(table(spark, d, "documents"), "source", 100000)


@query("SELECT doc_id, 'private ip' AS rule, list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?:^|[^0-9.])(?:10\\.\\d{1,3}|192\\.168|172\\.(?:1[6-9]|2\\d|3[01]))\\.\\d{1,3}\\.\\d{1,3}(?:$|[^0-9.]|\\.(?:$|[^0-9]))')), true)::BIGINT AS line FROM documents WHERE regexp_matches(text, '(?:^|[^0-9.])(?:10\\.\\d{1,3}|192\\.168|172\\.(?:1[6-9]|2\\d|3[01]))\\.\\d{1,3}\\.\\d{1,3}(?:$|[^0-9.]|\\.(?:$|[^0-9]))') UNION ALL SELECT doc_id, 'phrase', 0 FROM documents WHERE NOT contains(text, 'the')")
def dc23_markers(spark, d):
    return e.markers(table(spark, d, "documents"), "the")
