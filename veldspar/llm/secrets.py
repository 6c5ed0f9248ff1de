"""Secret scans with DataFrame functions alone: three fixed patterns, and high-entropy strings.

The entropy scan takes runs of base-64 characters as candidates. An allow-list takes whole strings (UUIDs, paths) out,
and listed parts are cut out of a candidate, however long it is; what remains in one piece of ``WINDOW`` characters or
more is scanned. A candidate has the narrowest character class that holds it (hex, alphanumeric, base64); a window
slides over its pieces with a count per symbol, of which a step changes two, and the candidate is reported when the
largest window entropy of a piece with a digit and a letter reaches the threshold of the class. Candidates that meet a
pattern's span are left out.

Time is in proportion to the text: the counts lie in a few longs, a text becomes an array of codes once, and spans are
found by binary search.

Spans are in code points, the end exclusive. A null text counts as empty and has no spans; an empty table gives an
empty result; repeated rows are scanned one by one; only the text column is read. Ties between spans at one start are
ordered by kind as in KINDS. Nothing is shuffled or truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, and what a match must reach.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of [0-9a-f]+ with 32 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Candidates of the entropy scan, its window, the thresholds in bits by class, and what is allowed.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^/([A-Za-z0-9_=-]+/)+"
ALLOWED_PART = r"(?i)example|dummy|placeholder|xxxx|0123456789|abcdefghij|^[/_=-]+|[/_=-]{3,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


_CHUNK, _PIECE, _SPANS = 128, 512, "array<struct<start:int,end:int,hit:string>>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often and in whatever lambda body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches; hit is the matched text.

    Places are running sums of the gaps and hits, by chunks: an array that grows by one is copied each time."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def with_hits(hits: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))

    def in_chunk(chunk: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(s["out"], F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"))).alias("out"))
        return F.aggregate(chunk, zero, step)

    def chunked(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / _CHUNK).cast("int") - 1), lambda k: in_chunk(F.slice(found, k * _CHUNK + 1, _CHUNK)))

    def joined(chunks: Column) -> Column:
        ends = F.aggregate(chunks, F.array(F.lit(0)), lambda s, c: F.array_append(s, F.element_at(s, -1) + c["at"]))
        moved = lambda c, at: F.transform(c["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["hit"].alias("hit")))
        return F.flatten(F.zip_with(chunks, F.slice(ends, 1, F.size(chunks)), moved))

    return F.when(F.rlike(text, F.lit(pattern)), _let(_let(_let(hits, with_hits), chunked), joined)).otherwise(F.array().cast(_SPANS))


def _as_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


_BITS, _A_LONG = 5, 12  # bits of a symbol's count, and symbols a long


def _bits(x: Column) -> Column:
    """Largest entropy of a window of x (WINDOW characters or more), from counts of which each step changes two."""
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    at = lambda code: ((code % _A_LONG) * _BITS).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), at(code))
    longs = -(-len(ALPHABET) // _A_LONG)

    def slide(codes: Column) -> Column:
        count = lambda n, code: F.call_function("shiftright", F.element_at(n, F.floor(code / _A_LONG).cast("int") + 1), at(code)).bitwiseAND(F.lit((1 << _BITS) - 1))
        changed = lambda n, code, by: F.transform(n, lambda v, k: F.when(k == F.floor(code / _A_LONG), v + by * one(code)).otherwise(v))

        def add(s: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = count(s["n"], new)
            return F.struct(changed(s["n"], new, 1).alias("n"), (s["w"] + weight(old + 1) - weight(old)).alias("w"), s["best"].alias("best"))

        def drop(s: Column, i: Column) -> Column:
            gone = F.element_at(codes, i)
            old = count(s["n"], gone)
            return F.struct(changed(s["n"], gone, -1).alias("n"), (s["w"] + weight(old - 1) - weight(old)).alias("w"), s["best"].alias("best"))

        def step(s: Column, i: Column) -> Column:
            kept = _let(s, lambda s: F.when(i > WINDOW, drop(s, i - WINDOW)).otherwise(s))
            both = _let(kept, lambda s: add(s, i))
            return _let(both, lambda s: F.struct(s["n"].alias("n"), s["w"].alias("w"), F.when(i >= WINDOW, F.least(s["best"], s["w"])).otherwise(s["best"]).alias("best")))

        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("w"), F.lit(1e9).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["best"])

    codes = F.transform(F.split(x, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    return F.log2(F.lit(float(WINDOW))) - _let(codes, slide) / WINDOW


def _meets(spans: Column, x: Column) -> Column:
    """Whether one of the spans (in order, apart from each other) shares a character with x: the last that begins
    before x's end does, or none. It is found by halving."""

    def before_end(spans: Column) -> Column:
        half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

        def step(s: Column, _: Column) -> Column:
            below = F.element_at(spans, half(s) + 1)["start"] < x["end"]
            return F.when(s["lo"] >= s["hi"], s).when(below, F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
        return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), step, lambda s: s["lo"])

    found = lambda n: F.when(n > 0, F.element_at(spans, F.greatest(n, F.lit(1)))["end"] > x["start"]).otherwise(False)
    return F.when(F.size(spans) > 0, _let(before_end(spans), found)).otherwise(False)


def _strong(hit: Column) -> Column:
    least = F.when(hit.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).when(hit.rlike("^[0-9a-zA-Z]+$"), LEAST_BITS["alnum"]).otherwise(LEAST_BITS["base64"])
    parts = F.filter(F.split(hit, ALLOWED_PART, -1), lambda p: (F.length(p) >= WINDOW) & p.rlike("[0-9]") & p.rlike("[A-Za-z]"))
    return F.when(hit.rlike(ALLOWED), False).otherwise(F.exists(parts, lambda p: F.round(_bits(p), 6) >= least))


def spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of all spans of a text, by start, then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    value = lambda x: F.regexp_extract(x["hit"], ASSIGN, 2)
    assign = F.filter(_placed(text, ASSIGN), lambda x: F.length(value(x)) >= LEAST_ASSIGN)
    access = F.filter(_placed(text, ACCESS), lambda x: F.length(x["hit"]) >= LEAST_ACCESS)

    def found(base: Column) -> Column:
        apart = lambda x: ~(_meets(base["assign"], x) | _meets(base["access"], x) | _meets(base["hex"], x))
        entropy = F.filter(_placed(text, CANDIDATE), lambda x: apart(x) & _strong(x["hit"]))
        return F.array_sort(F.concat(*[_as_kind(base[k], k) for k in KINDS[:3]], _as_kind(entropy, "entropy")))

    return _let(F.struct(assign.alias("assign"), access.alias("access"), _placed(text, HEX).alias("hex")), found)


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """docs with the spans of the text as a further column, which replaces one of that name."""
    return docs.withColumn(out_col, spans(F.col(text_col)))


_CUTS = "array<struct<from:int,to:int>>"


def _gaps(found: Column, length: Column) -> Column:
    """array<struct<from, to>>: what no span covers, in order, the last one up to length; found is ordered by start."""

    def in_chunk(state: Column, chunk: Column) -> Column:
        zero = F.struct(state["at"].alias("at"), F.array().cast(_CUTS).alias("out"))
        gap = lambda s, x: F.when(x["start"] >= s["at"], F.array_append(s["out"], F.struct(s["at"].alias("from"), x["start"].alias("to")))).otherwise(s["out"])
        step = lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), gap(s, x).alias("out")))
        return _let(F.aggregate(chunk, zero, step), lambda c: F.struct(c["at"].alias("at"), F.array_append(state["out"], c["out"]).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(found) / _CHUNK).cast("int") - 1), lambda k: F.slice(found, k * _CHUNK + 1, _CHUNK))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_CUTS}>").alias("out"))
    return F.aggregate(chunks, zero, in_chunk, lambda s: F.array_append(F.flatten(s["out"]), F.struct(s["at"].alias("from"), length.alias("to"))))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark; null stays null.

    What is kept is cut out of pieces of the text, as a search for a character begins at the first one."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def cut(pieces: Column) -> Column:
        first = lambda g: F.floor(g["from"] / _PIECE).cast("int")
        near = lambda g: F.array_join(F.slice(pieces, first(g) + 1, F.ceil(g["to"] / _PIECE).cast("int") - first(g)), "")
        kept = lambda g: F.when(g["to"] > g["from"], near(g).substr(g["from"] % _PIECE + 1, g["to"] - g["from"])).otherwise("")
        return F.array_join(F.transform(_gaps(found, F.length(text)), kept), mark)

    return F.when(F.size(found) > 0, _let(pieces, cut)).otherwise(text)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, a digest of their spans, and all spans."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), spans(F.col(text_col)).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_joined(F.filter("found", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql_placed(pattern: str) -> str:
    hits = f"regexp_extract_all(t, '{pattern}')"
    gaps = f"string_split_regex(t, '{pattern}')"
    return f"list_transform(range(1, len({hits}) + 1), lambda i: {{'s': (list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[1:i-1], lambda x: length(x))), 0))::BIGINT, 'h': {hits}[i]}})"


def oracle() -> str:
    """The same result as DuckDB SQL."""
    q = lambda p: p.replace("'", "''")
    assign = q(ASSIGN.replace("(?i)(password|passwd|secret|token|api_?key)", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])").replace(r"\x20", " "))
    bits = f"round(list_max(list_transform(range(1, length(p) - {WINDOW - 2}), lambda k: list_aggregate(string_split(substr(p, k, {WINDOW}), ''), 'entropy'))), 6)"
    parts = f"list_filter(string_split_regex(x.h, '{ALLOWED_PART}'), lambda p: length(p) >= {WINDOW} AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Za-z]'))"
    least = f"CASE WHEN regexp_full_match(x.h, '[0-9a-fA-F]+') THEN {LEAST_BITS['hex']} WHEN regexp_full_match(x.h, '[0-9a-zA-Z]+') THEN {LEAST_BITS['alnum']} ELSE {LEAST_BITS['base64']} END"
    kind = lambda name: f"list_transform({name}, lambda x: {{'s': x.s, 'r': {KINDS.index(name)}, 'e': x.s + length(x.h), 'k': '{name}'}})"
    joined = lambda spans: f"list_aggregate(list_transform({spans}, lambda x: x.k || ':' || x.s || ':' || x.e), 'string_agg', ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id,
  list_filter({_sql_placed(assign)}, lambda x: length(regexp_extract(x.h, '{assign}', 2)) >= {LEAST_ASSIGN}) AS assign,
  list_filter({_sql_placed(ACCESS)}, lambda x: length(x.h) >= {LEAST_ACCESS}) AS access,
  {_sql_placed(HEX)} AS hex, {_sql_placed(CANDIDATE)} AS candidate FROM d),
b AS (SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex, candidate, list_concat(list_concat({kind('assign')}, {kind('access')}), {kind('hex')}) AS base FROM p),
e AS (SELECT *, list_filter(candidate, lambda x: NOT regexp_matches(x.h, '{ALLOWED}')
  AND len(list_filter(base, lambda y: y.s < x.s + length(x.h) AND x.s < y.e)) = 0 AND len(list_filter({parts}, lambda p: {bits} >= {least})) > 0) AS entropy FROM b)
SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, sha256(coalesce({joined('list_sort(base)')}, '')) AS base_sha256,
  coalesce({joined(f"list_sort(list_concat(base, {kind('entropy')}))")}, '') AS spans FROM e"""
