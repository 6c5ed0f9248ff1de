"""Document evidence: fragments of pasted texts, duplicates, citations, numbers, scans.

Folds over a document's lines are ordered aggregates over one array, so a document must fit a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import calc

# Limits, and what marks mail, chat, rules and sentences.
LONGEST, SHORTEST = 420, 60
PASTE_LIMIT, TOPIC_LIMIT, FRAGMENT_LIMIT = 100_000, 400_000, 3000
MAIL = r"(?im)^\s*(from|to|cc|sent|date|subject|보낸\s*사람|받는\s*사람|참조|보낸\s*날짜|날짜|제목)\s*:"
SUBJECT = r"(?im)^\s*(?:subject|제목)\s*:\s*(.+)$"
CHAT = r"(?im)^\s*(?:\[[^\]\n]{1,24}\]\s*\[(?:오전|오후)\s*\d{1,2}:\d{2}\]|(?:오전|오후)\s*\d{1,2}:\d{2}\b|\d{1,2}:\d{2}\s*(?:AM|PM)?\s)"
RULE = r"^[\s\-=_*~·•.#]{3,}$"
SENTENCE = r"(?<=[.!?。…])\s+"
SECRETS = {"openai": r"\bsk-[A-Za-z0-9_\-]{20,}", "github": r"\b(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{30,}|\bgithub_pat_[A-Za-z0-9_]{30,}", "aws": r"\bAKIA[0-9A-Z]{16}\b", "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "private key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"}

_TEXTS = "array<string>"


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def kind(text: Column) -> Column:
    """table (60 % of the lines, two at least, have tabs), mail, chat or text."""
    lines = _filled(text)
    tabs = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t"))))
    return F.when((F.size(lines) >= 2) & (tabs >= F.greatest(F.lit(2), F.floor(F.size(lines) * 0.6))), "table").when(F.regexp_count(text, F.lit(MAIL)) >= 2, "mail").when(F.regexp_count(text, F.lit(CHAT)) >= 3, "chat").otherwise("text")


def _is_quote(line: Column) -> Column:
    return F.startswith(F.trim(line), F.lit(">"))


def quotes(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), _is_quote))


def _once(value: Column, body) -> Column:
    """body of a value that is computed once, also where lambdas inside of it use the value for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(text: Column) -> Column:
    """array<array<string>>: trimmed lines without quotes, in blocks that blank lines and rules end."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: ~_is_quote(x))
    marked = F.array_join(F.transform(lines, lambda x: F.when((x == "") | x.rlike(RULE), F.lit("\x1d")).otherwise(F.concat(x, F.lit("\x1e")))), "")
    return F.transform(F.filter(F.split(marked, "\x1d+"), lambda b: b != ""), lambda b: F.filter(F.split(b, "\x1e"), lambda x: x != ""))


def _packed(parts: Column, joint: str, limit: int) -> Column:
    """Parts joined, in order, into pieces of at most ``limit`` characters; longer parts stay alone."""
    zero = F.struct(F.array().cast(_TEXTS).alias("out"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        full = (s["cur"] != "") & (F.length(s["cur"]) + len(joint) + F.length(x) > limit)
        return F.struct(F.when(full, F.array_append(s["out"], s["cur"])).otherwise(s["out"]).alias("out"), F.when(full | (s["cur"] == ""), x).otherwise(F.concat(s["cur"], F.lit(joint), x)).alias("cur"))

    return F.aggregate(parts, zero, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def _split_long(sentence: Column, limit: int) -> Column:
    """A sentence beyond the limit, cut before it at a space of its second half, else at the limit."""
    zero = F.struct(sentence.alias("rest"), F.array().cast(_TEXTS).alias("out"))

    def step(s: Column, _: Column) -> Column:
        head = F.substring(s["rest"], 1, limit)
        back = F.instr(F.reverse(head), " ")
        at = F.when((back > 0) & (limit - back >= limit // 2), limit - back).otherwise(limit)
        long = F.length(s["rest"]) > limit
        return F.struct(F.when(long, F.trim(s["rest"].substr(at + 1, F.length(s["rest"])))).otherwise(s["rest"]).alias("rest"), F.when(long, F.array_append(s["out"], F.trim(s["rest"].substr(F.lit(1), at)))).otherwise(s["out"]).alias("out"))

    turns = F.sequence(F.lit(0), F.ceil(F.length(sentence) * 2 / limit).cast("int"))
    return F.aggregate(turns, zero, step, lambda s: F.when(s["rest"] == "", s["out"]).otherwise(F.array_append(s["out"], s["rest"])))


def cut(line: Column, limit: int = LONGEST) -> Column:
    """An over-long line in pieces: sentences, long ones cut, then packed again."""
    parts = F.flatten(F.transform(F.split(line, SENTENCE), lambda s: _split_long(s, limit)))
    return F.when(F.length(line) <= limit, F.array(line)).otherwise(_packed(parts, " ", limit))


def merged(pieces: Column, least: int = SHORTEST, limit: int = LONGEST) -> Column:
    """Pieces shorter than ``least`` take the next one in, if both fit."""

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (F.length(last) < least) & (F.length(last) + 1 + F.length(p) <= limit)
        return F.when(joins, F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.concat(last, F.lit("\n"), p))).otherwise(F.array_append(out, p))

    zero = F.array().cast(_TEXTS)
    return F.aggregate(pieces, zero, lambda out, p: F.when(F.size(out) == 0, F.array(p)).otherwise(step(out, p)))


def packed_blocks(text: Column, limit: int = LONGEST) -> Column:
    """Fragments of a text before short ones are merged."""
    return F.flatten(F.transform(blocks(text), lambda b: _packed(F.flatten(F.transform(b, lambda x: cut(x, limit))), "\n", limit)))


def table_rows(text: Column) -> Column:
    """Rows of tab-separated text as "header: value" parts, where the first line is a header: short, not numeric."""
    rows = F.transform(_filled(text), lambda x: F.transform(F.split(x, "\t", -1), lambda c: F.trim(c)))

    def texts(rows: Column, head: Column) -> Column:
        headed = (F.size(rows) > 1) & F.forall(head, lambda h: (h != "") & (F.length(h) <= 30) & ~h.rlike(r"^[\d,.\-%\s]+$"))
        name = lambda i: F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("열"), i + 1))
        named = F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", F.concat(name(i), F.lit(": "), c))), lambda x: x.isNotNull()))
        plain = F.transform(rows, lambda r: F.filter(r, lambda c: c != ""))
        return F.filter(F.transform(F.when(headed, named).otherwise(plain), lambda r: F.array_join(r, " · ")), lambda x: x != "")

    return _once(rows, lambda rows: _once(F.get(rows, F.lit(0)), lambda head: texts(rows, head)))


def title(text: Column) -> Column:
    """Mail subject, or the first line without a chat head, or a table's first cells; 60 characters at most."""
    first = F.trim(F.get(_filled(text), F.lit(0)))
    cells = F.array_join(F.slice(F.filter(F.transform(F.split(first, "\t"), lambda c: F.trim(c)), lambda c: c != ""), 1, 3), " · ")
    k = kind(text)
    return F.substring(F.coalesce(F.when(k == "table", cells).when(k == "mail", F.nullif(F.trim(F.regexp_extract(text, SUBJECT, 1)), F.lit(""))).when(k == "chat", F.trim(F.regexp_replace(first, CHAT, ""))), first, F.lit("")), 1, 60)


def fragments(pastes: DataFrame) -> DataFrame:
    """(topic, paste_id, position, text) of pastes (topic, paste_id, text)."""
    split = lambda t: F.when(kind(t) == "table", F.flatten(F.transform(table_rows(t), lambda x: cut(x)))).otherwise(merged(packed_blocks(t)))
    parts = _once(calc.normalised(F.col("text")), split)
    return pastes.select("topic", "paste_id", F.posexplode(parts).alias("position", "text"))


def deduplicated(frags: DataFrame) -> DataFrame:
    """The first fragment of each key in a topic, with how many later ones it stands for; keys under 2 characters go."""
    keyed = frags.withColumn("key", calc.fragment_key(F.col("text"))).filter(F.length("key") >= 2)
    first = keyed.groupBy("topic", "key").agg(F.min_by("text", F.struct("paste_id", "position")).alias("text"), F.min(F.struct("paste_id", "position")).alias("at"), (F.count("*") - 1).alias("duplicates"))
    return first.select("topic", "at.paste_id", "at.position", "key", "text", "duplicates")


def paste_totals(frags: DataFrame, pastes: DataFrame) -> DataFrame:
    """Per topic: characters, duplicates skipped, quoted lines skipped."""
    dup = deduplicated(frags).groupBy("topic").agg(F.sum("duplicates").alias("duplicates"))
    return pastes.groupBy("topic").agg(F.sum(F.length("text")).alias("chars"), F.sum(quotes(F.col("text"))).alias("quotes")).join(dup, "topic", "left")


def within_quota(pastes: DataFrame, paste_limit: int = PASTE_LIMIT, topic_limit: int = TOPIC_LIMIT, count_limit: int = FRAGMENT_LIMIT) -> DataFrame:
    """(topic, paste_id) that the quotas admit, in order of arrival: a refused paste doesn't count for later ones. A
    topic is sorted and streamed through a task that holds two sums. pastes: topic, paste_id, chars, frags (null: 0)."""
    sized = pastes.select("topic", "paste_id", F.coalesce(F.col("chars").cast("long"), F.lit(0).cast("long")).alias("chars"), F.coalesce(F.col("frags").cast("long"), F.lit(0).cast("long")).alias("frags"))

    def run(batches):
        topic, started, used, held = None, False, 0, 0
        for batch in batches:
            keep = []
            for t, chars, frags in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not started or t != topic:
                    topic, started, used, held = t, True, 0, 0
                ok = chars <= paste_limit and used + chars <= topic_limit and held + frags <= count_limit
                used, held = (used + chars, held + frags) if ok else (used, held)
                keep.append(ok)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return sized.repartition("topic").sortWithinPartitions("topic", "paste_id", "chars", "frags").mapInArrow(run, sized.select("topic", "paste_id").schema)


def unsupported(lines: DataFrame, cited: DataFrame) -> DataFrame:
    """(line_id, numbers): numbers of a line that none of its cited fragments has; single digits don't count. lines:
    line_id, text; cited: line_id, text."""
    have = cited.select("line_id", F.explode(calc.canonical_numbers(F.col("text"))).alias("n")).groupBy("line_id").agg(F.collect_set("n").alias("have"))
    own = lines.select("line_id", F.array_distinct(F.filter(calc.canonical_numbers(F.col("text")), lambda n: ~n.rlike(r"^\d$"))).alias("own"))
    return own.join(have, "line_id", "left").select("line_id", F.array_except("own", F.coalesce("have", F.array().cast(_TEXTS))).alias("numbers")).filter(F.size("numbers") > 0)


def verdicts(lines: DataFrame, known_refs: DataFrame) -> DataFrame:
    """(line_id, state): user, gap, err (a fact without known references), ok, infer or check. lines: line_id, origin,
    kind; known_refs: line_id of each known reference."""
    cited = known_refs.groupBy("line_id").agg(F.count("*").alias("refs"))
    k = F.when(F.col("kind").isin("fact", "infer", "check", "gap"), F.col("kind")).otherwise("fact")
    state = F.when(F.col("origin") == "user", "user").when(k == "gap", "gap").when(F.coalesce("refs", F.lit(0)) == 0, "err").when(k == "fact", "ok").otherwise(k)
    return lines.join(cited, "line_id", "left").select("line_id", state.alias("state"))


def citations(refs: DataFrame) -> DataFrame:
    """(report, fragment_id, number) by first use. refs: report, line_no, position, fragment_id."""
    first = refs.groupBy("report", "fragment_id").agg(F.min(F.struct("line_no", "position")).alias("at"))
    return first.select("report", "fragment_id", F.row_number().over(Window.partitionBy("report").orderBy("at", "fragment_id")).alias("number"))


def outline(frags: DataFrame, per_paste: int = 3) -> DataFrame:
    """A draft without a model: the first fragments of each paste, and a gap line where a topic has none. frags: topic,
    paste_id, position, text (null text: a paste without fragments)."""
    w = Window.partitionBy("topic", "paste_id").orderBy("position")
    rows = frags.filter("text is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_paste).select("topic", "paste_id", "n", F.lit("fact").alias("kind"))
    empty = frags.groupBy("topic").agg(F.count("text").alias("c")).filter("c = 0").select("topic", F.lit(None).cast("long").alias("paste_id"), F.lit(1).alias("n"), F.lit("gap").alias("kind"))
    return rows.union(empty)


def number_check(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(claim_id, verdict): match, rounded, percent, sign, differs or uncited. claims: claim_id, calc_id, value, digits;
    results: calc_id, result."""
    x, y = F.col("value"), F.col("result")
    near = lambda a, b: F.abs(a - b) <= F.lit(0.5000001) * F.pow(F.lit(10.0), -F.col("digits"))
    return claims.join(results, "calc_id", "left").select("claim_id", F.when(y.isNull(), "uncited").when(x == y, "match").when(near(x, y), "rounded").when(near(x, y * 100), "percent").when(near(-x, y), "sign").otherwise("differs").alias("verdict"))


#: Numbers that claim nothing: ordinals, periods, ranks, identifiers.
MASKS = r"(?i)\b\d+(?:st|nd|rd|th)\b|\b\d{4}-\d{2}(?:-\d{2})?\b|\bQ[1-4]\b|#\d+|\btop\s*\d+\b|\b[A-Za-z]+[-_]?\d+\b"


def claimed_numbers(text: Column) -> Column:
    return calc.canonical_numbers(F.regexp_replace(text, MASKS, " "))


def first_lines(texts: DataFrame, patterns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, rule, line): the first line (from 1) on which each pattern matches."""
    def line(p: str) -> Column:
        return F.array_position(F.transform(F.split("text", "\n"), lambda x: x.rlike(p)), True)

    cols = [F.struct(F.lit(name).alias("rule"), line(p).alias("line")) for name, p in patterns.items()]
    anywhere = F.lit(False)
    for p in patterns.values():
        anywhere = anywhere | F.col("text").rlike(p)
    return texts.filter(anywhere).select(key, F.explode(F.array(*cols)).alias("r")).select(key, "r.*").filter("line > 0")


# How colours are written.
HEX_COLOUR = r"(?<![\w&#])#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{3})(?![0-9A-Za-z])"
RGB_COLOUR = r"rgba?\(\s*(\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3})"


def colours(text: Column) -> Column:
    """The distinct colours of a text as six hexadecimal digits: #rrggbb, #rgb, rgb() and rgba(), parts above 255 as 255."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(HEX_COLOUR), F.lit(1)), lambda c: F.lower(F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c)))
    part = lambda n: F.lower(F.lpad(F.hex(F.least(F.trim(n).cast("int"), F.lit(255))), 2, "0"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(RGB_COLOUR), F.lit(1)), lambda c: F.array_join(F.transform(F.split(c, ","), part), ""))
    return F.array_distinct(F.concat(digits, numbers))


def off_palette(texts: DataFrame, bands: list[tuple[float, float]], key: str = "page_id") -> DataFrame:
    """(key, colour): colours whose hue lies in none of the bands; greys always pass."""
    found = texts.select(key, F.explode(colours(F.col("text"))).alias("colour"))
    part = lambda i: F.conv(F.substring("colour", i, 2), 16, 10).cast("int")
    h = calc.hue(part(1), part(3), part(5))
    inside = F.lit(False)
    for low, high in bands:
        inside = inside | h.between(low, high)
    return found.filter(h.isNotNull() & ~inside)


def links(texts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, target): Markdown and HTML links to local paths, without fragment and query."""
    md = F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    html = F.regexp_extract_all("text", F.lit("(?:href|src)=\"([^\"]+)\""), F.lit(1))
    out = texts.select(key, F.explode(F.concat(md, html)).alias("target")).filter(~F.col("target").rlike("^[a-z]+:|^//|^#"))
    return out.select(key, F.regexp_replace("target", "[?#].*$", "").alias("target")).filter("target <> ''").distinct()


def required_files(listing: DataFrame, required: list[str]) -> DataFrame:
    """(owner, path) of required paths that an owner's listing (owner, path) lacks."""
    wanted = listing.select("owner").distinct().select("owner", F.explode(F.array(*[F.lit(r) for r in required])).alias("path"))
    return wanted.join(listing, ["owner", "path"], "left_anti")


def context_budget(turns: DataFrame, chars: int) -> DataFrame:
    """The newest turns of each conversation whose characters fit together."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.length("text")).over(w)).filter(F.col("used") <= chars)


def shared_copies(docs: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """(digest, owners, copies) of equal texts with several owners."""
    return docs.groupBy(F.sha2(text, 256).alias("digest")).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("copies")).filter("owners > 1")


def over_budget(docs: DataFrame, owner: str, chars: int) -> DataFrame:
    return docs.groupBy(owner).agg(F.sum(F.length("text")).alias("chars")).withColumn("over", F.col("chars") > chars)


# Private addresses, with no digit or dot before and no digit or further number behind, and placeholders.
MARKERS = {"private ip": r"(?<![\d.])(?:10\.\d{1,3}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", "placeholder": r"\{\{[A-Z_]+\}\}"}


def markers(texts: DataFrame, phrase: str, key: str = "doc_id") -> DataFrame:
    """first_lines() of MARKERS, and line 0 of texts that lack a required phrase."""
    lacking = texts.filter(~F.contains("text", F.lit(phrase))).select(key, F.lit("phrase").alias("rule"), F.lit(0).cast("long").alias("line"))
    return first_lines(texts, MARKERS, key).union(lacking)
