"""Calculated columns: expressions that users of a table tool expect, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(a, b)


def if_(test: Column, yes, no) -> Column:
    return F.when(test, yes).otherwise(no)


def substitute_null(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def left(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def right(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def mid(x: Column, start: int, n: int) -> Column:
    return F.substring(x, start, n)


def nice_ceiling(x: Column) -> Column:
    """The smallest of 1, 2, 2.5, 5, 10 times a power of ten that x (positive) doesn't exceed; 1 for zero and less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    ratio = F.round(x / power, 9)
    step = F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 2.5, 2.5).when(ratio <= 5, 5.0).otherwise(10.0)
    return F.when(x > 0, step * power).otherwise(1.0)


def normalised(text: Column) -> Column:
    """Line ends to \\n, zero-width characters and soft hyphens out, no-break spaces to spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\u00ad\u200b-\u200d\u2060\ufeff]", ""), " ", " ")


def fragment_key(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


# Fixed value: a number in a text.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


def canonical_numbers(text: Column) -> Column:
    """The numbers of a text without separators, leading zeros and trailing decimals: 1,500 -> 1500, 3.50 -> 3.5."""
    def canonical(n: Column) -> Column:
        n = F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"^0+(?=\d)", "")
        return F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), canonical)


def redacted(text: Column) -> Column:
    """Values of password-like keys, and passwords in URLs, as ***."""
    text = F.regexp_replace(text, r"(?i)\b(password|passwd|pwd|token|secret|api_?key)(\s*[=:]\s*)[^\s&;,]+", "$1$2***")
    return F.regexp_replace(text, r"(://[^/\s:@]+:)[^@\s/]+@", "$1***@")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees from 0 to 360; null for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    return F.when(d > 0, F.when(top == r, F.pmod(60 * (g - b) / d, F.lit(360.0))).when(top == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240))


def saturation(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, (top - low) / top).otherwise(0.0)


def hue_gap(a: Column, b: Column) -> Column:
    """Shortest way around the circle."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def hue_name(h: Column) -> Column:
    return F.when(h.isNull(), "grey").when((h < 15) | (h >= 345), "red").when(h < 45, "orange").when(h < 70, "yellow").when(h < 165, "green").when(h < 200, "cyan").when(h < 260, "blue").when(h < 300, "purple").otherwise("pink")


#: A log line: level, time, duration, then key=value pairs.
LOG = r"^(DEBUG|INFO|WARN|ERROR)\s+(\S+)\s+\+(\d+)ms\s*(.*)$"


def log_fields(line: Column) -> Column:
    """struct(level, time, ms, fields map); all null for a line of another form. The last of equal keys wins."""
    pairs = F.regexp_extract_all(F.regexp_extract(line, LOG, 4), F.lit(r"(\w+)=(\"[^\"]*\"|\S+)"), F.lit(0))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("key"), F.trim(F.regexp_extract(p, r"(?s)^\w+=(.*)$", 1), F.lit('"')).alias("value"))
    entries = F.transform(pairs, entry)
    lasting = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    ok = line.rlike(LOG)
    return F.struct(F.when(ok, F.regexp_extract(line, LOG, 1)).alias("level"), F.when(ok, F.regexp_extract(line, LOG, 2).try_cast("timestamp")).alias("time"), F.when(ok, F.regexp_extract(line, LOG, 3).try_cast("long")).alias("ms"), F.when(ok, F.map_from_entries(lasting)).alias("fields"))


def log_passes(level: Column, line: Column, least: str = "INFO", text: str = "") -> Column:
    """Lines of a level and above that hold a text; lines without a level pass the first test."""
    levels = F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "WARN", "ERROR")])
    return (level.isNull() | (F.array_position(levels, level) >= F.array_position(levels, F.lit(least)))) & (F.instr(F.lower(line), text.lower()) > 0 if text else F.lit(True))


def wait_label(title: Column, permission: Column, patterns: Column, question: Column) -> Column:
    """A title, else the permission with its patterns, else the question; 80 characters at most."""
    asked = F.when(permission.isNotNull(), F.concat_ws(" ", permission, F.array_join(patterns, ", ")))
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), asked, question, F.lit("?")), 1, 80)


def looks_like_sql(text: Column) -> Column:
    """Whether a text is an SQL statement: its first keyword, with what that keyword must be followed by."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    rule = lambda first, rest: t.rlike(rf"(?is)^\s*\(*\s*{first}\b.*{rest}")
    return rule("select", r"\bfrom\b") | rule("with", r"\bas\s*\(.*\bselect\b") | rule(r"insert\s+(?:into|overwrite)", r"\b(?:select|values)\b") | rule(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)", r"\S") | rule("update", r"\bset\b") | rule(r"delete\s+from", r"\S") | rule(r"merge\s+into", r"\busing\b") | rule(r"(?:drop|truncate)\s+(?:table|view)", r"\S")


def without_reasoning(text: Column) -> Column:
    """A model's answer without its <think> blocks, an unended one included."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|$)", ""))


def inline_references(text: Column) -> Column:
    """Ids of [p3] and [p3, p4] marks, in lower case, each once."""
    marks = F.regexp_extract_all(text, F.lit(r"(?i)\[\s*(p\d+(?:\s*,\s*p\d+)*)\s*\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.split(F.lower(F.regexp_replace(m, r"\s", "")), ","))))


def report_lines(answer: Column) -> Column:
    """array<struct<section, text, refs>> of a JSON report, which may stand in a fence or among other text, with either
    of two names for each field; null if there is none."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    schema = "lines array<struct<section:int,sec:int,text:string,line:string,refs:array<string>,sources:array<string>>>"
    lines = F.from_json(body, schema)["lines"]
    return F.transform(lines, lambda x: F.struct(F.coalesce(x["section"], x["sec"]).alias("section"), F.coalesce(x["text"], x["line"]).alias("text"), F.coalesce(x["refs"], x["sources"], F.array().cast("array<string>")).alias("refs")))
