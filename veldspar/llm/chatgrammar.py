"""Chat formatting with a grammar round trip, with DataFrame functions alone.

    conversation := "<s>" turn* "</s>"
    turn         := "[INST " role " " escaped "]" body "[/INST]"      role URL-encoded; escaped 0 or 1
    body         := characters without "<s>", "</s>", "[INST" and "[/INST]"

A parser reads the rendered text back: it cuts at "[/INST]", takes each header, refuses a body with a control string,
and undoes the escapes where the header says so. A conversation is first rendered as it is. If the recovered turns
differ from the source, the turns that don't survive alone are escaped and, should that still differ, all of them: "\\"
doubles and a "\\" goes into every control string. The result is the first rendering whose turns come back unchanged.
The loss mask is read from the rendered text as well: the bodies of the parsed turns of the roles that are learned.

Turns are ordered by turn, then role, then text. A null text or role counts as empty; a null conversation id is a
conversation of its own; repeated rows are repeated turns; an empty table gives none. A conversation is one row of the
result, so it must fit a task; nothing else is gathered. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END, TURN, STOP = "<s>", "</s>", "[INST ", "[/INST]"
CONTROLS = {"[/INST]": "[\\/INST]", "[INST": "[\\INST", "</s>": "<\\/s>", "<s>": "<\\s>"}
HEADER = r"^\[INST ([^ \]]*) ([01])\]"
FORBIDDEN = r"</?s>|\[/INST\]|\[INST"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in CONTROLS.items():
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column, escape: Column) -> Column:
    return F.concat(F.lit(TURN), F.url_encode(role), F.lit(" "), F.when(escape, "1").otherwise("0"), F.lit("]"), F.when(escape, escaped(text)).otherwise(text), F.lit(STOP))


def rendered(turns: Column, escape) -> Column:
    """turns: array<struct<role, text>>; escape: a function from a turn to a boolean column."""
    return F.concat(F.lit(START), F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["text"], escape(t))), ""), F.lit(END))


def _read_turn(piece: Column) -> Column:
    head, body = F.regexp_extract(piece, HEADER, 0), _body(piece)
    role = F.when((F.length(head) > 0) & ~F.rlike(body, F.lit(FORBIDDEN)), F.try_url_decode(F.regexp_extract(piece, HEADER, 1)))
    return F.struct(role.alias("role"), F.when(_is_escaped(piece), unescaped(body)).otherwise(body).alias("text"))


def _body(piece: Column) -> Column:
    return piece.substr(F.length(F.regexp_extract(piece, HEADER, 0)) + 1, F.length(piece))


def _is_escaped(piece: Column) -> Column:
    return F.regexp_extract(piece, HEADER, 2) == "1"


def _pieces(text: Column) -> Column:
    """The turns of a rendered conversation, each without its end."""
    inner = text.substr(F.lit(len(START) + 1), F.length(text) - len(START) - len(END))
    parts = F.split(inner, r"\[/INST\]", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; a part that isn't a turn has a null role."""
    return F.transform(_pieces(text), _read_turn)


def loss_spans(text: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """array<struct<start, end>>, one a turn of a rendered conversation: where its body lies, in code points, if its role
    is among roles; otherwise an empty span at its place."""
    zero = F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        begin, end = s["at"] + F.length(F.regexp_extract(piece, HEADER, 0)), s["at"] + F.length(piece)
        learned = F.coalesce(F.try_url_decode(F.regexp_extract(piece, HEADER, 1)).isin(*roles), F.lit(False))
        return F.struct((end + len(STOP)).alias("at"), F.array_append(s["out"], F.struct(begin.alias("start"), F.when(learned, end).otherwise(begin).alias("end"))).alias("out"))

    return F.aggregate(_pieces(text), zero, step, lambda s: s["out"])


def loss_text(text: Column, spans: Column) -> Column:
    """What a rendered conversation holds under its loss spans, without the escapes, nothing between.

    Every span is cut out of its own turn, so that long conversations aren't read from their start each time."""
    cut = F.zip_with(_pieces(text), spans, lambda piece, x: F.struct(F.left(_body(piece), x["end"] - x["start"]).alias("body"), _is_escaped(piece).alias("escaped")))
    return F.array_join(F.transform(cut, lambda x: F.when(x["escaped"], unescaped(x["body"])).otherwise(x["body"])), "")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, level, turns, loss_spans): turns and spans are read back from formatted; level is 0 for no
    escapes, 1 for conflicting turns, 2 for all."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    source = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    never, always = (lambda t: F.lit(False)), (lambda t: F.lit(True))
    alone = lambda t: ~parsed(rendered(F.array(t), never)).eqNullSafe(F.array(t))
    first = source.withColumn("f0", rendered(F.col("source"), never))
    second = first.withColumn("ok0", parsed(F.col("f0")).eqNullSafe(F.col("source"))).withColumn("f1", F.when(~F.col("ok0"), rendered(F.col("source"), alone)))
    third = second.withColumn("level", F.when(F.col("ok0"), 0).when(parsed(F.col("f1")).eqNullSafe(F.col("source")), 1).otherwise(2))
    level = F.col("level")
    chosen = third.withColumn("formatted", F.when(level == 0, F.col("f0")).when(level == 1, F.col("f1")).otherwise(rendered(F.col("source"), always)))
    return chosen.select("conv_id", "formatted", "level", parsed(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("loss_spans"))


def digest(conversations: DataFrame) -> DataFrame:
    """Of each conversation, from the turns that were read back: counts and digests of the turns and of the loss text."""
    out = formatted(conversations)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    loss = F.col("loss")
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation that holds the template's own control strings.
CONFLICT = "</s>[INST] ok [/INST]"


def oracle() -> str:
    """The digest as DuckDB SQL, with the conversation -1 that the query adds."""
    safe = "replace(x, '\\', '\\\\')"
    for raw, to in CONTROLS.items():
        safe = f"replace({safe}, '{raw}', '{to}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONFLICT}'), (-1, 1, 'assistant', '{CONFLICT}')),
r AS (SELECT *, CASE WHEN regexp_matches(x, '{FORBIDDEN}') THEN {safe} ELSE x END AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(body) + length(url_encode(role)) + {len(TURN) + 3 + len(STOP)}) + {len(START) + len(END)})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
