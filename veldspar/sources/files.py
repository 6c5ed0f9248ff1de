"""Reading and writing files: delimited text, JSON events, logs, text corpora, exports."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a column of text may turn out to be, narrowest first.
LADDER = ("bigint", "double", "timestamp")


#: Encodings that Spark's CSV reader cuts and decodes itself.
SPARK_ENCODINGS = ("UTF-8", "US-ASCII", "ISO-8859-1")

#: Encodings in which the byte of a line feed may be part of another character, and that can't be told apart at a split.
WHOLE_ENCODINGS = ("UTF-16", "UTF-32")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, n, first, line): decoded lines of text files. Spark cuts the files at line feeds, block is the offset
    at which a split starts, n numbers its lines, first marks a file's first line. Nothing is shuffled, a task holds one
    batch of lines. Right for encodings whose other characters never hold the byte 0x0A (CP949, EUC-KR, Shift-JIS, ...), and for
    UTF-16LE and UTF-16BE, where a line feed is two bytes; a line of odd length there means that two characters were
    taken for one, and raises."""
    wide = encoding.upper() in ("UTF-16LE", "UTF-16BE")
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("encoding", encoding) if wide else reader).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def decoded(chunks):  # noqa: ANN001, ANN202
        at, n = None, 0
        for chunk in chunks:
            numbers, texts = [], []
            for file, block, line in zip(chunk["file"], chunk["block"], chunk["line"], strict=True):
                at, n = (file, block), n + 1 if at == (file, block) else 0
                if wide and len(line) % 2:
                    raise ValueError(f"{file}: a line of {len(line)} bytes isn't {encoding}")
                text = bytes(line).decode(encoding, "replace")
                texts.append(text.removeprefix("\ufeff") if block == 0 and n == 0 else text)
                numbers.append(n)
            out = chunk.assign(n=numbers, line=texts)
            yield out.assign(first=(out["block"] == 0) & (out["n"] == 0))[["file", "block", "n", "first", "line"]]

    return raw.mapInPandas(decoded, "file string, block long, n long, first boolean, line string")


def _records(lines: DataFrame, quote: str = '"', longest: int = 1 << 26) -> DataFrame:
    """(file, first, line): lines joined again where a line feed lies within quotes.

    Whether a line starts within quotes follows from the quotes before it: sums per split are added up along a file, and
    then along the lines of each split, so no task holds more than a split. Lines that are records of their own aren't
    grouped. A record of more than ``longest`` characters (an unclosed quote) raises before any is put together."""
    spot, in_file, in_block = F.struct("block", "n"), Window.partitionBy("file").orderBy("block"), Window.partitionBy("file", "block").orderBy("n")
    odd = lines.withColumn("q", F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))).withColumn("q", F.col("q") % 2)
    before = odd.groupBy("file", "block").agg(F.sum("q").alias("s")).select("file", "block", F.coalesce(F.sum("s").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"))
    inside = F.coalesce(F.sum("q").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("prior")
    cut = odd.join(before, ["file", "block"]).withColumn("open", inside % 2 == 1)
    starts = cut.groupBy("file", "block").agg(F.max(F.when(~F.col("open"), spot)).alias("last")).select("file", "block", F.last("last", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.last(F.when(~F.col("open"), spot), ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.join(starts, ["file", "block"]).withColumn("record", F.coalesce(own, "carried"))
    single = ~F.col("open") & (F.col("q") == 0)
    pieces = parts.filter(~single)
    most = pieces.groupBy("file", "record").agg(F.sum(F.length("line") + 1).alias("n")).agg(F.max("n")).first()[0]
    if most and most > longest:
        raise ValueError(f"a record of {most} characters: a quote isn't closed")
    joined = pieces.groupBy("file", "record").agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("p"))
    return parts.filter(single).select("file", "first", "line").unionByName(joined.select("file", "first", F.array_join("p.line", "\n").alias("line")))


def _decoded(spark: SparkSession, path: str, sep: str, encoding: str, null: str, multiline: bool) -> DataFrame:
    """Delimited files with a header, in an encoding that Spark's CSV reader doesn't cut."""
    lines = _lines(spark, path, encoding)
    records = _records(lines) if multiline else lines
    records = records.withColumn("line", F.regexp_replace("line", "\r$", ""))
    head = records.filter("first").select("line").first()
    names = next(csv.reader([head.line], delimiter=sep)) if head else []
    if not names:
        raise ValueError(f"{path}: no header")
    kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return records.filter("not first and line <> ''").select(F.from_csv("line", kinds, {"sep": sep, "nullValue": null, "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")


def load_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", null: str = "", decimal: str = ".", schema: str | None = None, multiline: bool = False) -> DataFrame:
    """Delimited files with a header. With a schema, columns are cast and bad values become null; a decimal comma is
    read where ``decimal`` says so. Without one every column stays text (see demotions). Files are read in splits, whatever
    the encoding, but for UTF-16 and UTF-32 whose byte order isn't named. ``multiline``: quoted values may hold line ends; in
    splits too (see _records). Empty lines are skipped."""
    if encoding.upper() in WHOLE_ENCODINGS:
        raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, nullValue=null, multiLine=True)
    elif encoding.upper() in SPARK_ENCODINGS and not multiline:
        raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, nullValue=null)
    else:
        raw = _decoded(spark, path, sep, encoding, null, multiline)
    if schema is None:
        return raw
    fields = T._parse_datatype_string(schema).fields
    number = lambda c: F.translate(c, decimal, ".") if decimal != "." else F.col(c)
    return raw.select(*[(number(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in fields])


def demotions(text: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """For each text column: how many values a cast would lose, and whether it has to stay text. One pass."""
    lost = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(to).isNull()).alias(c) for c in columns]
    return text.agg(*lost).unpivot([], columns, "column_name", "n_lost").withColumn("stays_text", F.col("n_lost") > 0)


def pruned(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def decode_events(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON lines (batch or stream) to event columns; lines that aren't objects, or have no type, are dropped."""
    event = F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("e")
    return lines.select(event).filter("e is not null and e.type is not null").select("e.*")


def follow(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Streams the lines of text files as they arrive in a folder; Spark's checkpoint keeps the offsets."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files; a notebook's code cells are joined, other files are as they are."""
    cells = F.from_json("value", "cells array<struct<cell_type:string,source:array<string>>>")["cells"]
    code = F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.array_join(c["source"], "")), "\n")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.when(F.col("_metadata.file_name").endswith(".ipynb"), code).otherwise(F.col("value")).alias("text"))


def export_days(events: DataFrame, first: str, last: str, columns: list[str], time: str = "ts") -> DataFrame:
    """The events of the days from first to last, both included, in narrow columns."""
    return events.filter((F.col(time) >= F.lit(first).cast("timestamp")) & (F.col(time) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))).select(*columns)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def keep_last(runs: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The last n runs of each key."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n")
