"""The corpus pipeline: its stages in order, each one of the operators of veldspar.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the shared
folder and reads them again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import decontam, ordinal, pieces, secrets, simhash
from veldspar.llm.common import bounded_broadcast, text_batches, written

#: SQL can't express the stages (learned models, XXH64, sampling): they are tested against brute-force versions.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of all columns, and its name: it tells rows apart where ids are null or repeated; equal rows share it."""
    values = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]  # a null alone leaves a hash as it is
    key = _free(docs, "_key")
    return docs.withColumn(key, F.xxhash64(*values)), key


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text reaches the rejection threshold go; null and empty texts stay. Each row is decided by itself, so equal
    rows stay or go together; texts of any length are read whole."""
    text_batches(spark)
    s, severity, toxic = ordinal.Settings(), _free(docs, "_severity"), _free(docs, "_p_toxic")
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), s)
    return ordinal.score(docs, model, severity_col=severity, toxic_col=toxic).filter(F.col(toxic) < s.reject_at).select(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of documents that share 0.8 of their five-word shingles: that with the smallest id
    (null ids last), of these that with the smallest hash.

    Rows are told apart by a hash of all their columns, not by id, so rows with equal or null ids are decided singly."""
    text_batches(spark)
    keyed, key = _keyed(docs)
    found = written(simhash.similar(keyed, key), "near-duplicates")
    grouped = found.groupBy("key").agg(F.min("group").alias("group"), F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    sizes = written(grouped.groupBy("group").agg(F.sum("n").alias("size")).filter("size > 1"), "near-duplicate-groups")
    members = written(grouped.join(bounded_broadcast(sizes, 16), "group").select("key", "group", "n"), "near-duplicate-rows")
    ranked = keyed.select(F.col(key).alias("key"), "doc_id").join(bounded_broadcast(members, 32), "key").groupBy("group").agg(F.min(rank).alias("least"))
    first = written(ranked.select(F.col("least.key").alias("key")), "near-duplicate-firsts")
    repeated = written(members.filter("n > 1").join(first, "key", "left_semi").select("key"), "near-duplicate-repeats")
    gone = written(members.select("key").join(first, "key", "left_anti").union(repeated), "near-duplicate-keys")
    single = keyed.join(bounded_broadcast(gone.withColumnRenamed("key", key), 16), key, "left_anti")
    one_of_equal = keyed.join(bounded_broadcast(repeated.withColumnRenamed("key", key), 16), key, "left_semi").dropDuplicates([key])
    return single.select(_columns(docs)).union(one_of_equal.select(_columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their ids; null and empty texts stay."""
    text_batches(spark)
    keyed, key = _keyed(docs)
    found = written(decontam.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key), "leaks")
    gone = written(found.select(F.col("doc_id").alias(key)).distinct(), "leaking-rows")
    return keyed.join(bounded_broadcast(gone, 16), key, "left_anti").select(_columns(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, equal rows too; secrets in its text are replaced by a mark, and n_chars follows. A null text stays
    null. Time is in proportion to a text's length and number of secrets."""
    spans = _free(docs, "_spans")
    found = secrets.scan(docs, out_col=spans).withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    return found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_columns(docs))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's sampled segmentations, equal rows' too; null and empty texts have the empty one. Whole texts are encoded."""
    text_batches(spark)
    return pieces.encode(docs)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("sentence-pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
