"""The registered queries of this subpackage: opN_<name> each over its whole table, and pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import aligned, arcwarc, bitslice, bradleyterry, chatgrammar, decontam, hardneg, linehash, ordinal, pieces, secrets, simhash, sitetree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return bitslice.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = _table(spark, sf_dir, "documents").select("doc_id", "text"), ordinal.Settings()
    scored = ordinal.score(docs, ordinal.fit(docs, _table(spark, sf_dir, "labels"), s))
    return scored.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= s.reject_at).cast("int").alias("toxic"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chatgrammar.CONFLICT).alias("text"))
    return chatgrammar.digest(conversations.union(conflict))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcwarc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bradleyterry.score(docs, bradleyterry.fit(docs, _table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(vectors, vectors.filter("vec_id % 100 = 0"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linehash.digest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned.digest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_topk": op1_topk, "op2_decontamination": op2_decontamination, "op3_html": op3_html, "op4_toxicity": op4_toxicity, "op5_chat": op5_chat, "op6_warc": op6_warc, "op7_secrets": op7_secrets, "op8_simhash": op8_simhash, "op9_sentencepiece": op9_sentencepiece, "op10_quality": op10_quality, "op11_hard_negatives": op11_hard_negatives, "op12_line_dedup": op12_line_dedup, "op13_alignment": op13_alignment, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": bitslice.oracle(), "op5_chat": chatgrammar.oracle(), "op6_warc": arcwarc.oracle(), "op7_secrets": secrets.oracle(), "op11_hard_negatives": hardneg.oracle(), "op12_line_dedup": linehash.oracle()}
