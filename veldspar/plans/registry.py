"""Registration of queries, and how their tables are bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB twin."""

    def mark(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return mark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Doubles (or the named columns) rounded, so that summing in another order doesn't show."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as die-level measurements."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lot"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("eqp"), F.col("l_returnflag").alias("chamber"), F.col("l_linestatus").alias("recipe"),
        F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
        F.round(F.col("l_discount") * 100).cast("int").alias("bin"), (F.col("l_partkey") % 32).cast("int").alias("die_x"), F.col("l_quantity").cast("int").alias("die_y"),
        (F.col("l_suppkey") * 100 + F.month("l_shipdate")).cast("long").alias("wlot"),
    )


#: The same as a DuckDB common table expression m.
M = """m AS (SELECT l_orderkey AS lot, l_linenumber AS step, l_suppkey AS eqp, l_returnflag AS chamber, l_linestatus AS recipe, l_partkey AS part, l_shipdate AS ts, l_extendedprice AS price,
 l_quantity AS qty, l_discount AS disc, round(l_discount * 100)::INT AS bin, (l_partkey % 32)::INT AS die_x, l_quantity::INT AS die_y, (l_suppkey * 100 + month(l_shipdate))::BIGINT AS wlot FROM lineitem)"""
