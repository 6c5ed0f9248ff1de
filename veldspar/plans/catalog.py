"""Every registered query of the library, by name, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators import aggregates
from veldspar.plans import registry
from veldspar.plans import q_aggregates, q_evidence, q_explore, q_joins, q_lineage, q_pixels, q_process, q_scalars, q_streams, q_verdicts, q_windows  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each equipment's lots against all other lots: effect in deviations between lots, lots, and whether they suffice."""
    m = registry.measures(spark, sf_dir)
    lots = aggregates.lot_fold(m, ["eqp", "wlot"], "price")
    grand = lots.agg(F.avg("lot_mean").alias("grand"), F.stddev("lot_mean").alias("between"))
    by = lots.groupBy("eqp").agg(F.count("*").alias("lots"), F.avg("lot_mean").alias("mean")).join(F.broadcast(grand))
    out = by.select("eqp", "lots", "mean", ((F.col("mean") - F.col("grand")) / F.col("between")).alias("effect"), (F.col("lots") >= 5).alias("enough"))
    return registry.rounded(out, 6).orderBy(F.desc(F.abs("effect")), "eqp")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
