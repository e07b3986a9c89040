"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

__all__ = ["items", "monthly_revenue", "table"]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), body, source, category (language), day."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        "source",
        F.col("lang").alias("category"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"),
    )


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of exact monthly order totals per priority: series, period, value (decimal)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    )
