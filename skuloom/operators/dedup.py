"""Latest-row and counting operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of every key. Reduced in the map tasks, so a key that holds
    most of the log arrives as one row per task."""
    return (
        rows.groupBy(F.col(key).alias("__key"))
        .agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("last"))
        .select("last.*")
    )


def run_summary(
    categories: DataFrame, attempted: DataFrame, exported: DataFrame, failures: DataFrame
) -> DataFrame:
    """One row of run counters; the inputs are only counted, never collected."""
    parts = {
        "categories_attempted": categories,
        "product_pages_attempted": attempted,
        "product_rows_exported": exported,
        "failures": failures,
    }
    counted = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("counter"), F.lit(1).alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    return counted.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in parts
        ]
    )
