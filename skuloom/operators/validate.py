"""Required fields and first-valid-row-per-SKU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions.fields import squeeze_ends
from skuloom.functions.text import squeeze


def missing_fields() -> Column:
    """Names of the required fields that are blank, in their fixed order."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name))
                for name in fv.REQUIRED_FIELDS
            ]
        )
    )


def check_required(rows: DataFrame) -> DataFrame:
    """Normalise the required fields; add ``missing`` and the untouched URL ``page``."""
    return rows.withColumns(
        {
            "page": F.col("product_url"),
            "sku": squeeze(F.col("sku")),
            "product_name": squeeze(F.col("product_name")),
            "product_url": squeeze_ends(F.coalesce("product_url", F.lit(""))),
        }
    ).withColumn("missing", missing_fields())


def accepted(checked: DataFrame) -> DataFrame:
    """Complete rows, one per SKU and page: the first valid one.

    Rows that come from a join on the URL are already placed for this window, so
    they are not shuffled again; others are cut to rank one before the shuffle.
    """
    first = Window.partitionBy("page", "sku").orderBy("ordinal")
    return (
        checked.filter(F.size("missing") == 0)
        .withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") == 1)
        .drop("__rank", "missing", "page")
    )


def rejected(checked: DataFrame) -> DataFrame:
    """Failure rows of incomplete products."""
    shown = F.coalesce(F.nullif(F.col("product_url"), F.lit("")), F.lit(fv.UNKNOWN_URL))
    return checked.filter(F.size("missing") > 0).select(
        F.col("product_url").alias("url"),
        F.lit(fv.STAGE_VALIDATION).alias("stage"),
        F.concat(shown, F.lit(": missing "), F.array_join("missing", ", ")).alias("error"),
    )
