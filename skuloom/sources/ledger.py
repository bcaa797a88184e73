"""Metrics of all runs, by run, category and parser version, for comparison with earlier runs.

Each run appends its rows as one batch, under a number that no fresh start resets. A category is
the last level of a product's hierarchy; rows of the whole run have neither category nor version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import quality as qu
from skuloom.sources import state

KEYS = ("category", "parser_version")
COVERED = ("brand", "manufacturer_part_number", "unit_pack_size", "description", "specifications", "image_urls")


def _root(root: str) -> str:
    return f"{root}/ledger"


def _rows(df: DataFrame, metric: Column, value: Column) -> DataFrame:
    keys = [F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in KEYS]
    return df.select(metric.alias("metric"), *keys, value.cast("double").alias("value"))


def product_metrics(products: DataFrame) -> DataFrame:
    """metric, category, parser_version, value of a product table with ``parser_version``.

    products, families, duplicate_sku_rate, price_least to price_greatest, missing_rate:field,
    availability:value. A product without a hierarchy is in the null category.
    """
    rows = products.withColumn("category", F.try_element_at("category_hierarchy", F.lit(-1)))
    counted = qu.products_per_family(rows, *KEYS).groupBy(*KEYS).agg(
        F.sum("products").alias("products"), F.count("*").alias("families")
    )
    rates = qu.duplicate_sku_rate(rows, *KEYS)
    prices = qu.price_distribution(rows, *KEYS)
    missing = qu.field_coverage(rows, *KEYS, fields=list(COVERED))
    available = qu.availability_distribution(rows, *KEYS)
    named = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(F.col(c), F.lit("")))
    parts = [_rows(counted, F.lit(n), F.col(n)) for n in ("products", "families")]
    parts.append(_rows(rates, F.lit("duplicate_sku_rate"), F.col("duplicate_rate")))
    places = {"least": F.col("least"), "greatest": F.col("greatest")} | {
        name: F.get("quartiles", F.lit(i)) for i, name in enumerate(("lower", "middle", "upper"))
    }
    steps = F.array(*[F.struct(F.lit(f"price_{n}").alias("metric"), c.alias("value")) for n, c in places.items()])
    parts.append(_rows(prices.select(*KEYS, F.inline(steps)).where("value is not null"), F.col("metric"), F.col("value")))
    parts.append(_rows(missing, named("missing_rate:", "field"), F.col("missing_rate")))
    parts.append(_rows(available, named("availability:", "availability"), F.col("products")))
    return reduce(DataFrame.unionByName, parts)


def run_metrics(summary: DataFrame, failures: DataFrame) -> DataFrame:
    """The counters of a run summary and the failures by stage, as metrics of the whole run."""
    counters = summary.unpivot([], summary.columns, "metric", "value")
    stages = failures.groupBy("stage").agg(F.count("*").alias("value"))
    return _rows(counters, F.col("metric"), F.col("value")).unionByName(
        _rows(stages, F.concat(F.lit("failures:"), F.col("stage")), F.col("value"))
    )


def record(spark: SparkSession, root: str, metrics: DataFrame) -> int:
    """Append the metrics of one run and return the run's number."""
    batch = state.begin_batch(spark, _root(root), state.RUN)
    state.append(metrics.withColumn("at", F.current_timestamp()), _root(root), "metrics", batch)
    return batch.number


def read(spark: SparkSession, root: str) -> DataFrame:
    """run, at, metric, category, parser_version, value of all runs."""
    rows = state.read(spark, _root(root), "metrics")
    return rows.select(F.col("batch_id").alias("run"), "at", "metric", *KEYS, "value")


def runs(spark: SparkSession, root: str) -> list[int]:
    return state.batch_numbers(spark, _root(root), "metrics")


def as_of(spark: SparkSession, root: str, run: int | None = None) -> DataFrame:
    """Metrics of the last run up to ``run``, the last of all if it is None; none if there is none."""
    known = [n for n in runs(spark, root) if run is None or n <= run]
    return read(spark, root).where(F.col("run") == F.lit(known[-1] if known else None))


def change(spark: SparkSession, root: str, metric: str = "products", run: int | None = None) -> DataFrame:
    """category, parser_version, current_value, previous_value, change of a metric: the last run up to
    ``run`` against the run before it. A group that one of them lacks counts as 0 there; without an
    earlier run all previous values are 0."""
    known = [n for n in runs(spark, root) if run is None or n <= run]
    current, previous = [F.lit(known[-i] if len(known) >= i else None) for i in (1, 2)]
    rows = read(spark, root).where((F.col("metric") == metric) & (F.col("run").eqNullSafe(current) | F.col("run").eqNullSafe(previous)))
    value = lambda which: F.coalesce(F.sum(F.when(F.col("run") == which, F.col("value"))), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(
        value(current).alias("current_value"), value(previous).alias("previous_value"),
        (value(current) - value(previous)).alias("change"),
    )
