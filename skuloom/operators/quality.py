"""Data-quality metrics of a product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.functions import loose_json as lj
from skuloom.session import materialize


def products_per_family(products: DataFrame, *keys: str) -> DataFrame:
    """Products of every family, per key group."""
    return products.groupBy(*keys, "product_url").agg(F.count("*").alias("products"))


def _present(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind in ("array", "map"):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(F.col(name) != "", F.lit(False))
    return F.col(name).isNotNull()


def field_coverage(products: DataFrame, *keys: str, fields: list[str] | None = None) -> DataFrame:
    """Share of rows with a value (``coverage``) and without (``missing_rate``) per
    field and key group: one aggregation, then one row per field."""
    names = fields or [c for c in products.columns if c not in keys]
    wide = products.groupBy(*keys).agg(
        *[F.avg(_present(products, n).cast("double")).alias(n) for n in names]
    )
    return wide.unpivot(list(keys), names, "field", "coverage").withColumn(
        "missing_rate", 1 - F.col("coverage")
    )


def duplicate_sku_rate(products: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of their SKU, as a share of all rows, per key group."""
    return (
        products.groupBy(*keys, "sku")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("products"),
            F.count("*").alias("skus"),
            ((F.sum("n") - F.count("*")) / F.sum("n")).alias("duplicate_rate"),
        )
    )


QUARTERS = (0.25, 0.5, 0.75)
# ranges that the prices of a range are cut into, and how exactly their borders are chosen
RANGES, ACCURACY = 64, 10_000
# distinct prices that one task may sort
RANGE_PRICES = 200_000


def price_distribution(products: DataFrame, *keys: str) -> DataFrame:
    """Number, least, greatest and exact quartiles of the prices per key group.

    A quartile is the price at rank ceil(share * n). Distinct prices are counted first. While a
    range of them is too large for one task, it is cut at borders chosen from its own prices (so
    far-off prices do no harm), the counts of the parts are summed up, and only the parts that
    hold a wanted rank stay. What stays at last is ranked price by price.
    """
    group = (F.struct(*keys) if keys else F.lit(0)).alias("g")
    priced = products.filter(F.col("price").isNotNull()).select(group, F.col("price").cast("double").alias("price"))
    counts = priced.groupBy("g", "price").agg(F.count("*").alias("n"))
    # part: the range a price is in; before: prices of the group below it; priced: all of the group
    open_ = materialize(
        counts.withColumns({"part": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "priced": F.lit(None).cast("long")}),
        "price-counts",
    )
    whole = Window.partitionBy("g", "part")

    def holds_rank(n: Column) -> Column:
        ranks = F.array(*[F.ceil(F.col("priced") * F.lit(q)) for q in QUARTERS])
        return F.exists(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + n))

    while True:
        shares = [i / RANGES for i in range(1, RANGES)]
        ranges = open_.groupBy("g", "part").agg(
            F.percentile_approx("price", shares, ACCURACY).alias("borders"), F.count("*").alias("size")
        )
        ranges = materialize(ranges, "price-ranges")
        if (ranges.agg(F.max("size")).first()[0] or 0) <= RANGE_PRICES:
            break
        place = F.size(F.filter("borders", lambda b: b < F.col("price")))
        cut = open_.join(ranges.drop("size"), ["g", "part"]).withColumn("sub", place).drop("borders")
        parts = cut.groupBy("g", "part", "sub").agg(
            F.sum("n").alias("m"), F.max("before").alias("start"), F.max("priced").alias("known")
        )
        earlier = whole.orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        kept = parts.select(
            "g", "part", "sub", "m",
            (F.col("start") + F.coalesce(F.sum("m").over(earlier), F.lit(0))).alias("before"),
            # at first there is one range only, so its sum is that of the group
            F.coalesce("known", F.sum("m").over(whole)).alias("priced"),
        ).filter(holds_rank(F.col("m")))
        next_ = cut.select("g", "part", "sub", "price", "n").join(kept.drop("m"), ["g", "part", "sub"])
        part = (F.col("part") * RANGES + F.col("sub")).alias("part")
        open_ = materialize(next_.select("g", "price", "n", part, "before", "priced"), "price-counts")
    ranked = open_.withColumns(
        {
            "upto": F.col("before") + F.sum("n").over(whole.orderBy("price").rowsBetween(Window.unboundedPreceding, 0)),
            "priced": F.coalesce("priced", F.sum("n").over(whole)),
        }
    )
    quartiles = ranked.groupBy("g").agg(
        F.array(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("priced") * F.lit(q)), F.col("price"))) for q in QUARTERS]).alias("quartiles")
    )
    # a union, so that also without keys nothing is joined with a single row
    groups = products.select(group, "price").groupBy("g").agg(
        F.count("price").alias("priced"), F.min("price").alias("least"), F.max("price").alias("greatest")
    )
    both = groups.withColumn("quartiles", F.lit(None).cast("array<double>")).unionByName(quartiles, allowMissingColumns=True)
    names = ("priced", "least", "quartiles", "greatest")
    found = both.groupBy("g").agg(*[F.max(n).alias(n) for n in names])
    return found.select(*[F.col(f"g.{k}").alias(k) for k in keys], *names)


def availability_distribution(products: DataFrame, *keys: str) -> DataFrame:
    """Products of every availability, per key group."""
    return products.groupBy(*keys, "availability").agg(F.count("*").alias("products"))


def count_change(current: DataFrame, previous: DataFrame, *keys: str) -> DataFrame:
    """Rows per key group in two runs, and the difference."""
    sides = [
        df.groupBy(*keys).agg(F.count("*").alias(name))
        for df, name in ((current, "current_rows"), (previous, "previous_rows"))
    ]
    return (
        sides[0]
        .join(sides[1], list(keys), "full")
        .fillna(0, ["current_rows", "previous_rows"])
        .withColumn("change", F.col("current_rows") - F.col("previous_rows"))
    )


def json_parse_quality(texts: DataFrame, column: str, *keys: str) -> DataFrame:
    """Parse-failure rate of embedded JSON and the number of distinct key sets."""
    parsed = lj.parse_whole(F.col(column))
    fingerprint = F.when(
        lj.kind(parsed) == "OBJECT", F.xxhash64(F.array_sort(F.json_object_keys(column)))
    )
    return (
        texts.select(*keys, parsed.isNull().cast("double").alias("failed"), fingerprint.alias("shape"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("documents"),
            F.avg("failed").alias("failure_rate"),
            F.count_distinct("shape").alias("key_sets"),
        )
    )
