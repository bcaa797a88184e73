"""Search responses to one listing per product family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import loose_json as lj
from skuloom.functions.text import blank_to_null

PAGES_PER_BLOCK = 1_000


def category_configs(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Search configuration of every seed, with ``error`` where there is none.

    ``seeds`` has ``url`` and ``category_ord``; ``pages`` has ``url``, ``html``.
    """
    joined = seeds.join(pages.select("url", "html"), "url", "left")
    raw = joined.withColumn("raw", lj.assigned_value(F.col("html"), fv.CATEGORY_MARKER))
    request = lj.field(F.col("raw"), "request")
    path = lj.field(request, "path")
    level = F.try_variant_get(lj.field(request, "level"), "$", "int")
    live = lj.truthy(lj.field(F.col("raw"), "isCategoryPage")) & lj.truthy(path)
    return raw.select(
        F.col("url").alias("category_url"),
        "category_ord",
        lj.as_text(path).alias("category_path"),
        level.alias("category_level"),
        lj.as_text(lj.field(request, "categoryId")).alias("category_id"),
        F.when(F.col("html").isNull(), F.lit("no document for this URL"))
        .when(F.instr("html", fv.CATEGORY_MARKER) == 0, F.lit("no search configuration on the page"))
        .when(F.col("raw").isNull(), F.lit("search configuration is not valid JSON"))
        .when(~live, F.concat(F.lit("not a live category page: "), "url"))
        .when(level.isNull(), F.lit("category level is not a number"))
        .alias("error"),
    )


def usable_configs(configs: DataFrame) -> DataFrame:
    return configs.filter(F.col("error").isNull()).drop("error")


def discovery_failures(configs: DataFrame) -> DataFrame:
    return configs.filter(F.col("error").isNotNull()).select(
        F.col("category_url").alias("url"), F.lit(fv.STAGE_DISCOVERY).alias("stage"), "error"
    )


def _stops(responses: DataFrame) -> DataFrame:
    """(category_url, stop): the first result page that is not read, from narrow columns only;
    one row per category, with partial sums."""
    narrow = responses.select(
        "category_url", "page_no", "nbPages", F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits")
    )
    stop = F.when(F.col("n_hits") < 1, F.col("page_no")).when(
        F.col("page_no") + 1 >= F.coalesce("nbPages", F.lit(0)), F.col("page_no") + 1
    )
    return narrow.groupBy("category_url").agg(F.min(stop).alias("stop"))


def pages_in_bounds(responses: DataFrame) -> DataFrame:
    """Result pages up to the first empty, last announced or failed one.

    The stopping points are one small row per category, so Spark broadcasts them and the hits
    stay where they are; with very many categories both sides are shuffled.
    """
    stops = _stops(responses)
    return (
        responses.join(stops, "category_url")
        .filter(F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))
        .drop("stop")
    )


def traversal_failures(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """The first failed result page of every category, if it was reached.

    With a limit a category is left as soon as it gave that many families, so a page that
    fails after the page with the last of them was never asked for.
    """
    first = responses.groupBy("category_url").agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("page_no", "error"))).alias("failed"),
        F.min(
            F.when(
                F.col("error").isNull()
                & (
                    (F.coalesce(F.size("hits"), F.lit(0)) < 1)
                    | (F.col("page_no") + 1 >= F.coalesce("nbPages", F.lit(0)))
                ),
                F.col("page_no"),
            )
        ).alias("ended"),
    )
    failed = first.filter(
        F.col("failed").isNotNull()
        & (F.col("ended").isNull() | (F.col("failed.page_no") <= F.col("ended")))
    )
    if limit is not None:
        families = hits_of(pages_in_bounds(responses)).transform(with_family_url).transform(first_in_category)
        found = limit_per_category(families, limit).groupBy("category_url").agg(
            F.count("*").alias("families"), F.max("page_no").alias("last_page")
        )
        full = found.filter(F.col("families") >= limit).select("category_url", "last_page")
        failed = failed.join(full, "category_url", "left").filter(
            F.col("last_page").isNull() | (F.col("failed.page_no") <= F.col("last_page"))
        )
    return failed.select(
        F.col("category_url").alias("url"),
        F.lit(fv.STAGE_TRAVERSAL).alias("stage"),
        F.col("failed.error").alias("error"),
    )


def hits_of(responses: DataFrame) -> DataFrame:
    """One row per hit with its place: ``category_url, page_no, pos, hit``."""
    return responses.select("category_url", "page_no", F.posexplode("hits").alias("pos", "hit"))


def family_url(hit: Column) -> Column:
    return F.coalesce(blank_to_null(hit["family_url"]), blank_to_null(hit["url"]))


def with_family_url(hits: DataFrame) -> DataFrame:
    """Add ``product_url``; hits without one are dropped."""
    return hits.withColumn("product_url", family_url(F.col("hit"))).filter(
        F.col("product_url").isNotNull()
    )


def in_category(hits: DataFrame, level_columns: dict[int, str]) -> Column:
    """Facet predicate over ``hits``: the hit's category at the configured level is the path, or, in
    a column of lists, one of the list is.

    Needs the columns ``category_level`` and ``category_path``. There is one branch per level, so
    that with a fixed level and path the comparison with a scalar column reaches the scan as a
    filter. Missing values and missing elements equal nothing.
    """
    level, path = F.col("category_level"), F.col("category_path")

    def holds(column: str) -> Column:
        if hits.schema[column].dataType.typeName() == "array":
            return F.coalesce(F.array_contains(F.col(column), path), F.lit(False))
        return F.col(column) == path

    branches = [(level == number) & holds(column) for number, column in level_columns.items()]
    return reduce(lambda a, b: a | b, branches, F.lit(False))


def attach_category(hits: DataFrame, configs: DataFrame) -> DataFrame:
    """Add the category's path, level and order to every hit."""
    return hits.join(configs, "category_url")


def first_in_category(hits: DataFrame) -> DataFrame:
    """First hit of every URL in every category.

    The rank-one limit also runs before the shuffle, so a URL with very many
    hits reaches its task as one row per map task.
    """
    order = Window.partitionBy("category_url", "product_url").orderBy("page_no", "pos")
    return _first(hits, order)


def limit_per_category(families: DataFrame, limit: int | None) -> DataFrame:
    """First ``limit`` families of every category, for any limit and category size.

    Families are counted per result page and the counts summed up along the
    pages; only pages that start below the limit are kept, and ranks are taken
    inside single pages, never over a whole category.
    """
    if limit is None:
        return families
    if limit < 1:
        raise ValueError("limit must be at least 1")
    counts = families.groupBy("category_url", "page_no").agg(F.count("*").alias("n"))
    # The running sum goes over blocks of pages first, so that no task has to
    # hold the pages of a whole category.
    counts = counts.withColumn("block", F.floor(F.col("page_no") / PAGES_PER_BLOCK))
    blocks = (
        counts.groupBy("category_url", "block")
        .agg(F.sum("n").alias("n"))
        .withColumn("before_block", _sum_before("n", ["category_url"], "block"))
        .filter(F.col("before_block") < limit)
        .drop("n")
    )
    before = (
        counts.join(blocks, ["category_url", "block"])
        .withColumn(
            "before",
            F.col("before_block") + _sum_before("n", ["category_url", "block"], "page_no"),
        )
        .filter(F.col("before") < limit)
        .drop("n", "block", "before_block")
    )
    within = Window.partitionBy("category_url", "page_no").orderBy("pos")
    return (
        families.join(before, ["category_url", "page_no"])
        .withColumn("rank", F.row_number().over(within))
        .filter(F.col("before") + F.col("rank") <= limit)
        .drop("before", "rank")
    )


def _sum_before(column: str, group: list[str], order: str) -> Column:
    window = Window.partitionBy(*group).orderBy(order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def ranked_across_categories(families: DataFrame) -> DataFrame:
    """Add ``attempt``: 1 for the listing of a URL that is used first.

    A group holds at most one row per category.
    """
    order = Window.partitionBy("product_url").orderBy("category_ord", "page_no", "pos")
    return families.withColumn("attempt", F.row_number().over(order))


def first_across_categories(families: DataFrame) -> DataFrame:
    order = Window.partitionBy("product_url").orderBy("category_ord", "page_no", "pos")
    return _first(families, order)


def not_completed(families: DataFrame, completed: DataFrame) -> DataFrame:
    """Families whose URL no earlier run has completed."""
    return families.join(
        completed.select(F.col("url").alias("product_url")), "product_url", "left_anti"
    )


def _first(df: DataFrame, order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == 1).drop("rank")
