"""Product pages to SKU rows.

A page is parsed once into page-level columns; everything that can make a page
fail is decided there, in arrays over its variants, so a bad variant drops the
whole page without any shuffle. Only then are the variants exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import fields
from skuloom.functions import loose_json as lj
from skuloom.functions.kept import kept
from skuloom.functions.prices import nested_prices, scalar_price
from skuloom.functions.text import (
    blank_to_null,
    labelled_specs,
    pack_size,
    squeeze,
    with_plain_text,
)
from skuloom.operators.prefilter import possible_keys
from skuloom.schemas import PRODUCT_COLUMNS

# fields that have to be text when they are given
_VARIANT_TEXT = ("name", "manufacturer_name")
_VARIANTS_TYPE = (
    "array<struct<ordinal:int,value:variant,description:variant,stock:variant,asked:variant>>"
)


def attach_pages(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Left join on URL; a listing without a page keeps null ``html``.

    ``pages`` holds one document per URL (see ``latest_pages``).
    """
    return listings.join(
        pages.select(F.col("url").alias("product_url"), "html"), "product_url", "left"
    )


def listings_of(families: DataFrame) -> DataFrame:
    """``product_url, listings``: the listings of every URL as one array in the order of ``attempt``.

    A URL has at most one listing per category.
    """

    def by_attempt(a: Column, b: Column) -> Column:
        first, second = a["attempt"], b["attempt"]
        return F.when(first < second, -1).when(first > second, 1).otherwise(0)

    fields_ = [c for c in families.columns if c != "product_url"]
    return families.groupBy("product_url").agg(
        F.array_sort(F.collect_list(F.struct(*fields_)), by_attempt).alias("listings")
    )


def attach_listings(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """``product_url, html, listings``: one row per URL with listings, ``html`` null without a page.

    Listings of URLs that have a page are joined to the page, so that few listings can be broadcast
    and the documents stay in place; those without need the pages' URLs only. Where the listings are too
    many for that, pages that nobody asks for are dropped by a bitmap before the shuffle, and a
    bucketed page table (``sources.page_table``) is not shuffled at all.

    ``pages`` holds one document per URL (see ``latest_pages``).
    """
    asked = pages.select(F.col("url").alias("product_url"), "html").transform(
        possible_keys, "product_url", listed.select("product_url")
    )
    there = asked.join(listed, "product_url")
    missing = listed.join(pages.select(F.col("url").alias("product_url")), "product_url", "left_anti")
    return there.unionByName(missing.withColumn("html", F.lit(None).cast("string")))


def latest_pages(pages: DataFrame, *order: Column) -> DataFrame:
    """The last document of every URL; repeats are reduced before the shuffle."""
    return (
        pages.groupBy("url")
        .agg(F.max_by(F.struct("html"), F.struct(*order)).alias("last"))
        .select("url", "last.html")
    )


def _chosen(entry: Column) -> Column:
    """A variant with its fallbacks resolved."""
    value = entry["value"]

    def first(*names: str) -> Column:
        return lj.first_truthy(*[lj.field(value, name) for name in names])

    return F.struct(
        entry["ordinal"].alias("ordinal"),
        value.alias("value"),
        first("description", "short_description").alias("description"),
        first("stock_availability_label", "stock_availability").alias("stock"),
        first("product_price", "price").alias("asked"),
    )


@kept
def _read_columns() -> dict[str, Column]:
    return {
        "records": lj.ld_records(F.col("html")),
        "map_text": lj.variant_map_text(F.col("html")),
        "gallery": lj.initial_images(F.col("html")),
        "no_page": F.col("html").isNull(),
    }


@kept
def _parsed_columns() -> dict[str, Column]:
    return {
        "ld": lj.ld_of_type(F.col("records"), fv.LD_PRODUCT),
        "crumbs": lj.ld_of_type(F.col("records"), fv.LD_BREADCRUMB),
        "bad_map": F.col("map_text").isNotNull() & lj.parse_whole(F.col("map_text")).isNull(),
        "variants": F.coalesce(
            F.transform(lj.variant_entries(F.col("map_text")), _chosen),
            F.array().cast(_VARIANTS_TYPE),
        ),
    }


def _parse(df: DataFrame) -> DataFrame:
    """Everything read from the document itself; the document is dropped."""
    return df.withColumns(_read_columns()).drop("html").withColumns(_parsed_columns()).drop("records", "map_text")


@kept
def _page_columns() -> dict[str, Column]:
    ld = F.col("ld")
    offers = lj.field(ld, "offers")
    return {
        "offer": F.when(lj.kind(offers) == "OBJECT", offers),
        "bad_crumbs": fields.bad_breadcrumb(F.col("crumbs")),
        "ld_sku": fields.identifier(lj.field(ld, "sku")),
        "texts": F.concat(
            F.array(lj.text(lj.field(ld, "description"))),
            F.transform("variants", lambda v: lj.text(v["description"])),
        ),
    }


def _page_values(df: DataFrame) -> DataFrame:
    """Values of the page that no listing decides."""
    return df.withColumns(_page_columns())


@kept
def _family_columns() -> dict[str, Column]:
    hit = F.col("hit")
    return {
        "page_images": fields.page_images(
            lj.field(F.col("ld"), "image"), F.col("gallery"), hit["image_url"]
        ),
        "hierarchy": fields.category_hierarchy(F.col("crumbs"), F.col("category_path")),
        "hit_sku": fields.first_sku(hit["sku"]),
    }


def _family_values(df: DataFrame) -> DataFrame:
    """Values of the page with the listing that is used (the last one if all fail), once per page."""
    used = F.get("listings", F.coalesce(F.col("chosen"), F.size("listings") - 1))
    return (
        df.withColumns({"hit": used["hit"], "category_path": used["category_path"]})
        .withColumns(_family_columns())
        .drop("gallery", "crumbs", "category_path")
    )


def _asked(df: DataFrame) -> DataFrame:
    """``asked``: what is given as the price of each variant, or, for a page without variants, of each listing."""
    parents = F.transform(
        "listings",
        lambda x: lj.first_truthy(
            lj.field(F.col("offer"), "price"), lj.field(F.col("offer"), "lowPrice"), x["hit"]["price"]
        ),
    )
    own = F.transform("variants", lambda v: v["asked"])
    return df.withColumn("asked", F.when(F.size("variants") > 0, own).otherwise(parents))


def _plain_text(df: DataFrame) -> DataFrame:
    """The texts and the nested prices: what takes Python, side by side in one worker per task."""
    return with_plain_text(df, "texts", "decoded", "plain", nested=nested_prices(F.col("asked"))).drop("texts")


def _with_prices(df: DataFrame) -> DataFrame:
    """``prices``: one per variant, or, for a page without variants, one per listing."""
    return df.withColumn(
        "prices",
        F.transform(
            "asked",
            lambda value, i: F.coalesce(F.get(F.col("nested"), i), scalar_price(value)),
        ),
    ).drop("asked", "nested")


@kept
def _error_columns() -> list[dict[str, Column]]:
    bad = F.transform("prices", lambda p: p["bad"])
    any_bad = F.get(F.filter(bad, lambda b: b.isNotNull()), F.lit(0))
    has_variants = F.size("variants") > 0
    not_object = F.exists(
        "variants", lambda v: F.coalesce(lj.kind(v["value"]) != "OBJECT", F.lit(True))
    )
    variant_not_text = F.exists(
        "variants",
        lambda v: _any_not_text(
            *[lj.field(v["value"], name) for name in _VARIANT_TEXT], v["description"], v["stock"]
        ),
    )
    # the page's name is only looked at where a variant has none
    needs_name = (F.size("variants") == 0) | F.exists(
        "variants", lambda v: ~lj.truthy(lj.field(v["value"], "name"))
    )
    ld_not_text = lj.truthy_but_not_text(lj.field(F.col("ld"), "description")) | (
        needs_name & lj.truthy_but_not_text(lj.field(F.col("ld"), "name"))
    )
    # a page's brand is only looked at where a variant names no maker
    maker = lambda v: lj.field(v["value"], "manufacturer_name")
    needs_brand = (F.size("variants") == 0) | F.exists("variants", lambda v: ~lj.truthy(maker(v)))
    ld_brand = lj.field(F.col("ld"), "brand")
    named = F.when(lj.kind(ld_brand) == "OBJECT", lj.field(ld_brand, "name")).otherwise(ld_brand)
    brand_not_text = F.exists("variants", lambda v: lj.truthy_but_not_text(maker(v))) | (
        needs_brand & lj.truthy_but_not_text(named)
    )
    of_page = (
        F.when(F.col("no_page"), F.lit("no document for this URL"))
        .when(F.col("bad_map"), F.lit("variant map is not valid JSON"))
        .when(not_object, F.lit("variant is not an object"))
        .when(variant_not_text | ld_not_text, F.lit("text field holds another type"))
        .when(F.col("bad_crumbs") | brand_not_text, F.lit("brand or breadcrumb name is not text"))
    )

    def error(_, i):
        bad_price = F.when(has_variants, any_bad).otherwise(F.get(bad, i))
        return F.coalesce(F.col("of_page"), F.concat(F.lit("price is not a number: "), bad_price))

    places = F.sequence(F.lit(0), F.size("listings") - 1)
    return [
        {"of_page": of_page},
        {"errors": F.transform("listings", error)},
        {"chosen": F.get(F.filter(places, lambda i: F.get("errors", i).isNull()), F.lit(0))},
    ]


def _choice(df: DataFrame) -> DataFrame:
    """``errors``: why the page yields no rows with each listing (null for a good one), and
    ``chosen``: the first listing without an error; null if there is none.

    Only the price of a page without variants depends on the listing.
    """
    for columns in _error_columns():
        df = df.withColumns(columns)
    return df.drop("no_page", "bad_map", "bad_crumbs", "of_page")


def _any_not_text(*values: Column) -> Column:
    result = F.lit(False)
    for value in values:
        result = result | lj.truthy_but_not_text(value)
    return result


@kept
def _items() -> Column:
    nothing = F.lit(None)
    n_failed = F.coalesce(F.col("chosen"), F.size("listings"))

    def item(at, error, ordinal, variant, stock, text, price):
        return F.struct(
            at.cast("int").alias("at"),
            error.cast("string").alias("page_error"),
            ordinal.alias("ordinal"),
            variant.cast("variant").alias("variant"),
            stock.cast("variant").alias("own_stock"),
            text.cast("string").alias("own_text"),
            price.cast("double").alias("price"),
        )

    failed = F.transform(
        F.slice("errors", F.lit(1), n_failed),
        lambda e, i: item(i, e, F.lit(0), nothing, nothing, nothing, nothing),
    )
    variants = F.transform(
        "variants",
        lambda v, i: item(
            F.col("chosen"), nothing, v["ordinal"], v["value"], v["stock"],
            F.get("plain", i + 1), F.get("prices", i)["amount"],
        ),
    )
    page = F.array(
        item(
            F.col("chosen"), nothing, F.lit(0), nothing, nothing, nothing,
            F.get("prices", F.col("chosen"))["amount"],
        )
    )
    good = F.when(F.col("chosen").isNull(), F.slice(page, 1, 0)).otherwise(
        F.when(F.size("variants") > 0, variants).otherwise(page)
    )
    return F.concat(failed, good)


def _explode(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per listing that failed, then one per variant of the page with the listing that
    did not, or one for the page if it has no variants."""
    # The array is never empty; the outer form keeps the optimizer from adding
    # an emptiness filter that would evaluate the parsing again.
    return (
        df.withColumn("item", F.explode_outer(_items()))
        .withColumns(
            {
                "page_text": F.get("plain", F.lit(0)),
                "spec_text": F.get("decoded", F.lit(0)),
                **{name: F.get("listings", F.col("item.at"))[name] for name in keep},
            }
        )
        .drop("variants", "prices", "plain", "decoded", "errors", "chosen", "listings")
        .select("*", "item.*")
        .drop("item", "at")
    )


@kept
def _product_columns(source: str) -> list[Column]:
    """Column rules of variant rows and of page rows."""
    v, ld, hit = F.col("variant"), F.col("ld"), F.col("hit")
    is_variant = v.isNotNull()

    def either(for_variant: Column, for_page: Column) -> Column:
        return F.when(is_variant, for_variant).otherwise(for_page)

    page_sku = F.coalesce("ld_sku", "hit_sku")
    ld_name = lj.text(lj.field(ld, "name"))
    offer_stock = lj.field(F.col("offer"), "availability")
    stock = F.coalesce(
        F.when(lj.truthy(offer_stock), lj.as_text(offer_stock)),
        blank_to_null(hit["stock_status_label"]),
        blank_to_null(hit["stock_availability"]),
    )
    size = pack_size(either(F.col("own_text"), F.col("page_text")))
    hazard = lj.field(v, "hazard_type")
    specs = F.map_concat(
        labelled_specs(F.col("spec_text")),
        _entry("variant", F.col("own_text")),
        _entry("hazard_type", F.when(lj.truthy(hazard), lj.as_text(hazard))),
    )
    own_images = F.array(lj.text(lj.field(v, "main_image")), lj.text(lj.field(v, "image")))
    values = {
        "source": F.lit(source),
        "source_product_id": either(
            fields.identifier(lj.field(v, "id")), blank_to_null(squeeze(hit["objectID"]))
        ),
        "parent_sku": F.when(is_variant, page_sku),
        "sku": F.coalesce(either(fields.identifier(lj.field(v, "sku")), page_sku), F.lit("")),
        "product_name": squeeze(
            F.coalesce(
                blank_to_null(lj.text(lj.field(v, "name"))),
                blank_to_null(ld_name),
                F.when(~is_variant, hit["name"]),
            )
        ),
        "brand": fields.brand(
            lj.field(ld, "brand"), hit["manufacturer_name"], lj.field(v, "manufacturer_name")
        ),
        "manufacturer_part_number": either(
            fields.identifier(lj.field(v, "manufacturer_part_number")),
            blank_to_null(squeeze(hit["manufacturer_part_number"])),
        ),
        "category_hierarchy": F.col("hierarchy"),
        "product_url": F.col("product_url"),
        "price": F.col("price"),
        "currency": fields.currency(F.col("offer"), hit["price"]),
        "unit_pack_size": size,
        "availability": either(
            blank_to_null(squeeze(lj.text(F.col("own_stock")))), fields.availability(stock)
        ),
        "description": F.col("page_text"),
        "unit_pack_size_source": F.when(size.isNotNull(), F.lit(fv.PACK_SOURCE_RULE)),
        "normalized_tags": F.array().cast("array<string>"),
        "specifications": specs,
        "pack_size_evidence": F.lit(None).cast("string"),
        "pack_size_confidence": F.lit(None).cast("double"),
        "image_urls": either(
            fields.image_list(own_images, F.col("page_images")), F.col("page_images")
        ),
        "scraped_at": F.col("scraped_at"),
    }
    return [values[name].alias(name) for name in PRODUCT_COLUMNS]


def _project(df: DataFrame, source: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, "page_error", "ordinal", *_product_columns(source))


def _entry(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.create_map(F.lit(key), value)).otherwise(
        F.create_map().cast("map<string,string>")
    )


def extract_products(
    paired: DataFrame,
    *,
    source: str = "catalog",
    scraped_at: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """SKU rows of paired listings and pages.

    ``paired`` has ``product_url``, ``html``, the listing struct ``hit`` and its
    ``category_path``. The result has the product columns plus ``ordinal`` (the
    place on the page) and ``page_error``: a failed page is one row with the
    reason, split off with ``good_rows`` and ``page_failures``. The input columns
    named in ``keep`` are passed through.
    """
    only = F.array(F.struct(*keep, "hit", "category_path")).alias("listings")
    return extract_listed(
        paired.select("product_url", "html", only), source=source, scraped_at=scraped_at, keep=keep
    )


def extract_listed(
    pages: DataFrame,
    *,
    source: str = "catalog",
    scraped_at: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """SKU rows of pages with all their listings, tried in turn.

    ``pages`` has ``product_url``, ``html`` and ``listings``: an array of structs with ``hit``,
    ``category_path`` and the fields in ``keep``, in the order in which they are tried, with one at least. A page
    is parsed once, whatever the number of its listings; the first one that raises no error
    gives the rows, and each one before it a row with its ``page_error``.
    """
    stamp = F.current_timestamp() if scraped_at is None else F.lit(scraped_at)
    return (
        pages.select("product_url", "html", "listings", stamp.cast("timestamp").alias("scraped_at"))
        .transform(_parse)
        .transform(_page_values)
        .transform(_asked)
        .transform(_plain_text)
        .transform(_with_prices)
        .transform(_choice)
        .transform(_family_values)
        .transform(_explode, keep)
        .transform(_project, source, keep)
    )


def good_rows(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("page_error").isNull()).drop("page_error")


def page_failures(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("page_error").isNotNull()).select(
        F.col("product_url").alias("url"),
        F.lit(fv.STAGE_EXTRACTION).alias("stage"),
        F.col("page_error").alias("error"),
    )
