"""Fallback rules for single product fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import loose_json as lj
from skuloom.functions.text import blank_to_null, squeeze


def identifier(value: Column) -> Column:
    """Optional id or code of any JSON type as text; null, false and blank give null."""
    is_false = (lj.kind(value) == "BOOLEAN") & ~F.try_variant_get(value, "$", "boolean")
    return F.when(
        ~F.coalesce(is_false, F.lit(False)), blank_to_null(squeeze(lj.as_text(value)))
    )


def first_sku(value: Column) -> Column:
    """A hit's SKU, given as a scalar or as a list."""
    head = F.get(lj.elements(value), F.lit(0))
    return F.when(lj.kind(value) == "ARRAY", lj.as_text(head)).otherwise(
        F.when(lj.truthy(value), lj.as_text(value))
    )


def category_hierarchy(breadcrumb: Column, path: Column) -> Column:
    """Breadcrumb names between the first and the last; else the category path."""
    items = F.filter(
        lj.elements(lj.field(breadcrumb, "itemListElement")),
        lambda i: lj.truthy(lj.field(i, "name")),
    )
    names = F.transform(items, lambda i: squeeze(lj.text(lj.field(i, "name"))))
    parts = F.transform(
        F.split(F.coalesce(path, F.lit("")), fv.CATEGORY_SEPARATOR), squeeze_ends
    )
    return F.when(
        F.size(names) >= 3, F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
    ).otherwise(F.filter(parts, lambda p: p != ""))


def bad_breadcrumb(breadcrumb: Column) -> Column:
    """A breadcrumb name that is given but no text, which fails a page."""
    names = F.transform(
        lj.elements(lj.field(breadcrumb, "itemListElement")), lambda i: lj.field(i, "name")
    )
    return F.coalesce(F.exists(names, lj.truthy_but_not_text), F.lit(False))


def squeeze_ends(c: Column) -> Column:
    """Trim all whitespace from both ends, leaving inner runs alone."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def brand(ld_brand: Column, hit_brand: Column, variant_brand: Column | None = None) -> Column:
    """Variant manufacturer, page brand (text or object with a name), hit manufacturer."""
    page = F.when(lj.kind(ld_brand) == "OBJECT", lj.field(ld_brand, "name")).otherwise(ld_brand)
    chain = [F.when(lj.truthy(page), lj.text(page)), hit_brand]
    if variant_brand is not None:
        chain.insert(0, F.when(lj.truthy(variant_brand), lj.text(variant_brand)))
    return blank_to_null(squeeze(F.coalesce(*map(blank_to_null, chain))))


def currency(offer: Column, hit_price: Column) -> Column:
    """Offer currency, else the default one when the hit has a price."""
    code = F.when(lj.kind(offer) == "OBJECT", lj.field(offer, "priceCurrency"))
    return F.when(lj.truthy(code), lj.as_text(code)).when(
        lj.truthy(hit_price), F.lit(fv.DEFAULT_CURRENCY)
    )


def availability(value: Column) -> Column:
    """Stock label from a schema.org URL or a raw label."""
    known = F.create_map(*[F.lit(x) for pair in fv.AVAILABILITY.items() for x in pair])
    last = F.substring_index(blank_to_null(value), "/", -1)
    return F.when(last.isNotNull(), F.coalesce(F.element_at(known, last), squeeze(last)))


def image_list(*arrays: Column) -> Column:
    """Arrays joined in priority order: no nulls, blanks, placeholders or repeats."""
    return F.array_distinct(
        F.filter(
            F.concat(*arrays),
            lambda u: u.isNotNull()
            & (u != "")
            & ~F.contains(F.lower(u), F.lit(fv.PLACEHOLDER)),
        )
    )


def page_images(ld_image: Column, gallery: Column, hit_image: Column) -> Column:
    listed = F.transform(lj.elements(ld_image), lj.text)
    return image_list(listed, F.array(lj.text(ld_image)), gallery, F.array(hit_image))
