"""Column rules of the similarity score."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions.text import blank_to_null, casefold


def leaf_category(hierarchy: Column) -> Column:
    """Folded last category name; '' without one."""
    return casefold(F.coalesce(F.try_element_at(hierarchy, F.lit(-1)), F.lit("")))


def brand_key(brand: Column) -> Column:
    """Folded brand; null when missing, so that it never equals another."""
    return casefold(blank_to_null(brand))


def tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(tags, F.array().cast("array<string>")))))


def shared_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def same_leaf(a: Column, b: Column) -> Column:
    return (a == b) & (a != "")


def same_brand(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def raw_score(shared: Column, union: Column, leaf: Column, brand: Column) -> Column:
    """Weighted tag overlap, leaf and brand, before rounding."""
    return (
        F.lit(fv.TAG_WEIGHT) * F.when(union > 0, shared / union).otherwise(F.lit(0.0))
        + F.lit(fv.LEAF_WEIGHT) * leaf.cast("double")
        + F.lit(fv.BRAND_WEIGHT) * brand.cast("double")
    )


def rounded_to(value: Column, places: int) -> Column:
    """Rounded on the exact binary value (``round`` would first go through the
    shortest decimal)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places)).cast("double")


def rounded(raw: Column) -> Column:
    return rounded_to(raw, 4)


def reaches(raw: Column, threshold: float) -> Column:
    """``rounded(raw) >= threshold`` as one comparison of doubles.

    ``threshold`` has at most four places. Rounding flips at half a unit below
    it; the double nearest to that point decides for itself.
    """
    flip = float(Decimal(str(threshold)) - Decimal("0.00005"))
    return raw >= F.lit(flip) if round(flip, 4) >= threshold else raw > F.lit(flip)


def eligible(sku_a: Column, url_a: Column, sku_b: Column, url_b: Column) -> Column:
    """Different SKU and different page; two missing values count as the same."""
    return ~sku_a.eqNullSafe(sku_b) & ~url_a.eqNullSafe(url_b)


def reason(shared: Column) -> Column:
    return F.when(
        F.size(shared) > 0, F.concat(F.lit(fv.REASON_SHARED), F.array_join(shared, ", "))
    ).otherwise(F.lit(fv.REASON_CATEGORY))
