"""Reading untyped JSON values (VARIANT) and the scripts that carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom import fixed_values as fv

# One pass over the page: comments are consumed first, so a script inside a
# comment is not seen; an unclosed script does not match.
SCRIPT = (
    r"(?is)<!--.*?-->"
    r"|<script\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(.*?)</script\s*>"
)
LD_ATTRIBUTE = (
    r"(?is)(?:^|\s)type\s*=\s*"
    r"(?:\"application/ld\+json\"|'application/ld\+json'|application/ld\+json(?:\s|$))"
)

# how JSON values that count as missing are printed
FALSY = ("null", '""', "false", "0", "0.0", "-0.0", "[]", "{}")


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def kind(value: Column) -> Column:
    """STRING, BOOLEAN, VOID, OBJECT, ARRAY, or a numeric type name."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def text(value: Column) -> Column:
    """The text of a JSON string; null for every other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_text(value: Column) -> Column:
    """Any JSON value as text; a whole number written with a fraction keeps '.0'."""
    plain = F.try_variant_get(value, "$", "string")
    schema = F.schema_of_variant(value)
    whole = F.rlike(schema, F.lit(r"^DECIMAL\((?:\d|1[0-8]),0\)$"))
    return F.when(whole, F.concat(plain, F.lit(".0"))).otherwise(plain)


def truthy(value: Column) -> Column:
    """Present and not null, '', 0, false, [] or {}."""
    return F.coalesce(~F.to_json(value).isin(*FALSY), F.lit(False))


def truthy_but_not_text(value: Column) -> Column:
    json = F.to_json(value)
    return F.coalesce(~json.isin(*FALSY) & ~F.startswith(json, F.lit('"')), F.lit(False))


def first_truthy(*values: Column) -> Column:
    return F.coalesce(*[F.when(truthy(v), v) for v in values])


def elements(value: Column) -> Column:
    """Elements of a JSON array; empty for every other type."""
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")
    )


def parse_whole(c: Column) -> Column:
    """A text that is exactly one JSON value; null if not.

    Spark's parser ignores what follows the first value. Inside brackets a
    trailing remainder is an error, and a second value shows in the length.
    """
    wrapped = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>"
    )
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))


def after_marker(document: Column, marker: str) -> Column:
    """What follows the first occurrence of ``marker``; null without one."""
    at = F.instr(document, marker)
    tail = F.substr(document, at + len(marker))
    return F.when(at > 0, F.regexp_replace(tail, fv.LEADING_WHITESPACE, ""))


def assigned_value(document: Column, marker: str) -> Column:
    """The JSON value right after ``marker``; null if there is none."""
    return F.try_parse_json(after_marker(document, marker))


def ld_records(document: Column) -> Column:
    """JSON objects of all ld+json scripts in document order, lists flattened."""
    scripts = F.transform(
        F.regexp_extract_all(document, F.lit(SCRIPT), 0),
        lambda s: F.struct(
            F.regexp_extract(s, SCRIPT, 1).alias("attributes"),
            F.regexp_extract(s, SCRIPT, 2).alias("body"),
        ),
    )
    ld = F.filter(scripts, lambda s: F.rlike(s["attributes"], F.lit(LD_ATTRIBUTE)))
    values = F.transform(ld, lambda s: parse_whole(s["body"]))
    flat = F.flatten(
        F.transform(
            values,
            lambda v: F.when(kind(v) == "ARRAY", elements(v)).otherwise(F.array(v)),
        )
    )
    return F.filter(flat, lambda v: F.coalesce(kind(v) == "OBJECT", F.lit(False)))


def ld_of_type(records: Column, wanted: str) -> Column:
    """First record of a type, each record looked at before its own graph."""
    unrolled = F.flatten(
        F.transform(records, lambda r: F.concat(F.array(r), elements(field(r, "@graph"))))
    )
    return F.get(F.filter(unrolled, lambda r: text(field(r, "@type")) == wanted), F.lit(0))


def variant_map_text(document: Column) -> Column:
    """Text of the embedded variant map (a JSON object inside a JSON string)."""
    return text(assigned_value(document, fv.VARIANTS_MARKER))


def variant_entries(map_text: Column) -> Column:
    """Variants in document order as ``array<struct<ordinal, key, value>>``."""
    entries = F.map_entries(F.from_json(map_text, "map<string,variant>"))
    return F.transform(
        F.when(kind(parse_whole(map_text)) == "OBJECT", entries),
        lambda e, i: F.struct(
            i.alias("ordinal"), e["key"].alias("key"), e["value"].alias("value")
        ),
    )


def initial_images(document: Column) -> Column:
    """Distinct image URLs of the page's gallery script."""
    items = F.filter(
        elements(assigned_value(document, fv.IMAGES_MARKER)), lambda v: kind(v) == "OBJECT"
    )
    urls = F.transform(items, lambda v: text(first_truthy(field(v, "full"), field(v, "img"))))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))
