"""Schemas (DDL text) of the relations the jobs read and write."""

from __future__ import annotations

SEED = "name string, url string"

CATEGORY = (
    "category_url string, category_ord int, category_path string, category_level int, category_id string"
)

# sku and price keep their JSON type: either may be a scalar, a list or an object.
HIT = (
    "objectID string, family_url string, url string, sku variant, name string, "
    "price variant, image_url string, manufacturer_name string, "
    "manufacturer_part_number string, stock_status_label string, "
    "stock_availability string"
)

SEARCH_RESPONSE = (
    f"category_url string, page_no int, nbPages int, error string, hits array<struct<{HIT}>>"
)

PAGE = "url string, html string"

# seq: order in which the answers were given
MODEL_RESPONSE = "sku string, kind string, payload string, seq bigint"

ALTERNATIVE = (
    "struct<sku:string,product_name:string,product_url:string,score:double,"
    "reason:string,source:string,method:string>"
)

PRODUCT = (
    "source string, source_product_id string, parent_sku string, sku string, "
    "product_name string, brand string, manufacturer_part_number string, "
    "category_hierarchy array<string>, product_url string, price double, "
    "currency string, unit_pack_size string, availability string, "
    "description string, unit_pack_size_source string, "
    "normalized_tags array<string>, specifications map<string,string>, "
    "pack_size_evidence string, pack_size_confidence double, "
    "image_urls array<string>, scraped_at timestamp"
)
PRODUCT_COLUMNS = [column.split()[0] for column in PRODUCT.split(", ")]

FAILURE = "url string, stage string, error string"

COMPLETED = "url string"

# Version of the rules that read pages; to be raised when they change, as metrics are kept by it.
PARSER_VERSION = "1"

# metrics of a run: one value, of a category and parser version or of the whole run
METRIC = "metric string, category string, parser_version string, value double, at timestamp"

# an answer of a model, kept by what was asked
ANSWER = "request_id string, payload string"
