"""Page parsing, extraction and validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import loose_json as lj
from skuloom.functions import text as tx
from skuloom.functions.fields import availability, first_sku, identifier, image_list, page_images
from skuloom.functions.prices import nested_prices, scalar_price
from skuloom.operators import extract as ex
from skuloom.operators import validate as va
from skuloom.session import scratch_path
from skuloom.sources import page_table, readers
from workload.registry import query, table
from workload.standins import FAMILY_SQL, extracted, product_pages


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


def pairs(column: str) -> Column:
    """A map as text, keys sorted."""
    return joined(
        F.transform(
            F.array_sort(F.map_entries(column)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        )
    )


def good(spark, sf_dir):
    return ex.good_rows(extracted(spark, sf_dir))


@query(
    "p6_expand_families",
    FAMILY_SQL
    + """
SELECT product_url, count(*) AS product_rows, min(k % 4) AS first_place FROM variant GROUP BY 1
UNION ALL SELECT product_url, 1, 0 FROM single""",
)
def p6(spark, sf_dir):
    return good(spark, sf_dir).groupBy("product_url").agg(
        F.count("*").alias("product_rows"), F.min("ordinal").cast("bigint").alias("first_place")
    )


@query(
    "p7_variant_rows",
    FAMILY_SQL
    + """
SELECT CAST(k AS VARCHAR) AS source_product_id, page_sku AS parent_sku,
       'P' || lpad(CAST(k AS VARCHAR), 9, '0') AS sku, p_name || ' ' || k AS product_name,
       CASE WHEN k % 3 <> 0 THEN p_brand ELSE h_brand END AS brand,
       'M' || k AS manufacturer_part_number, p_retailprice AS price,
       own_pack AS unit_pack_size, CASE WHEN own_pack IS NOT NULL THEN 'rule' END AS unit_pack_size_source,
       CASE WHEN k % 2 = 0 THEN 'In stock' ELSE 'Ships later' END AS availability,
       h_text || ' Size: ' || h_size || ' Brand & co: ' || h_brand || ' Size: ' || h_size AS description,
       'Brand & co=' || h_brand || '|Size=' || h_size
           || CASE WHEN k % 10 = 0 THEN '|hazard_type=flammable' ELSE '' END
           || '|variant=' || own_text AS specifications,
       'https://img.test/p/' || k || '.jpg|https://img.test/f/' || f || '.jpg|https://img.test/g/' || f
           || '.jpg|https://img.test/h/' || f || '.jpg' AS image_urls
FROM variant""",
)
def p7(spark, sf_dir):
    rows = good(spark, sf_dir).filter(F.col("parent_sku").isNotNull())
    return rows.select(
        "source_product_id", "parent_sku", "sku", "product_name", "brand",
        "manufacturer_part_number", "price", "unit_pack_size", "unit_pack_size_source",
        "availability", "description", pairs("specifications").alias("specifications"),
        joined("image_urls").alias("image_urls"),
    )


@query(
    "p8_parent_rows",
    FAMILY_SQL
    + """
SELECT 'H' || f AS source_product_id, page_sku AS sku, 'Family ' || f AS product_name, h_brand AS brand,
       'LM' || f AS manufacturer_part_number, h_price AS price,
       CASE WHEN f % 10 = 3 THEN 'USD' ELSE 'EUR' END AS currency,
       h_size || '/box' AS unit_pack_size,
       CASE WHEN f % 10 = 3 THEN 'Ask us' WHEN f % 3 = 0 THEN 'Out of stock'
            WHEN f % 3 = 1 THEN 'In stock' ELSE 'MadeToOrder' END AS availability,
       'Brand & co=' || h_brand || '|Size=' || h_size AS specifications,
       'https://img.test/f/' || f || '.jpg|https://img.test/g/' || f || '.jpg|https://img.test/h/' || f
           || '.jpg' AS image_urls
FROM single""",
)
def p8(spark, sf_dir):
    rows = good(spark, sf_dir).filter(F.col("parent_sku").isNull())
    return rows.select(
        "source_product_id", "sku", "product_name", "brand", "manufacturer_part_number", "price",
        "currency", "unit_pack_size", "availability",
        pairs("specifications").alias("specifications"), joined("image_urls").alias("image_urls"),
    )


@query(
    "u4_variant_and_parent_rows",
    FAMILY_SQL
    + """
SELECT 'P' || lpad(CAST(k AS VARCHAR), 9, '0') AS sku, product_url FROM variant
UNION ALL SELECT page_sku, product_url FROM single""",
)
def u4(spark, sf_dir):
    return good(spark, sf_dir).select("sku", "product_url")


ALL_ROWS = "(SELECT f FROM variant UNION ALL SELECT f FROM single)"


@query("p9_constant_columns", FAMILY_SQL + f"SELECT 'shop.test' AS source, count(*) AS product_rows FROM {ALL_ROWS}")
def p9(spark, sf_dir):
    return good(spark, sf_dir).groupBy("source").agg(F.count("*").alias("product_rows"))


@query(
    "d1_timestamp",
    FAMILY_SQL + f"SELECT '2024-01-02T03:04:05Z' AS scraped_at, count(*) AS product_rows FROM {ALL_ROWS}",
)
def d1(spark, sf_dir):
    stamp = F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return good(spark, sf_dir).groupBy(stamp.alias("scraped_at")).agg(
        F.count("*").alias("product_rows")
    )


@query(
    "x11_category_hierarchy",
    FAMILY_SQL
    + """
SELECT DISTINCT product_url, h_type || '|' || h_brand AS hierarchy
FROM (SELECT product_url, h_type, h_brand FROM variant UNION ALL SELECT product_url, h_type, h_brand FROM single)""",
)
def x11(spark, sf_dir):
    return good(spark, sf_dir).select("product_url", joined("category_hierarchy").alias("hierarchy")).distinct()


@query(
    "x13_brand",
    FAMILY_SQL
    + """
SELECT brand, count(*) AS product_rows FROM (
    SELECT CASE WHEN k % 3 <> 0 THEN p_brand ELSE h_brand END AS brand FROM variant
    UNION ALL SELECT h_brand FROM single)
GROUP BY ALL""",
)
def x13(spark, sf_dir):
    return good(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("product_rows"))


@query(
    "x14_currency",
    FAMILY_SQL
    + f"""
SELECT CASE WHEN f % 10 = 3 THEN 'USD' ELSE 'EUR' END AS currency, count(*) AS product_rows FROM {ALL_ROWS}
GROUP BY ALL""",
)
def x14(spark, sf_dir):
    return good(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("product_rows"))


PAGES_SQL = """
SELECT 'u' || l_partkey AS product_url, count(*) AS listings, max(p_name) AS html
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 2) ON l_partkey = p_partkey
GROUP BY 1"""


def listed_and_pages(spark, sf_dir):
    url = F.concat(F.lit("u"), F.col("l_partkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    listings = lines.select(url.alias("product_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"))
    pages = table(spark, sf_dir, "part").filter("p_size > 2").select(
        F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_name").alias("html")
    )
    return listings, pages


@query("j1_pages_to_listings", PAGES_SQL)
def j1(spark, sf_dir):
    listings, pages = listed_and_pages(spark, sf_dir)
    return ex.attach_pages(listings.drop("attempt"), pages).groupBy("product_url").agg(
        F.count("*").alias("listings"), F.max("html").alias("html")
    )


@query("j1_page_table", PAGES_SQL)
def j1_table(spark, sf_dir):
    """Pages stored by URL; the listings of each URL come to them as one array."""
    listings, pages = listed_and_pages(spark, sf_dir)
    stored = page_table.write_pages(pages, scratch_path(spark, "page-table"), 8)
    joined = ex.attach_listings(ex.listings_of(listings), stored)
    return joined.select("product_url", F.size("listings").cast("long").alias("listings"), "html")


@query(
    "s9_page_failures",
    FAMILY_SQL
    + """
SELECT product_url AS url, 'product_extraction' AS stage,
       CASE f % 50 WHEN 7 THEN 'variant map is not valid JSON' ELSE 'price is not a number: 1.2.3' END AS error
FROM head WHERE bad""",
)
def s9(spark, sf_dir):
    return ex.page_failures(extracted(spark, sf_dir))


def named_parts(spark, sf_dir):
    """Parts as products; small ones have no name, the smallest no SKU either."""
    url = F.concat(F.lit(" u"), F.expr("p_partkey div 4").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 2, F.concat(F.lit(" P"), F.col("p_partkey").cast("string"))).alias("sku"),
        F.when(F.col("p_size") > 5, F.concat("p_name", F.lit("  x"))).otherwise(" ").alias("product_name"),
        F.when(F.col("p_brand") != "Brand#7", url).alias("product_url"),
        (F.col("p_partkey") % 4).cast("int").alias("ordinal"),
    )


NAMED_SQL = """
WITH named AS (
    SELECT CASE WHEN p_size > 2 THEN 'P' || p_partkey ELSE '' END AS sku,
           CASE WHEN p_size > 5 THEN p_name || ' x' ELSE '' END AS product_name,
           CASE WHEN p_brand <> 'Brand#7' THEN 'u' || (p_partkey // 4) ELSE '' END AS product_url
    FROM part
)
"""


@query(
    "p10_required_fields",
    NAMED_SQL
    + """
SELECT sku, product_name, product_url,
       concat_ws(', ', CASE WHEN sku = '' THEN 'sku' END, CASE WHEN product_name = '' THEN 'product_name' END,
                 CASE WHEN product_url = '' THEN 'product_url' END) AS missing
FROM named""",
)
def p10(spark, sf_dir):
    checked = va.check_required(named_parts(spark, sf_dir))
    return checked.select("sku", "product_name", "product_url", F.array_join("missing", ", ").alias("missing"))


@query(
    "u6_failure_log",
    NAMED_SQL
    + """
SELECT product_url AS url, 'validation' AS stage,
       CASE product_url WHEN '' THEN '<unknown>' ELSE product_url END || ': missing '
       || concat_ws(', ', CASE WHEN sku = '' THEN 'sku' END, CASE WHEN product_name = '' THEN 'product_name' END,
                    CASE WHEN product_url = '' THEN 'product_url' END) AS error
FROM named WHERE sku = '' OR product_name = '' OR product_url = ''
UNION ALL
SELECT 'https://shop.test/item/' || f, 'product_extraction',
       CASE f % 50 WHEN 7 THEN 'variant map is not valid JSON' ELSE 'price is not a number: 1.2.3' END
FROM (SELECT DISTINCT p_partkey // 4 AS f FROM part) WHERE f % 50 IN (7, 9)""",
)
def u6(spark, sf_dir):
    return va.rejected(va.check_required(named_parts(spark, sf_dir))).unionByName(
        ex.page_failures(extracted(spark, sf_dir))
    )


@query(
    "a3_first_valid_per_sku",
    """
SELECT 'u' || l_orderkey AS product_url, 'S' || l_suppkey AS sku, l_returnflag AS product_name,
       CAST(l_linenumber AS INTEGER) AS ordinal
FROM lineitem WHERE l_quantity > 3
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1""",
)
def a3(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("product_url"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sku"),
        F.when(F.col("l_quantity") > 3, F.col("l_returnflag")).alias("product_name"),
        F.col("l_linenumber").cast("int").alias("ordinal"),
    )
    return va.accepted(va.check_required(rows)).select("product_url", "sku", "product_name", "ordinal")


# -- single parsing functions ------------------------------------------------------


@query(
    "x1_squeeze_whitespace",
    r"""
SELECT doc_id, trim(regexp_replace(coalesce(text, ''),
       '[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
       ' ', 'g')) AS text
FROM documents""",
)
def x1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("text"))


@query(
    "x2_json_after_marker",
    """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""",
)
def x2(spark, sf_dir):
    document = F.concat(
        F.lit(f"<script>var a = {{}}; {fv.CATEGORY_MARKER}\n"), "props", F.lit(";\nvar b = 2;</script>")
    )
    value = lj.assigned_value(document, fv.CATEGORY_MARKER)
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(value, "$.k", "string").alias("k")
    )


@query(
    "x3_ld_records",
    """
SELECT 'https://shop.test/item/' || (p_partkey // 4) AS product_url, 2 AS records, 'Product|BreadcrumbList' AS types
FROM part GROUP BY ALL""",
)
def x3(spark, sf_dir):
    records = lj.ld_records(F.col("html"))
    return product_pages(spark, sf_dir).select("product_url", records.alias("records")).select(
        "product_url",
        F.size("records").alias("records"),
        joined(F.transform("records", lambda r: lj.text(lj.field(r, "@type")))).alias("types"),
    )


@query(
    "x4_ld_of_type",
    """
SELECT DISTINCT 'https://shop.test/item/' || (p_partkey // 4) AS product_url,
       'Family ' || (p_partkey // 4) AS product_name FROM part""",
)
def x4(spark, sf_dir):
    record = lj.ld_of_type(lj.ld_records(F.col("html")), fv.LD_PRODUCT)
    return product_pages(spark, sf_dir).select("product_url", record.alias("ld")).select(
        "product_url", lj.text(lj.field(F.col("ld"), "name")).alias("product_name")
    )


@query(
    "x5_variant_map",
    FAMILY_SQL
    + """
SELECT product_url, CAST(k % 4 AS INTEGER) AS ordinal, CAST(k AS VARCHAR) AS variant_key, p_name || '  ' || k AS name
FROM variant
UNION ALL SELECT product_url, 0, 'x', 'x' FROM head WHERE f % 50 = 9""",
)
def x5(spark, sf_dir):
    entries = lj.variant_entries(lj.variant_map_text(F.col("html")))
    return product_pages(spark, sf_dir).select("product_url", F.inline(entries)).select(
        "product_url", "ordinal", F.col("key").alias("variant_key"),
        lj.text(lj.field(F.col("value"), "name")).alias("name"),
    )


@query(
    "x6_initial_images",
    """
SELECT DISTINCT 'https://shop.test/item/' || (p_partkey // 4) AS product_url,
       'https://img.test/f/' || (p_partkey // 4) || '.jpg|https://img.test/g/' || (p_partkey // 4) || '.jpg' AS images
FROM part""",
)
def x6(spark, sf_dir):
    return product_pages(spark, sf_dir).select(
        "product_url", joined(lj.initial_images(F.col("html"))).alias("images")
    )


@query(
    "x7_html_to_text",
    r"""
WITH once AS (
    SELECT page_id, replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),
           '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS html FROM pages
),
stripped AS (
    SELECT page_id, regexp_replace(html, '<!--(.|\n)*?-->|<[a-zA-Z/!?][^>]*>', ' ', 'g') AS text FROM once
)
SELECT page_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM stripped""",
)
def x7(spark, sf_dir):
    return tx.html_to_text(table(spark, sf_dir, "pages"), "html", "text").select("page_id", "text")


@query(
    "x8_prices",
    "SELECT p_partkey, p_retailprice AS price FROM part",
)
def x8(spark, sf_dir):
    price = F.col("p_retailprice").cast("string")
    shapes = [
        price,
        F.concat(F.lit('"'), price, F.lit('"')),
        F.concat(F.lit("\"<b data-price-amount='"), price, F.lit("'>$1</b>\"")),
        F.concat(F.lit('"now $'), price, F.lit(' only"')),
        F.concat(F.lit('{"USD": {"default": '), price, F.lit("}}")),
        F.concat(F.lit('{"price": "none", "lowPrice": "'), price, F.lit('"}')),
    ]
    json = F.element_at(F.array(*shapes), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", F.array(F.parse_json(json)).alias("asked"))
        .withColumn("nested", nested_prices(F.col("asked")))
        .select(
            "p_partkey",
            F.coalesce(F.get("nested", F.lit(0)), scalar_price(F.get("asked", F.lit(0))))["amount"].alias("price"),
        )
    )


@query(
    "x9_pack_size",
    """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' gloves/box' WHEN 1 THEN 'case of ' || p_size
       WHEN 2 THEN p_size || ' CT' WHEN 3 THEN p_size || ' per Package' END AS pack_size
FROM part""",
)
def x9(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    text = (
        F.when(k == 0, F.concat("p_name", F.lit(", "), size, F.lit("  gloves/box, 5 ct")))
        .when(k == 1, F.concat("p_name", F.lit(" case of "), size))
        .when(k == 2, F.concat("p_name", F.lit(" "), size, F.lit(" CT.")))
        .when(k == 3, F.concat(size, F.lit(" per  Package of fun")))
        .otherwise(F.concat(size, F.lit(" / boxes")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", tx.pack_size(text).alias("pack_size"))


@query(
    "x10_labelled_specs",
    "SELECT p_partkey, 'Size & fit=' || p_size || '|Type=' || p_type || ': x' AS specs FROM part",
)
def x10(spark, sf_dir):
    text = F.concat(
        F.lit("Type: old\r\nno label\n Size &amp;  fit :"), F.col("p_size").cast("string"),
        F.lit("\n\nType:"), "p_type", F.lit(": x\n: empty key\nempty value: \n"), F.lit("k" * 61 + ": long"),
    )
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", F.array(text).alias("texts"))
        .withColumn("decoded", tx.decode_entities(F.col("texts")))
        .withColumn("specs", tx.labelled_specs(F.get("decoded", F.lit(0))))
        .select("p_partkey", pairs("specs").alias("specs"))
    )


@query(
    "x12_availability",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'In stock' WHEN 'O' THEN 'Out of stock'
       ELSE 'status ' || o_orderpriority END AS availability
FROM orders""",
)
def x12(spark, sf_dir):
    raw = (
        F.when(F.col("o_orderstatus") == "F", "https://schema.org/InStock")
        .when(F.col("o_orderstatus") == "O", "OutOfStock")
        .otherwise(F.concat(F.lit("x/y/status   "), "o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", availability(raw).alias("availability"))


@query(
    "x15_first_sku",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'S' || o_custkey
       WHEN 'O' THEN CASE WHEN o_custkey = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END END AS sku
FROM orders""",
)
def x15(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    json = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('["S'), cust, F.lit('", "T"]')))
        .when(F.col("o_orderstatus") == "O", cust)
        .otherwise("[]")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", first_sku(F.parse_json(json)).alias("sku"))


@query(
    "x16_optional_id",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR)
       WHEN 'O' THEN 'c ' || o_custkey END AS id
FROM orders""",
)
def x16(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    json = (
        F.when(F.col("o_orderstatus") == "F", cust)
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit('" c   '), cust, F.lit(' "')))
        .when(F.col("o_custkey") % 2 == 0, "false")
        .otherwise('"  "')
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", identifier(F.parse_json(json)).alias("id"))


@query(
    "a5_distinct_images",
    "SELECT p_partkey, 'b' || p_size || '|a' || CASE WHEN p_size <> 7 THEN '|b7' ELSE '' END AS images FROM part",
)
def a5(spark, sf_dir):
    own = F.concat(F.lit("b"), F.col("p_size").cast("string"))
    given = F.array(own, F.lit(None), F.lit("a"), own, F.lit(""), F.lit("x/PlaceHolder.png"), F.lit("b7"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(image_list(given)).alias("images"))


@query(
    "u3_images_in_priority_order",
    "SELECT p_partkey, 'b' || p_size || '|t-' || p_type || '|n-' || p_name AS images FROM part",
)
def u3(spark, sf_dir):
    own = F.concat(F.lit("b"), F.col("p_size").cast("string"))
    images = image_list(
        F.array(own), F.array(F.concat(F.lit("t-"), "p_type"), own), F.array(F.concat(F.lit("n-"), "p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", joined(images).alias("images"))


@query(
    "x17_page_images",
    """
SELECT p_partkey, 'b' || p_size || '|a' || CASE WHEN p_size <> 7 THEN '|b7' ELSE '' END AS images FROM part""",
)
def x17(spark, sf_dir):
    own = F.concat(F.lit("b"), F.col("p_size").cast("string"))
    ld_image = F.parse_json(F.concat(F.lit('["'), own, F.lit('", null, 5, "a", "x/PlaceHolder.png", ""]')))
    images = page_images(ld_image, F.array(F.lit("a"), own), F.lit("b7"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(images).alias("images"))


@query("s3_page_documents", "SELECT url, length(html) AS characters FROM pages")
def s3(spark, sf_dir):
    return readers.read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "url", F.length("html").cast("bigint").alias("characters")
    )
