"""Inputs of the catalog jobs, derived by Spark from the given tables.

Product pages and their listings come from ``part`` (four parts are a family),
search hits from ``orders``, products for matching and model responses from
``part``. Everything is a column expression, so the inputs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import extract as ex
from workload.registry import table

STAMP = "2024-01-02 03:04:05"
SHOP = "https://shop.test/item/"
IMAGES = "https://img.test/"

# -- product pages ------------------------------------------------------------


def _script_string(json: Column) -> Column:
    """JSON text as a JSON string literal."""
    escaped = F.replace(F.replace(json, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _ld(struct: Column) -> Column:
    return F.concat(
        F.lit('<script type="application/ld+json">'), F.to_json(struct), F.lit("</script>")
    )


def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their (at most four) parts in key order."""
    part = table(spark, sf_dir, "part").withColumn("f", F.expr("p_partkey div 4"))
    # The pages are heavy work from few bytes: keep every task.
    tasks = spark.sparkContext.defaultParallelism
    return (
        part.repartition(tasks, "f")
        .groupBy("f")
        .agg(F.sort_array(F.collect_list(F.struct(*part.drop("f").columns))).alias("parts"))
        .withColumn("h", F.get("parts", F.lit(0)))
    )


def _variant(p: Column) -> Column:
    k = p["p_partkey"]
    price = p["p_retailprice"].cast("string")
    text = F.concat(p["p_type"], F.lit(", "), p["p_size"].cast("string"), F.lit("/box"))
    return F.struct(
        k.alias("id"),
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0")).alias("sku"),
        F.concat(p["p_name"], F.lit("  "), k.cast("string")).alias("name"),
        F.when(k % 5 > 2, price).when(k % 5 == 2, F.concat(F.lit("<i>$"), price, F.lit("</i>"))).alias("product_price"),
        F.when(k % 5 == 1, F.parse_json(price))
        .otherwise(F.parse_json(F.concat(F.lit('{"x": 1, "USD": {"default": '), price, F.lit("}}"))))
        .alias("price"),
        F.when(k % 2 == 0, "In stock").alias("stock_availability_label"),
        F.lit(" Ships  later").alias("stock_availability"),
        F.when(k % 6 == 5, F.concat(F.lit("Box of "), p["p_size"].cast("string")))
        .when(k % 6 == 4, p["p_type"])
        .when(k % 4 == 1, F.concat(F.lit("<b>Tough</b> &amp; "), text))
        .otherwise(text)
        .alias("description"),
        F.concat(F.lit("M"), k.cast("string")).alias("manufacturer_part_number"),
        F.when(k % 3 != 0, p["p_brand"]).alias("manufacturer_name"),
        F.concat(F.lit(IMAGES), F.lit("p/"), k.cast("string"), F.lit(".jpg")).alias("main_image"),
        F.lit(IMAGES + "Placeholder.png").alias("image"),
        F.when(k % 10 == 0, "flammable").alias("hazard_type"),
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``product_url, html, hit, category_path``: pages paired with their listing."""
    f, h = F.col("f"), F.col("h")
    name = F.concat(F.lit("Family "), f.cast("string"))
    size = h["p_size"].cast("string")
    price = h["p_retailprice"]
    own_image = F.concat(F.lit(IMAGES), F.lit("f/"), f.cast("string"), F.lit(".jpg"))
    description = F.concat(
        h["p_type"], F.lit(", "), size, F.lit("/box\nSize:  "), size,
        F.lit("\nBrand &amp; co: "), h["p_brand"], F.lit("\nSize: "), size,
    )
    offers = F.when(
        f % 10 != 3,
        F.struct(
            F.lit("EUR").alias("priceCurrency"),
            price.cast("string").alias("price"),
            F.when(f % 3 == 0, "https://schema.org/OutOfStock")
            .when(f % 3 == 1, "https://schema.org/InStock")
            .otherwise("https://schema.org/MadeToOrder")
            .alias("availability"),
        ),
    )

    def product(image: Column, brand: Column) -> Column:
        return _ld(
            F.struct(
                F.lit("Product").alias("@type"),
                name.alias("name"),
                description.alias("description"),
                F.when(f % 4 != 2, F.concat(F.lit("F"), f.cast("string"))).alias("sku"),
                image.alias("image"),
                brand.alias("brand"),
                offers.alias("offers"),
            )
        )

    listed = F.array(own_image, own_image, F.lit(IMAGES + "placeholder.gif"))
    product_ld = F.when(
        f % 2 == 0, product(listed, F.struct(h["p_brand"].alias("name")))
    ).otherwise(product(own_image, h["p_brand"]))
    crumb_names = F.when(
        f % 4 == 3, F.array(F.lit("Home"), name)
    ).otherwise(F.array(F.lit("Home"), h["p_type"], h["p_brand"], name))
    crumbs = _ld(
        F.struct(
            F.lit("BreadcrumbList").alias("@type"),
            F.transform(crumb_names, lambda n: F.struct(n.alias("name"))).alias("itemListElement"),
        )
    )
    variants = F.map_from_entries(
        F.transform(
            "parts",
            lambda p: F.struct(p["p_partkey"].cast("string").alias("key"), _variant(p).alias("value")),
        )
    )
    encoded = (
        F.when(f % 50 == 7, _script_string(F.lit('{"cut": ')))
        .when(f % 50 == 9, _script_string(F.lit('{"x": {"sku": "x", "name": "x", "price": "$1.2.3"}}')))
        .otherwise(_script_string(F.to_json(variants)))
    )
    script = F.concat(
        F.lit('<script>initialImages: [{"full": "'), own_image, F.lit('"}, {"img": "'),
        F.lit(IMAGES), F.lit("g/"), f.cast("string"), F.lit('.jpg"}],'),
        F.when(f % 5 != 0, F.concat(F.lit("\nwindow.masterData = "), encoded, F.lit(";"))).otherwise(""),
        F.lit("</script>"),
    )
    html = F.concat(
        F.lit("<html><head>"), product_ld, crumbs, F.lit("</head><body>"), script,
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit(SHOP), f.cast("string"))
    scalar_sku = F.to_json(F.struct(F.concat(F.lit("L"), f.cast("string")).alias("s")))
    hit = F.struct(
        F.concat(F.lit("H"), f.cast("string")).alias("objectID"),
        F.when(f % 2 == 0, url).alias("family_url"),
        url.alias("url"),
        F.when(
            f % 2 == 0,
            F.parse_json(F.concat(F.lit('["L'), f.cast("string"), F.lit('"]'))),
        ).otherwise(F.try_variant_get(F.parse_json(scalar_sku), "$.s", "variant")).alias("sku"),
        F.concat(F.lit("Listing "), f.cast("string")).alias("name"),
        F.parse_json(price.cast("string")).alias("price"),
        F.concat(F.lit(IMAGES), F.lit("h/"), f.cast("string"), F.lit(".jpg")).alias("image_url"),
        h["p_brand"].alias("manufacturer_name"),
        F.concat(F.lit("LM"), f.cast("string")).alias("manufacturer_part_number"),
        F.lit("Ask  us").alias("stock_status_label"),
        F.lit(None).cast("string").alias("stock_availability"),
    )
    return family_members(spark, sf_dir).select(
        url.alias("product_url"),
        html.alias("html"),
        hit.alias("hit"),
        F.concat(h["p_type"], F.lit(" /// "), h["p_brand"], F.lit(" /// ")).alias("category_path"),
    )


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.extract_products(
        product_pages(spark, sf_dir), source="shop.test", scraped_at=STAMP
    )


# What the pages hold, restated in SQL on ``part``.
FAMILY_SQL = """
WITH fam AS (
    SELECT p_partkey // 4 AS f, min(p_partkey) AS hk FROM part GROUP BY 1
),
head AS (
    SELECT f, p_type AS h_type, p_size AS h_size, p_brand AS h_brand, p_retailprice AS h_price,
           'https://shop.test/item/' || f AS product_url,
           f % 50 IN (7, 9) AS bad, f % 5 <> 0 AS grouped,
           CASE WHEN f % 4 <> 2 THEN 'F' || f ELSE 'L' || f END AS page_sku,
           h_type || ', ' || h_size || '/box' AS h_text
    FROM fam JOIN part ON p_partkey = hk
),
variant AS (
    SELECT p.*, head.*, p_partkey AS k,
           CASE WHEN p_partkey % 6 = 5 THEN 'Box of ' || p_size
                WHEN p_partkey % 6 = 4 THEN p_type
                WHEN p_partkey % 4 = 1 THEN 'Tough & ' || p_type || ', ' || p_size || '/box'
                ELSE p_type || ', ' || p_size || '/box' END AS own_text,
           CASE WHEN p_partkey % 6 = 5 THEN 'Box of ' || p_size
                WHEN p_partkey % 6 = 4 THEN NULL
                ELSE p_size || '/box' END AS own_pack
    FROM part p JOIN head ON p.p_partkey // 4 = head.f
    WHERE NOT bad AND grouped
),
single AS (SELECT * FROM head WHERE NOT bad AND NOT grouped)
"""

# -- search hits ----------------------------------------------------------------


def order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits: a category per priority, a family per customer, fifty orders a page."""
    key, url = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    variant_null = F.lit(None).cast("variant")
    text_null = F.lit(None).cast("string")
    hit = F.struct(
        F.concat(F.lit("O"), key.cast("string")).alias("objectID"),
        F.when(F.col("o_orderstatus") == "F", url)
        .when(F.col("o_orderstatus") == "O", "")
        .alias("family_url"),
        F.when(F.col("o_totalprice") > 20000, url).alias("url"),
        variant_null.alias("sku"),
        text_null.alias("name"),
        variant_null.alias("price"),
        *[
            text_null.alias(n)
            for n in (
                "image_url", "manufacturer_name", "manufacturer_part_number",
                "stock_status_label", "stock_availability",
            )
        ],
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("category_url"),
        F.expr("cast(o_orderkey div 50 as int)").alias("page_no"),
        (key % 50).cast("int").alias("pos"),
        hit.alias("hit"),
    )


HITS_SQL = """
WITH hits AS (
    SELECT o_orderpriority AS category_url, CAST(o_orderkey // 50 AS INTEGER) AS page_no,
           CAST(o_orderkey % 50 AS INTEGER) AS pos, 'O' || o_orderkey AS object_id,
           CAST(left(o_orderpriority, 1) AS INTEGER) AS category_ord,
           CASE WHEN o_orderstatus = 'F' OR o_totalprice > 20000 THEN 'c' || o_custkey END AS product_url
    FROM orders
),
first_hit AS (
    SELECT * FROM hits WHERE product_url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY category_url, product_url ORDER BY page_no, pos) = 1
)
"""


def order_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category configuration per priority."""
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("category_url"))
        .distinct()
        .select(
            "category_url",
            F.left("category_url", F.lit(1)).cast("int").alias("category_ord"),
            F.concat(F.lit("Orders /// "), F.col("category_url")).alias("category_path"),
            F.lit(1).alias("category_level"),
            F.left("category_url", F.lit(1)).alias("category_id"),
        )
    )


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of at most fifty hits; a category announces fewer pages than there are (as
    many as its first digit), and one of them returns an empty page half-way."""
    digit = F.left("category_url", F.lit(1)).cast("int")
    hits = order_hits(spark, sf_dir)
    last = hits.groupBy("category_url").agg(F.max("page_no").alias("last"))
    empty = (digit == 3) & (F.col("page_no") == F.expr("last div 2"))
    return (
        hits.groupBy("category_url", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("hit.objectID").alias("id"), F.col("hit.url").alias("url"), F.col("hit.family_url").alias("family_url")))).alias("found"))
        .join(last, "category_url")
        .select(
            "category_url",
            "page_no",
            (F.col("last") - digit).alias("nbPages"),
            F.lit(None).cast("string").alias("error"),
            F.when(empty, F.slice("found", 1, 0)).otherwise(F.col("found")).alias("found"),
        )
    )


# -- products for matching --------------------------------------------------------


def match_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0")).alias("sku"),
        F.col("p_name").alias("product_name"),
        F.concat(F.lit("u"), F.expr("p_partkey div 4").cast("string")).alias("product_url"),
        F.col("p_brand").alias("brand"),
        F.array("p_type").alias("category_hierarchy"),
        F.concat(
            F.split("p_name", " "),
            F.array(F.lower("p_type"), F.concat(F.lit("size-"), F.col("p_size").cast("string"))),
        ).alias("normalized_tags"),
    )


MATCH_SQL = """
WITH item AS (
    SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS sku, p_name AS product_name,
           'u' || (p_partkey // 4) AS product_url, lower(p_brand) AS brand, lower(p_type) AS leaf,
           list_sort(list_distinct(list_concat(string_split(p_name, ' '),
               [lower(p_type), 'size-' || p_size]))) AS tags
    FROM part
),
pair AS (
    SELECT a.sku, a.product_url, b.sku AS other_sku, b.product_url AS other_url, b.product_name AS other_name,
           list_sort(list_intersect(a.tags, b.tags)) AS shared, len(a.tags) AS n, len(b.tags) AS m,
           CAST(a.leaf <> '' AND a.leaf = b.leaf AS INTEGER) AS same_leaf,
           CAST(a.brand = b.brand AS INTEGER) AS same_brand
    FROM item a JOIN item b
      ON a.sku IS DISTINCT FROM b.sku AND a.product_url IS DISTINCT FROM b.product_url
     AND len(a.tags) > 0 AND len(b.tags) > 0
),
scored AS (
    SELECT *, CAST(printf('%.4f', 0.65::DOUBLE * (len(shared)::DOUBLE / (n + m - len(shared)))
                   + 0.25::DOUBLE * same_leaf + 0.10::DOUBLE * same_brand) AS DOUBLE) AS score
    FROM pair
)
"""
