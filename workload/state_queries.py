"""Run state, exports, streaming and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom import schemas
from skuloom.operators import quality as qu
from skuloom.operators.dedup import latest_per_key, run_summary
from skuloom.operators.validate import check_required, rejected
from skuloom.plans import catalog
from skuloom.session import materialize, scratch_path
from skuloom.sources import ledger, readers, state
from skuloom.sources.export import SIDE_COLUMNS, export_view, nested_as_json, write_csv, write_json
from skuloom.streaming.incremental import page_stream, process_new_pages, save_pages
from workload.enrich_queries import products
from workload.extract_queries import named_parts
from workload.listing_queries import configs, families
from workload.registry import query, table
from workload.standins import FAMILY_SQL, HITS_SQL, STAMP, product_pages

EVENT = "event_id bigint, at string, user_id bigint, event_type string, value double, props string"
EVENT_SQL = "event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, user_id, event_type, value, props"


def events(spark, sf_dir):
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")
    return table(spark, sf_dir, "events").select("event_id", at, "user_id", "event_type", "value", "props")


@query("s4_jsonl_log", f"SELECT {EVENT_SQL} FROM events")
def s4(spark, sf_dir):
    path = scratch_path(spark, "log")
    events(spark, sf_dir).write.json(path)
    return readers.read_jsonl_log(spark, path, EVENT).drop("line")


LATEST_SQL = f"""
SELECT {EVENT_SQL} FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query("a4_latest_row", LATEST_SQL)
def a4(spark, sf_dir):
    return latest_per_key(events(spark, sf_dir), "user_id", F.col("at"), F.col("event_id"))


def finished(spark, sf_dir, status):
    url = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select(url.alias("url"))


def completed_root(spark, sf_dir):
    root = scratch_path(spark, "completed")
    for batch_id, status in enumerate(("F", "O")):
        state.append(finished(spark, sf_dir, status).distinct(), root, "completed", batch_id)
    return root


@query(
    "s5_completed_urls",
    "SELECT DISTINCT 'c' || o_custkey AS url FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def s5(spark, sf_dir):
    return state.completed_urls(spark, completed_root(spark, sf_dir))


@query(
    "s8_marked_urls",
    """
SELECT DISTINCT 'c' || o_custkey AS url, CASE o_orderstatus WHEN 'F' THEN 0::BIGINT ELSE 1::BIGINT END AS batch_id
FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def s8(spark, sf_dir):
    return state.read(spark, completed_root(spark, sf_dir), "completed").select("url", "batch_id")


@query(
    "o2_sorted_completed_urls",
    "SELECT DISTINCT 'c' || o_custkey AS url FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY 1",
)
def o2(spark, sf_dir):
    return state.completed_urls(spark, completed_root(spark, sf_dir)).orderBy("url")


def saved(spark, sf_dir, root, batch_id, condition="true"):
    rows = products(spark, sf_dir).filter(condition).withColumns(
        {
            "place": F.struct(
                F.lit(0).alias("category_ord"), F.lit(0).alias("page_no"), F.lit(0).alias("pos")
            ),
            "ordinal": F.lit(0),
        }
    )
    state.append(rows, root, "products", batch_id)


@query(
    "s7_saved_products",
    """
SELECT 'P' || p_partkey AS sku, p_retailprice AS price, p_name AS variant, 0::BIGINT AS batch_id FROM part
UNION ALL SELECT 'P' || p_partkey, p_retailprice, p_name, 1 FROM part WHERE p_size > 45""",
)
def s7(spark, sf_dir):
    root = scratch_path(spark, "products")
    saved(spark, sf_dir, root, 0)
    saved(spark, sf_dir, root, 1)
    saved(spark, sf_dir, root, 1, "unit_pack_size is not null")  # the batch again
    return state.read(spark, root, "products").select(
        "sku", "price", F.element_at("specifications", F.lit("variant")).alias("variant"), "batch_id"
    )


@query(
    "s12_run_modes",
    """
SELECT 'P' || p_partkey AS sku, 'resumed' AS run, CASE WHEN p_size > 45 THEN 0::BIGINT ELSE 1::BIGINT END AS batch_id
FROM part
UNION ALL SELECT 'P' || p_partkey, 'fresh', 0 FROM part WHERE p_size <= 45""",
)
def s12(spark, sf_dir):
    runs = []
    for name, mode in (("resumed", "auto"), ("fresh", "fresh")):
        root = scratch_path(spark, "modes")
        saved(spark, sf_dir, root, state.begin(spark, root, "auto"), "unit_pack_size is not null")
        saved(spark, sf_dir, root, state.begin(spark, root, mode), "unit_pack_size is null")
        rows = state.read(spark, root, "products").select("sku", "batch_id")
        runs.append(rows.withColumn("run", F.lit(name)))
    return runs[0].unionByName(runs[1])


# -- the whole job -------------------------------------------------------------------

RUN_SQL = (
    FAMILY_SQL
    + """
, item AS (
    SELECT 'P' || lpad(CAST(k AS VARCHAR), 9, '0') AS sku, product_url, p_name AS words, p_type,
           CASE WHEN f % 4 = 3 THEN 'all' ELSE lower(h_brand) END AS leaf, lower(CASE WHEN k % 3 <> 0 THEN p_brand ELSE h_brand END) AS brand
    FROM variant
),
tagged AS (
    SELECT sku, product_url, leaf, brand,
           list_sort(list_distinct(string_split(words, ' ') || [lower(p_type)])) AS tags FROM item
),
scored AS (
    SELECT a.sku, b.sku AS other_sku, CAST(printf('%.4f', 0.65::DOUBLE * (len(list_intersect(a.tags, b.tags))::DOUBLE
               / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags))))
               + 0.25::DOUBLE * CAST(a.leaf = b.leaf AS INTEGER) + 0.10::DOUBLE * CAST(a.brand = b.brand AS INTEGER)) AS DOUBLE) AS score
    FROM tagged a JOIN tagged b ON a.sku <> b.sku AND a.product_url <> b.product_url
),
best AS (
    SELECT * FROM scored WHERE score >= 0.45
    QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, other_sku) <= 3
),
found AS (
    SELECT sku, string_agg(other_sku, '|' ORDER BY score DESC, other_sku) AS others FROM best GROUP BY 1
)
SELECT sku, product_url, coalesce(others, '') AS others FROM item LEFT JOIN found USING (sku)
UNION ALL SELECT page_sku, product_url, '' FROM single"""
)


def _by_url(left, right):
    return F.when(left["product_url"] < right["product_url"], -1).when(left["product_url"] > right["product_url"], 1).otherwise(0)


@query("catalog_run", RUN_SQL)
def catalog_run(spark, sf_dir):
    """Listings, pages and tag responses of all families through the whole job."""
    paired = product_pages(spark, sf_dir)
    seeds = spark.range(1).select(
        F.lit(0).alias("category_ord"), F.lit("All").alias("name"), F.lit("all").alias("url")
    )
    front = (
        f'<script>{fv.CATEGORY_MARKER} {{"isCategoryPage": true, "request": '
        '{"categoryId": 1, "level": 1, "path": "All"}};</script>'
    )
    responses = (
        paired.groupBy(F.expr("cast(regexp_extract(product_url, '([0-9]+)$', 1) div 50 as int)").alias("page_no"))
        .agg(F.array_sort(F.collect_list(F.struct("product_url", "hit")), _by_url).alias("hits"))
        .withColumn("hits", F.transform("hits", lambda x: x["hit"]))
        .select(
            F.lit("all").alias("category_url"),
            "page_no",
            (F.col("page_no") + 2).alias("nbPages"),
            F.lit(None).cast("string").alias("error"),
            "hits",
        )
    )
    tags = F.to_json(
        F.struct(F.col("p_type").alias("product_type"), F.split("p_name", " ").alias("attributes"))
    )
    answers = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("sku"),
        F.lit("tags").alias("kind"),
        tags.alias("payload"),
        F.lit(0).cast("bigint").alias("seq"),
    )
    root = scratch_path(spark, "catalog")
    catalog.run(
        spark,
        root,
        seeds=seeds,
        category_pages=seeds.select("url", F.lit(front).alias("html")),
        responses=responses,
        pages=paired.select(F.col("product_url").alias("url"), "html"),
        model_responses=answers,
        scraped_at=STAMP,
    )
    exported = spark.read.schema(
        "sku string, product_url string, alternative_products array<struct<sku string>>"
    ).json(f"{root}/products_json")
    return exported.select(
        "sku", "product_url", F.array_join("alternative_products.sku", "|").alias("others")
    )


# -- exports -----------------------------------------------------------------------

EXPORT_SQL = """
SELECT 'P' || p_partkey AS sku, p_retailprice AS price, p_brand AS brand, '["' || p_type || '"]' AS category_hierarchy,
       '2024-01-01T00:00:00.000000Z' AS scraped_at, CASE WHEN p_size > 45 THEN '1/box' END AS unit_pack_size,
       p_name AS variant
FROM part"""
EXPORT_FIELDS = "brand string, price double, scraped_at string, sku string, unit_pack_size string, "


@query("s10_json_export", EXPORT_SQL)
def s10(spark, sf_dir):
    path = scratch_path(spark, "export-json")
    write_json(products(spark, sf_dir), path)
    read = spark.read.schema(
        EXPORT_FIELDS + "category_hierarchy array<string>, specifications struct<variant:string>"
    ).json(path)
    return read.select(
        "sku", "price", "brand", F.to_json("category_hierarchy").alias("category_hierarchy"),
        "scraped_at", "unit_pack_size", "specifications.variant",
    )


@query("s11_csv_export", EXPORT_SQL)
def s11(spark, sf_dir):
    path = scratch_path(spark, "export-csv")
    rows = products(spark, sf_dir)
    write_csv(rows, path)
    names = sorted(c for c in rows.columns if c not in SIDE_COLUMNS)
    schema = ", ".join(f"{n} {'double' if n == 'price' else 'string'}" for n in names)
    read = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    return read.select(
        "sku", "price", "brand", "category_hierarchy", "scraped_at", "unit_pack_size",
        F.get_json_object("specifications", "$.variant").alias("variant"),
    )


@query(
    "x27_nested_as_json",
    """
SELECT 'P' || p_partkey AS sku, '["' || p_type || '"]' AS category_hierarchy, '[]' AS image_urls,
       '{"variant":"' || p_name || '"}' AS specifications
FROM part""",
)
def x27(spark, sf_dir):
    text = nested_as_json(export_view(products(spark, sf_dir)))
    return text.select("sku", "category_hierarchy", "image_urls", "specifications")


@query("o1_sorted_export", "SELECT 'P' || p_partkey AS sku, p_retailprice AS price FROM part ORDER BY 1")
def o1(spark, sf_dir):
    return products(spark, sf_dir).orderBy("sku").select("sku", "price")


@query("a9_exported_rows", "SELECT count(*) AS exported_rows FROM part")
def a9(spark, sf_dir):
    path = scratch_path(spark, "export-count")
    write_json(products(spark, sf_dir), path)
    return spark.read.schema("sku string").json(path).agg(F.count("*").alias("exported_rows"))


SUMMARY_SQL = (
    HITS_SQL
    + """
SELECT (SELECT count(DISTINCT category_url) FROM hits) AS categories_attempted,
       (SELECT count(DISTINCT product_url) FROM first_hit) AS product_pages_attempted,
       (SELECT count(*) FROM part) AS product_rows_exported,
       (SELECT count(*) FROM part WHERE p_size <= 5 OR p_brand = 'Brand#7') AS failures"""
)


def summary(spark, sf_dir):
    return run_summary(
        configs(spark, sf_dir),
        families(spark, sf_dir).select("product_url").distinct(),
        products(spark, sf_dir),
        rejected(check_required(named_parts(spark, sf_dir))),
    )


@query("a6_run_counters", SUMMARY_SQL)
def a6(spark, sf_dir):
    return summary(spark, sf_dir)


@query("s13_run_summary", SUMMARY_SQL)
def s13(spark, sf_dir):
    path = scratch_path(spark, "summary")
    summary(spark, sf_dir).coalesce(1).write.json(path)
    return spark.read.schema(
        "categories_attempted bigint, product_pages_attempted bigint, product_rows_exported bigint, failures bigint"
    ).json(path)


# -- streaming ---------------------------------------------------------------------


PAGE_SQL = "SELECT DISTINCT 'https://shop.test/item/' || f AS url, CAST(f % 2 AS BIGINT) AS batch_id FROM (SELECT p_partkey // 4 AS f FROM part)"


class PageStream:
    """Product pages that arrive in two steps: even families, then odd ones."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.folder, self.root = scratch_path(spark, "stream-pages"), scratch_path(spark, "stream-state")
        paired = materialize(product_pages(spark, sf_dir), "stream-paired")
        self.pages = paired.select(F.col("product_url").alias("url"), "html")
        place = F.struct(*[F.lit(0).alias(n) for n in ("category_ord", "page_no", "pos")])
        self.families = paired.select("product_url", "hit", "category_path", place.alias("place"))

    def arrive(self, part):
        number = F.substring_index("url", "/", -1).cast("bigint")
        self.pages.filter(number % 2 == part).write.mode("overwrite").parquet(f"{self.folder}/part={part}")

    def process(self, checkpoint, families=None):
        stream = page_stream(self.spark, f"{self.folder}/*")
        process_new_pages(stream, families or self.families, self.root, checkpoint, scraped_at=STAMP)


@query("t1_only_new_files", PAGE_SQL)
def t1(spark, sf_dir):
    """Which of the two arrivals took up each page; a call in between finds nothing new."""
    pages, checkpoint = PageStream(spark, sf_dir), scratch_path(spark, "stream-checkpoint")
    for part in (0, 1):
        pages.arrive(part)
        pages.process(checkpoint)
        pages.process(checkpoint)
    return state.read(spark, pages.root, "taken_up").select("url", "batch_id")


@query(
    "t2_repeated_batch",
    f"SELECT url, count(*) AS times FROM ({PAGE_SQL}) WHERE CAST(split_part(url, '/', 5) AS BIGINT) % 50 NOT IN (7, 9) GROUP BY 1",
)
def t2(spark, sf_dir):
    """Completed pages and how often they are stored, after the first batch was done again under
    its own number, and a second stream with new progress saw all files once more."""
    pages, checkpoint = PageStream(spark, sf_dir), scratch_path(spark, "stream-checkpoint")
    pages.arrive(0)
    pages.process(checkpoint, pages.families.limit(0))  # no listing yet: all pages wait
    pages.process(checkpoint)
    pages.arrive(1)
    pages.process(checkpoint)
    again = state.read(spark, pages.root, "taken_up").filter("batch_id = 1").select("writer").first()
    odd = spark.read.schema(schemas.PAGE).parquet(f"{pages.folder}/part=1")
    batch = state.begin_batch(spark, pages.root, again[0], 1)
    save_pages(odd, pages.families, pages.root, batch, scraped_at=STAMP)
    pages.process(scratch_path(spark, "stream-checkpoint"))
    return state.read(spark, pages.root, "completed").groupBy("url").agg(F.count("*").alias("times"))


@query(
    "t3_export_during_run",
    "SELECT 'P' || p_partkey AS sku, p_retailprice AS price FROM part WHERE p_size <= 45",
)
def t3(spark, sf_dir):
    """Only the first batch is saved yet; its rows can be exported."""
    root = scratch_path(spark, "partial")
    saved(spark, sf_dir, root, 0, "unit_pack_size is null")
    path = scratch_path(spark, "partial-export")
    write_json(state.latest_products(spark, root), path)
    return spark.read.schema("sku string, price double").json(path)


# -- quality -----------------------------------------------------------------------


@query(
    "q1_products_per_family",
    "SELECT 'u' || (p_partkey // 4) AS product_url, count(*) AS products FROM part GROUP BY 1",
)
def q1(spark, sf_dir):
    url = F.concat(F.lit("u"), F.expr("p_partkey div 4").cast("string"))
    return qu.products_per_family(table(spark, sf_dir, "part").select(url.alias("product_url")))


COVERAGE_SQL = """
WITH shares AS (
    SELECT p_brand AS brand, avg(CASE WHEN p_size > 45 THEN 1.0::DOUBLE ELSE 0 END) AS packed, count(*) AS n
    FROM part GROUP BY 1
)
"""


def coverage(spark, sf_dir):
    return qu.field_coverage(
        products(spark, sf_dir), "brand", fields=["unit_pack_size", "description", "specifications"]
    )


@query(
    "q2_missing_field_rate",
    COVERAGE_SQL
    + """
SELECT brand, 'unit_pack_size' AS field, round(1 - packed, 9) AS missing_rate FROM shares
UNION ALL SELECT brand, 'description', 1 FROM shares UNION ALL SELECT brand, 'specifications', 0 FROM shares""",
)
def q2(spark, sf_dir):
    return coverage(spark, sf_dir).select(
        "brand", "field", F.round("missing_rate", 9).alias("missing_rate")
    )


@query(
    "q3_field_coverage",
    COVERAGE_SQL
    + """
SELECT brand, 'unit_pack_size' AS field, round(packed, 9) AS coverage FROM shares
UNION ALL SELECT brand, 'description', 0 FROM shares UNION ALL SELECT brand, 'specifications', 1 FROM shares""",
)
def q3(spark, sf_dir):
    return coverage(spark, sf_dir).select("brand", "field", F.round("coverage", 9).alias("coverage"))


@query(
    "q4_duplicate_sku_rate",
    """
SELECT count(*) AS products, count(DISTINCT l_partkey) AS skus,
       round((count(*) - count(DISTINCT l_partkey)) / count(*)::DOUBLE, 9) AS duplicate_rate FROM lineitem""",
)
def q4(spark, sf_dir):
    skus = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("sku"))
    return qu.duplicate_sku_rate(skus).withColumn("duplicate_rate", F.round("duplicate_rate", 9))


@query(
    "q5_price_distribution",
    """
SELECT p_brand AS brand, count(*) AS priced, min(p_retailprice) AS least, max(p_retailprice) AS greatest,
       list_sort(list(p_retailprice))[CAST(ceil(count(*) * 0.25) AS INTEGER)] AS lower,
       list_sort(list(p_retailprice))[CAST(ceil(count(*) * 0.5) AS INTEGER)] AS middle,
       list_sort(list(p_retailprice))[CAST(ceil(count(*) * 0.75) AS INTEGER)] AS upper
FROM part GROUP BY 1""",
)
def q5(spark, sf_dir):
    found = qu.price_distribution(products(spark, sf_dir), "brand")
    return found.select(
        "brand", "priced", "least", "greatest",
        *[F.element_at("quartiles", i).alias(n) for i, n in enumerate(("lower", "middle", "upper"), 1)],
    )


@query(
    "q5_availability_distribution",
    "SELECT o_orderstatus AS availability, count(*) AS products FROM orders GROUP BY 1",
)
def q5b(spark, sf_dir):
    return qu.availability_distribution(
        table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("availability"))
    )


@query(
    "q1_products_per_family_by_brand",
    "SELECT p_brand AS brand, 'u' || (p_partkey // 4) AS product_url, count(*) AS products FROM part GROUP BY 1, 2",
)
def q1_keyed(spark, sf_dir):
    url = F.concat(F.lit("u"), F.expr("p_partkey div 4").cast("string"))
    rows = table(spark, sf_dir, "part").select(url.alias("product_url"), F.col("p_brand").alias("brand"))
    return qu.products_per_family(rows, "brand")


@query(
    "q4_duplicate_sku_rate_by_flag",
    """
SELECT l_returnflag AS flag, count(*) AS products, count(DISTINCT l_partkey) AS skus,
       round((count(*) - count(DISTINCT l_partkey)) / count(*)::DOUBLE, 9) AS duplicate_rate FROM lineitem GROUP BY 1""",
)
def q4_keyed(spark, sf_dir):
    skus = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("sku"), F.col("l_returnflag").alias("flag"))
    return qu.duplicate_sku_rate(skus, "flag").withColumn("duplicate_rate", F.round("duplicate_rate", 9))


@query(
    "q5_price_distribution_with_outliers",
    """
WITH lines AS (SELECT l_linestatus AS status, CASE WHEN l_orderkey % 1000 = 1 THEN 1e12 ELSE l_extendedprice END AS price FROM lineitem)
SELECT status, count(*) AS priced, min(price) AS least, max(price) AS greatest,
       list_sort(list(price))[CAST(ceil(count(*) * 0.25) AS INTEGER)] AS lower,
       list_sort(list(price))[CAST(ceil(count(*) * 0.5) AS INTEGER)] AS middle,
       list_sort(list(price))[CAST(ceil(count(*) * 0.75) AS INTEGER)] AS upper
FROM lines GROUP BY 1""",
)
def q5_outliers(spark, sf_dir):
    price = F.when(F.col("l_orderkey") % 1000 == 1, 1e12).otherwise(F.col("l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), price.alias("price"))
    found = qu.price_distribution(lines, "status")
    return found.select(
        "status", "priced", "least", "greatest",
        *[F.element_at("quartiles", i).alias(n) for i, n in enumerate(("lower", "middle", "upper"), 1)],
    )


@query(
    "q5_availability_by_priority",
    "SELECT o_orderpriority AS priority, o_orderstatus AS availability, count(*) AS products FROM orders GROUP BY 1, 2",
)
def q5b_keyed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("availability"), F.col("o_orderpriority").alias("priority"))
    return qu.availability_distribution(rows, "priority")


LEDGER_SQL = """
WITH item AS (SELECT p_type AS category, CASE WHEN p_size > 20 THEN '2' ELSE '1' END AS parser_version, p_size FROM part)
SELECT category, parser_version, CAST(count(*) AS DOUBLE) AS current_value,
       CAST(count(*) FILTER (p_size > 45 OR p_size <= 3) AS DOUBLE) AS previous_value,
       CAST(count(*) - count(*) FILTER (p_size > 45 OR p_size <= 3) AS DOUBLE) AS change
FROM item GROUP BY 1, 2"""


@query("q6_change_from_the_ledger", LEDGER_SQL)
def q6_ledger(spark, sf_dir):
    """Two runs are recorded; the change of the product counts comes from the ledger alone."""
    sizes = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku"), "p_size")
    version = F.when(F.col("p_size") > 20, "2").otherwise("1").alias("parser_version")
    rows = products(spark, sf_dir).join(sizes, "sku").withColumn("parser_version", version)
    root = scratch_path(spark, "ledger")
    for some in (rows.filter("p_size > 45 or p_size <= 3"), rows):
        ledger.record(spark, root, ledger.product_metrics(some))
    return ledger.change(spark, root)


@query(
    "s13_metrics_of_a_run",
    """
SELECT 'products' AS metric, p_type AS category, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY ALL
UNION ALL SELECT 'price_middle', p_type, list_sort(list(p_retailprice))[CAST(ceil(count(*) * 0.5) AS INTEGER)] FROM part GROUP BY ALL
UNION ALL SELECT 'missing_rate:unit_pack_size', p_type, round(avg(CASE WHEN p_size > 45 THEN 0.0::DOUBLE ELSE 1 END), 9) FROM part GROUP BY ALL""",
)
def s13_metrics(spark, sf_dir):
    root = scratch_path(spark, "ledger")
    rows = products(spark, sf_dir).withColumn("parser_version", F.lit(schemas.PARSER_VERSION))
    ledger.record(spark, root, ledger.product_metrics(rows))
    wanted = F.col("metric").isin("products", "price_middle", "missing_rate:unit_pack_size")
    return ledger.as_of(spark, root).where(wanted).select("metric", "category", F.round("value", 9).alias("value"))


@query(
    "q6_count_change",
    """
SELECT p_brand AS brand, count(*) AS current_rows, count(*) FILTER (p_size > 45) AS previous_rows,
       count(*) - count(*) FILTER (p_size > 45) AS change
FROM part GROUP BY 1""",
)
def q6(spark, sf_dir):
    now = products(spark, sf_dir)
    return qu.count_change(now, now.filter("unit_pack_size is not null"), "brand")


@query(
    "q7_json_parse_quality",
    """
SELECT event_type, count(*) AS documents, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 9) AS failure_rate,
       1::BIGINT AS key_sets
FROM events GROUP BY 1""",
)
def q7(spark, sf_dir):
    cut = F.when(F.col("value") > 50, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    texts = table(spark, sf_dir, "events").select("event_type", cut.alias("props"))
    return qu.json_parse_quality(texts, "props", "event_type").withColumn(
        "failure_rate", F.round("failure_rate", 9)
    )
