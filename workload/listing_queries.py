"""Search hits, categories, limits and pending pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.operators import listings as li
from skuloom.session import scratch_path
from skuloom.sources import readers
from workload.registry import query, table
from workload.standins import HITS_SQL, order_categories, order_hits, order_responses

LIMIT = 200


def families(spark, sf_dir):
    hits = li.attach_category(order_hits(spark, sf_dir), order_categories(spark, sf_dir))
    return li.first_in_category(li.with_family_url(hits))


def listed(df):
    return df.select(
        "category_url", "page_no", "pos", F.col("hit.objectID").alias("object_id"), "product_url"
    )


def completed(spark, sf_dir):
    """Customers with a negative balance count as finished."""
    url = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(url.alias("url"))


COMPLETED_SQL = "SELECT 'c' || c_custkey AS url FROM customer WHERE c_acctbal < 0"
LISTED = "category_url, page_no, pos, object_id, product_url"


@query(
    "s1_category_seeds",
    """
SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS category_ord,
       'Orders ' || o_orderpriority AS name, o_orderpriority AS url
FROM (SELECT DISTINCT o_orderpriority FROM orders)""",
)
def s1(spark, sf_dir):
    seed = F.struct(
        F.col("category_url").alias("url"), F.concat(F.lit("Orders "), "category_url").alias("name")
    )
    path = scratch_path(spark, "seeds")
    order_categories(spark, sf_dir).agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(seed)).alias("categories"))).alias("value")
    ).write.text(path)
    return readers.read_seeds(spark, path)


def written_responses(spark, sf_dir):
    path = scratch_path(spark, "responses")
    found = order_responses(spark, sf_dir)
    hits = F.transform(
        "found",
        lambda h: F.struct(
            h["id"].alias("objectID"), h["url"].alias("url"), h["family_url"].alias("family_url")
        ),
    )
    found.withColumn("hits", hits).drop("found").write.json(path)
    return readers.read_search_responses(spark, path)


RESPONSES_SQL = """
WITH hit AS (
    SELECT o_orderpriority AS category_url, CAST(o_orderkey // 50 AS INTEGER) AS page_no,
           CAST(row_number() OVER (PARTITION BY o_orderpriority, o_orderkey // 50 ORDER BY o_orderkey) - 1
                AS INTEGER) AS pos,
           'O' || o_orderkey AS object_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS digit,
           max(o_orderkey // 50) OVER (PARTITION BY o_orderpriority) AS last
    FROM orders
)
"""


@query(
    "s2_search_hits",
    RESPONSES_SQL
    + "SELECT category_url, page_no, pos, object_id FROM hit WHERE NOT (digit = 3 AND page_no = last // 2)",
)
def s2(spark, sf_dir):
    return li.hits_of(written_responses(spark, sf_dir)).select(
        "category_url", "page_no", "pos", F.col("hit.objectID").alias("object_id")
    )


@query(
    "o4_page_bounds",
    RESPONSES_SQL
    + """
SELECT category_url, page_no, count(*) AS hits FROM hit
WHERE page_no < CASE digit WHEN 3 THEN last // 2 ELSE last - digit END GROUP BY ALL""",
)
def o4(spark, sf_dir):
    bounded = li.pages_in_bounds(written_responses(spark, sf_dir))
    return bounded.select("category_url", "page_no", F.size("hits").cast("bigint").alias("hits"))


@query("p1_family_url", HITS_SQL + "SELECT object_id, product_url FROM hits")
def p1(spark, sf_dir):
    hits = order_hits(spark, sf_dir)
    return hits.select(
        F.col("hit.objectID").alias("object_id"), li.family_url(F.col("hit")).alias("product_url")
    )


@query(
    "p2_hits_with_url",
    HITS_SQL + "SELECT object_id, product_url FROM hits WHERE product_url IS NOT NULL",
)
def p2(spark, sf_dir):
    return li.with_family_url(order_hits(spark, sf_dir)).select(
        F.col("hit.objectID").alias("object_id"), "product_url"
    )


@query(
    "p3_category_facet",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IS NOT NULL",
)
def p3(spark, sf_dir):
    config = {"category_level": F.lit(1), "category_path": F.lit("R")}
    lines = table(spark, sf_dir, "lineitem").withColumns(config)
    return lines.filter(li.in_category(lines, {0: "l_linestatus", 1: "l_returnflag"})).select("l_orderkey", "l_linenumber")


@query(
    "p3_list_facet",
    """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_linenumber % 2 = 0 AND l_returnflag = 'R') OR (l_linenumber % 2 = 1 AND 'F' IN (l_returnflag, l_linestatus))""",
)
def p3_list(spark, sf_dir):
    """A category of its own for each line: at level 0 one value, at level 1 a list of them."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {
            "flags": F.array("l_returnflag", F.lit(None).cast("string"), "l_linestatus"),
            "category_level": F.col("l_linenumber") % 2,
            "category_path": F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("F"),
        }
    )
    return lines.filter(li.in_category(lines, {0: "l_returnflag", 1: "flags"})).select("l_orderkey", "l_linenumber")


def category_pages(spark, sf_dir):
    """A page per priority; the fourth is no category page, the fifth has bad JSON."""
    digit = F.left("category_url", F.lit(1))
    html = F.concat(
        F.lit(f'<script>\n{fv.CATEGORY_MARKER} {{"isCategoryPage": '),
        F.when(digit == "4", "false").otherwise("true"),
        F.lit(', "request": {"categoryId": '), digit,
        F.lit(', "level": 1, "path": "Orders /// '), "category_url",
        F.when(digit == "5", "").otherwise('"}};'), F.lit("</script>"),
    )
    return order_categories(spark, sf_dir).select(F.col("category_url").alias("url"), html.alias("html"))


def configs(spark, sf_dir):
    seeds = order_categories(spark, sf_dir).select(F.col("category_url").alias("url"), "category_ord")
    return li.category_configs(seeds, category_pages(spark, sf_dir))


@query(
    "p4_category_pages",
    """
SELECT p AS category_url, CASE left(p, 1) WHEN '5' THEN NULL ELSE 'Orders /// ' || p END AS category_path,
       CASE left(p, 1) WHEN '5' THEN NULL ELSE left(p, 1) END AS category_id,
       CASE left(p, 1) WHEN '4' THEN 'not a live category page: ' || p
                       WHEN '5' THEN 'search configuration is not valid JSON' END AS error
FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)""",
)
def p4(spark, sf_dir):
    return configs(spark, sf_dir).select("category_url", "category_path", "category_id", "error")


@query(
    "p5_category_path",
    HITS_SQL
    + """
SELECT object_id, 'Orders /// ' || category_url AS category_path FROM hits WHERE category_ord < 4""",
)
def p5(spark, sf_dir):
    usable = li.usable_configs(configs(spark, sf_dir))
    return li.attach_category(order_hits(spark, sf_dir), usable).select(
        F.col("hit.objectID").alias("object_id"), "category_path"
    )


@query(
    "j4_hits_to_categories",
    HITS_SQL + "SELECT category_url, category_ord, count(*) AS hits FROM hits GROUP BY ALL",
)
def j4(spark, sf_dir):
    joined = li.attach_category(order_hits(spark, sf_dir), order_categories(spark, sf_dir))
    return joined.groupBy("category_url", "category_ord").agg(F.count("*").alias("hits"))


@query("a1_first_hit_per_category", HITS_SQL + f"SELECT {LISTED} FROM first_hit")
def a1(spark, sf_dir):
    return listed(families(spark, sf_dir))


@query(
    "w1_limit_per_category",
    HITS_SQL
    + f"""
SELECT {LISTED} FROM first_hit
QUALIFY row_number() OVER (PARTITION BY category_url ORDER BY page_no, pos) <= {LIMIT}""",
)
def w1(spark, sf_dir):
    return listed(li.limit_per_category(families(spark, sf_dir), LIMIT))


@query(
    "a2_first_category_per_url",
    HITS_SQL
    + f"""
SELECT {LISTED} FROM first_hit
QUALIFY row_number() OVER (PARTITION BY product_url ORDER BY category_ord, page_no, pos) = 1""",
)
def a2(spark, sf_dir):
    return listed(li.first_across_categories(families(spark, sf_dir)))


@query(
    "j2_pending_pages",
    HITS_SQL
    + f"""
SELECT {LISTED} FROM (
    SELECT * FROM first_hit
    QUALIFY row_number() OVER (PARTITION BY product_url ORDER BY category_ord, page_no, pos) = 1)
WHERE product_url NOT IN ({COMPLETED_SQL})""",
)
def j2(spark, sf_dir):
    first = li.first_across_categories(families(spark, sf_dir))
    return listed(li.not_completed(first, completed(spark, sf_dir)))


@query(
    "w3_ranked_candidates",
    HITS_SQL
    + """
SELECT category_url, product_url, CAST(row_number() OVER
       (PARTITION BY product_url ORDER BY category_ord, page_no, pos) AS INTEGER) AS attempt
FROM first_hit""",
)
def w3(spark, sf_dir):
    return li.ranked_across_categories(families(spark, sf_dir)).select(
        "category_url", "product_url", "attempt"
    )


@query(
    "u5_all_categories_together",
    HITS_SQL + "SELECT category_url, count(*) AS families FROM first_hit GROUP BY 1",
)
def u5(spark, sf_dir):
    return families(spark, sf_dir).groupBy("category_url").agg(F.count("*").alias("families"))
