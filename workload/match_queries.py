"""Similar products."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.functions import similarity as sim
from skuloom.operators.match import similar_products
from workload.registry import query, table
from workload.standins import MATCH_SQL, match_products

TOP = """
, top AS (
    SELECT *, row_number() OVER (PARTITION BY sku ORDER BY score DESC, other_sku) AS place
    FROM scored WHERE score >= {low}
    QUALIFY place <= {k}
)
"""
REASON = "'Shared normalized tags: ' || array_to_string(shared, ', ')"


def alternatives(spark, sf_dir, **options):
    """One row per product and alternative."""
    df = similar_products(match_products(spark, sf_dir), **options)
    return df.select("sku", F.posexplode("alternative_products").alias("place", "a")).select(
        "sku",
        (F.col("place") + 1).cast("bigint").alias("place"),
        F.col("a.sku").alias("other_sku"),
        F.col("a.product_url").alias("other_url"),
        F.col("a.product_name").alias("other_name"),
        F.col("a.score").alias("score"),
        F.col("a.reason").alias("reason"),
        F.col("a.source").alias("source"),
        F.col("a.method").alias("method"),
    )


@query(
    "j5_similar_products",
    MATCH_SQL
    + TOP.format(low=0.45, k=3)
    + f"""
SELECT sku, place, other_sku, other_url, other_name, score, {REASON} AS reason,
       'inferred' AS source, 'llm_normalized_tags_v1' AS method FROM top""",
)
def j5(spark, sf_dir):
    return alternatives(spark, sf_dir)


@query(
    "w2_top_candidates",
    MATCH_SQL + TOP.format(low=0.45, k=7) + "SELECT sku, place, other_sku, score FROM top",
)
def w2(spark, sf_dir):
    return alternatives(spark, sf_dir, max_alternatives=7).select("sku", "place", "other_sku", "score")


@query(
    "p12_score_threshold",
    MATCH_SQL + TOP.format(low=0.6, k=3) + "SELECT sku, other_sku, score FROM top",
)
def p12(spark, sf_dir):
    return alternatives(spark, sf_dir, min_score=0.6).select("sku", "other_sku", "score")


@query(
    "a8_collected_alternatives",
    MATCH_SQL
    + TOP.format(low=0.72, k=3)
    + """
SELECT item.sku, coalesce(string_agg(other_sku || ':' || printf('%.4f', score), '|' ORDER BY place), '') AS found
FROM item LEFT JOIN top USING (sku) GROUP BY 1""",
)
def a8(spark, sf_dir):
    df = similar_products(match_products(spark, sf_dir), min_score=0.72)
    text = F.transform(
        "alternative_products",
        lambda a: F.concat(a["sku"], F.lit(":"), F.format_number(a["score"], 4)),
    )
    return df.select("sku", F.array_join(text, "|").alias("found"))


@query(
    "p11_ineligible_products",
    """
WITH item AS (
    SELECT CASE WHEN p_size > 5 THEN 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE 'Q' || p_partkey END AS sku,
           CASE WHEN p_size > 10 THEN 'u' || (p_partkey // 4) END AS url,
           CASE WHEN p_size > 45 THEN [] ELSE list_sort(string_split(p_name, ' ')) END AS tags,
           lower(p_type) AS leaf, lower(p_brand) AS brand
    FROM part
),
scored AS (
    SELECT a.sku, b.sku AS other_sku, CAST(printf('%.4f', 0.65::DOUBLE * (len(list_intersect(a.tags, b.tags))::DOUBLE
               / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags))))
               + 0.25::DOUBLE * CAST(a.leaf = b.leaf AS INTEGER) + 0.10::DOUBLE * CAST(a.brand = b.brand AS INTEGER)) AS DOUBLE) AS score
    FROM item a JOIN item b ON a.sku IS DISTINCT FROM b.sku AND a.url IS DISTINCT FROM b.url
     AND len(a.tags) > 0 AND len(b.tags) > 0
)
SELECT sku, other_sku, score FROM scored WHERE score >= 0.45
QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, other_sku) <= 3""",
)
def p11(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    products = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") > 5, F.concat(F.lit("P"), F.lpad(key, 9, "0")))
        .otherwise(F.concat(F.lit("Q"), key))
        .alias("sku"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("u"), F.expr("p_partkey div 4").cast("string"))).alias("product_url"),
        F.col("p_brand").alias("brand"),
        F.array("p_type").alias("category_hierarchy"),
        F.when(F.col("p_size") <= 45, F.split("p_name", " ")).alias("normalized_tags"),
    )
    return similar_products(products).select("sku", F.explode("alternative_products").alias("a")).select(
        "sku", F.col("a.sku").alias("other_sku"), F.col("a.score").alias("score")
    )


# Every part beside the next one: the score's ingredients, one pair per part.


def neighbours(spark, sf_dir):
    part = table(spark, sf_dir, "part")

    def side(prefix, key):
        tags = F.concat(
            F.split("p_name", " "), F.array("p_type", F.concat(F.lit("s"), F.col("p_size").cast("string")))
        )
        return part.select(
            key.alias("p_partkey"),
            sim.tag_set(tags).alias(f"{prefix}_tags"),
            sim.leaf_category(F.array(F.lit("All"), F.col("p_type"))).alias(f"{prefix}_leaf"),
            sim.brand_key(F.when(F.col("p_size") > 3, F.col("p_brand"))).alias(f"{prefix}_brand"),
        )

    return side("a", F.col("p_partkey")).join(side("b", F.col("p_partkey") - 1), "p_partkey")


NEIGHBOUR_SQL = """
WITH side AS (
    SELECT p_partkey, list_distinct(list_concat(string_split(p_name, ' '), [p_type, 's' || p_size])) AS tags,
           lower(p_type) AS leaf, CASE WHEN p_size > 3 THEN lower(p_brand) END AS brand
    FROM part
),
pair AS (
    SELECT a.p_partkey, list_sort(list_intersect(a.tags, b.tags)) AS shared,
           list_sort(list_distinct(list_concat(a.tags, b.tags))) AS both_tags,
           CAST(a.leaf = b.leaf AS INTEGER) AS same_leaf,
           CAST(coalesce(a.brand = b.brand, false) AS INTEGER) AS same_brand
    FROM side a JOIN side b ON a.p_partkey = b.p_partkey - 1
)
"""


@query(
    "m1_score",
    NEIGHBOUR_SQL
    + """
SELECT p_partkey, CAST(printf('%.4f', 0.65::DOUBLE * (len(shared)::DOUBLE / len(both_tags))
       + 0.25::DOUBLE * same_leaf + 0.10::DOUBLE * same_brand) AS DOUBLE) AS score FROM pair""",
)
def m1(spark, sf_dir):
    shared = F.size(F.array_intersect("a_tags", "b_tags"))
    raw = sim.raw_score(
        shared,
        F.size("a_tags") + F.size("b_tags") - shared,
        sim.same_leaf(F.col("a_leaf"), F.col("b_leaf")),
        sim.same_brand(F.col("a_brand"), F.col("b_brand")),
    )
    return neighbours(spark, sf_dir).select("p_partkey", sim.rounded(raw).alias("score"))


@query(
    "u1_tag_intersection_and_union",
    NEIGHBOUR_SQL
    + """
SELECT p_partkey, array_to_string(shared, ',') AS shared, array_to_string(both_tags, ',') AS both_tags FROM pair""",
)
def u1(spark, sf_dir):
    return neighbours(spark, sf_dir).select(
        "p_partkey",
        F.array_join(sim.shared_tags(F.col("a_tags"), F.col("b_tags")), ",").alias("shared"),
        F.array_join(F.array_sort(F.array_union("a_tags", "b_tags")), ",").alias("both_tags"),
    )


@query("o3_sorted_shared_tags", NEIGHBOUR_SQL + "SELECT p_partkey, array_to_string(shared, ',') AS shared FROM pair WHERE len(shared) > 0")
def o3(spark, sf_dir):
    shared = sim.shared_tags(F.col("a_tags"), F.col("b_tags"))
    return (
        neighbours(spark, sf_dir)
        .select("p_partkey", shared.alias("shared"))
        .filter(F.size("shared") > 0)
        .select("p_partkey", F.array_join("shared", ",").alias("shared"))
    )


@query(
    "x26_reason",
    NEIGHBOUR_SQL
    + """
SELECT p_partkey, CASE WHEN len(shared) > 0 THEN 'Shared normalized tags: ' || array_to_string(shared, ', ')
       ELSE 'Same catalog category' END AS reason FROM pair""",
)
def x26(spark, sf_dir):
    shared = sim.shared_tags(F.col("a_tags"), F.col("b_tags"))
    return neighbours(spark, sf_dir).select("p_partkey", sim.reason(shared).alias("reason"))


@query("x25_leaf_category", "SELECT p_partkey, CASE WHEN p_size > 5 THEN lower(p_type) ELSE '' END AS leaf FROM part")
def x25(spark, sf_dir):
    path = F.when(F.col("p_size") > 5, F.array(F.lit("Top"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", sim.leaf_category(path).alias("leaf"))
