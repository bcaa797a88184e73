"""Physical plans that have to stay as they are for large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from skuloom.operators import extract as ex
from skuloom.operators import listings as li
from skuloom.operators import validate as va
from skuloom.operators.dedup import latest_per_key
from skuloom.session import materialize, scratch_path
from skuloom.sources import page_table
from workload.listing_queries import families
from workload.standins import product_pages
from workload.registry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_hit_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(families(spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    first = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
    assert text.index("Exchange") < first


def test_latest_row_is_reduced_before_the_shuffle(spark, sf_dir):
    text = plan(latest_per_key(table(spark, sf_dir, "events"), "user_id", F.col("event_id")))
    assert "partial_max_by" in text and text.count("Exchange") == 1


def test_validation_reuses_the_placement_of_the_page_join(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paired = product_pages(spark, sf_dir)
        listings = paired.select("product_url", "hit", "category_path")
        pages = paired.select(F.col("product_url").alias("url"), "html")
        joined = ex.attach_pages(listings, pages)
        rows = va.accepted(va.check_required(ex.good_rows(ex.extract_products(joined))))
        exchanges = plan(joined).count("Exchange hashpartitioning(product_url")
        assert plan(rows).count("Exchange hashpartitioning(product_url") == exchanges == 2
        assert plan(rows).count("ArrowEvalPython") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_page_is_parsed_once(spark, sf_dir):
    text = plan(ex.good_rows(ex.extract_products(product_pages(spark, sf_dir))))
    # one list of script matches; two uses of the other markers' positions each
    assert text.count("regexp_extract_all(html") == 1


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("url")
    )
    text = plan(li.not_completed(families(spark, sf_dir), done))
    assert "LeftAnti" in text
    assert re.search(r"PushedFilters: \[IsNotNull\(c_acctbal\), LessThan\(c_acctbal,0.0\)", text)
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_products_without_tags_stay_out_of_the_closing_join(spark, sf_dir):
    from skuloom.operators.match import similar_products
    from workload.standins import match_products

    products = match_products(spark, sf_dir).withColumn(
        "normalized_tags", F.when(F.col("sku") < "P000000020", F.col("normalized_tags")).otherwise(F.array().cast("array<string>"))
    )
    text = plan(similar_products(products))
    # the join's own side drops the products without a feature before it is shuffled
    assert text.count("Union") >= 1 and "isnotnull(fid" in text


def listed_families(spark, sf_dir):
    place = F.struct(*[F.lit(0).alias(n) for n in ("category_ord", "page_no", "pos")])
    paired = product_pages(spark, sf_dir)
    families = paired.select("product_url", "hit", "category_path", F.lit(1).alias("attempt"), place.alias("place"))
    return materialize(families, "listings"), paired.select(F.col("product_url").alias("url"), "html")


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def depth(line):
    return len(line) - len(line.lstrip(" :+-*()0123456789"))


def exchanges_of_documents(text):
    """Exchanges that a scan of documents (html) lies below of."""
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines):
        if "Exchange" not in line:
            continue
        below = []
        for under in lines[i + 1 :]:
            if depth(under) <= depth(line):
                break
            below.append(under)
        if any("Scan parquet" in u and "html" in u.split("ReadSchema")[-1] for u in below):
            found.append(line.strip())
    return found


def test_stored_pages_are_not_shuffled(spark, sf_dir, without_broadcasts):
    families, pages = listed_families(spark, sf_dir)
    listed = ex.listings_of(families)
    plain = materialize(pages, "plain-pages")
    assert exchanges_of_documents(plan(ex.attach_listings(listed, plain)))
    stored = page_table.write_pages(pages, scratch_path(spark, "pages"), 4)
    joined = ex.attach_listings(listed, stored)
    assert not exchanges_of_documents(plan(joined))
    assert not exchanges_of_documents(plan(ex.extract_listed(joined, keep=("place",))))
    # the table is found again, also by name only
    again = page_table.read_pages(spark, stored.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:"))
    assert again.count() == pages.count() == joined.where("html is not null").count()


def test_few_listings_leave_the_documents_in_place(spark, sf_dir):
    families, pages = listed_families(spark, sf_dir)
    joined = ex.attach_listings(ex.listings_of(families), materialize(pages, "plain-pages"))
    joined.write.format("noop").mode("overwrite").save()  # sizes are known when it runs
    joined.collect()
    assert not exchanges_of_documents(plan(joined).split("Initial Plan")[0])


def test_pages_are_scanned_once_for_all_listings(spark, sf_dir):
    families, pages = listed_families(spark, sf_dir)
    twice = families.unionByName(families.withColumn("attempt", F.lit(2)))
    stored = materialize(pages, "plain-pages")
    text = plan(ex.extract_listed(ex.attach_listings(ex.listings_of(twice), stored), keep=("place", "attempt")))
    scans = [line for line in text.split("\n") if "Scan parquet" in line and "ReadSchema: struct<url:string,html:string>" in line]
    assert len(scans) == 1 and text.count("regexp_extract_all(html") == 1


def test_page_bounds_keep_the_hits_in_place(spark, sf_dir):
    from workload.listing_queries import written_responses

    text = plan(li.pages_in_bounds(written_responses(spark, sf_dir)))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning(category_url") == 1
