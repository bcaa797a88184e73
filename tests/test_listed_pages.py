"""All listings of a page in one pass, and pages stored by URL."""

import pytest
from page_samples import LAMP_CRUMBS, LAMP_LD, LAMP_VARIANTS, page
from pyspark.sql import functions as F

from skuloom import schemas
from skuloom.operators import extract as ex
from skuloom.operators.prefilter import possible_keys
from skuloom.sources import page_table

HIT = schemas.HIT.split(", ")
NO_PRICE = {k: v for k, v in LAMP_LD.items() if k != "offers"}
PAGES = [
    ("plain", page(LAMP_LD, LAMP_CRUMBS)),
    ("variants", page(LAMP_LD, LAMP_CRUMBS, variants=LAMP_VARIANTS)),
    ("hit price", page(NO_PRICE)),
    ("no crumbs", page(NO_PRICE, variants=LAMP_VARIANTS)),
    ("broken", page(LAMP_LD, variants="{")),
    ("unlisted", page(LAMP_LD)),
]
# url, attempt, price of the listing, name
LISTINGS = [
    ("plain", 1, '"$1.2.3"', "a"), ("plain", 2, "7", "b"),
    ("variants", 1, '"$1.2.3"', "c"), ("variants", 2, "7", "d"),
    ("hit price", 2, '"$1.2.3"', "e"), ("hit price", 1, '"1.2.3.4"', "f"), ("hit price", 3, '{"USD": "$12"}', "g"), ("hit price", 4, "1", "h"),
    ("no crumbs", 1, '"x"', "i"),
    ("broken", 1, "1", "j"), ("broken", 2, "2", "k"),
    ("gone", 1, "1", "l"), ("gone", 2, "2", "m"),
]


def families(spark):
    rows = spark.createDataFrame(LISTINGS, "product_url string, attempt int, price string, name string")
    fields = []
    for field in HIT:
        name, kind = field.split()
        value = {"price": "parse_json(price)", "name": "name", "sku": "parse_json(concat('\"', name, '\"'))"}.get(name, "null")
        fields.append(f"'{name}', cast({value} as {kind})")
    return rows.selectExpr("product_url", "attempt", f"named_struct({', '.join(fields)}) as hit", "concat('C /// ', name) as category_path")


def rows_of(df):
    columns = ("product_url", "attempt", "page_error", "ordinal", "sku", "price", "product_name")
    plain = df.select(*columns, F.to_json("category_hierarchy").alias("path"), F.to_json("image_urls").alias("images")).collect()
    return sorted((tuple(r) if r.page_error is None else (r.product_url, r.attempt, r.page_error) for r in plain), key=repr)


def attempt_by_attempt(spark):
    """Every listing with its page, the next only for URLs that failed."""
    pages = spark.createDataFrame(PAGES, schemas.PAGE)
    todo, rows = families(spark).where("attempt = 1"), []
    for attempt in (1, 2, 3, 4):
        found = ex.extract_products(ex.attach_pages(todo, pages), keep=("attempt",))
        rows += rows_of(found)
        failed = [r.product_url for r in found.where("page_error is not null").collect()]
        todo = families(spark).where((F.col("attempt") == attempt + 1) & F.col("product_url").isin(*failed, "-"))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_one_pass_equals_attempt_after_attempt(spark, tmp_path, stored):
    pages = spark.createDataFrame(PAGES, schemas.PAGE)
    if stored:
        pages = page_table.write_pages(pages, str(tmp_path / "pages"), 3)
    paired = ex.attach_listings(ex.listings_of(families(spark)), pages)
    got = rows_of(ex.extract_listed(paired, keep=("attempt",)))
    assert got == attempt_by_attempt(spark)
    errors = [r for r in got if len(r) == 3]
    assert [(r[0], r[1]) for r in errors if r[0] == "hit price"] == [("hit price", 1), ("hit price", 2)]
    assert [r[5] for r in got if r[0] == "hit price" and len(r) > 3] == [12.0]


def test_page_table(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [("a", "1"), ("a", "2"), (None, "x"), ("b", None)]
    table = page_table.write_pages(spark.createDataFrame(rows, schemas.PAGE), path, 2)
    assert sorted(map(tuple, table.collect())) == [("a", "2"), ("b", None)]
    spark.sql(f"DROP TABLE {page_table._name(path)}")  # as in another session
    assert page_table.read_pages(spark, path).count() == 2
    replaced = page_table.write_pages(spark.createDataFrame([("c", "3")], schemas.PAGE), path, 5)
    assert [tuple(r) for r in replaced.collect()] == [("c", "3")]
    with pytest.raises(ValueError):
        page_table.read_pages(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        page_table.write_pages(replaced, path, 0)
    assert page_table.write_pages(spark.createDataFrame([], schemas.PAGE), str(tmp_path / "empty"), 2).count() == 0


@pytest.mark.parametrize("bits", [1, 64, 1 << 16])
def test_possible_keys_keeps_all_partners(spark, bits):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "key string, id long")
    )
    wanted = rows.where("id % 50 = 0").select("key")
    kept = possible_keys(rows, "key", wanted, bits)
    assert kept.columns == ["key", "id"]
    ids = [r.id for r in kept.collect()]
    assert set(range(0, 1000, 50)) <= set(ids) and len(ids) == len(set(ids)) and -1 not in ids
    assert len(ids) == 1000 if bits == 1 else len(ids) < 500
    assert possible_keys(rows, "key", wanted.limit(0), bits).count() == 0
