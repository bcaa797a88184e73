import copy
import datetime
import re
import tracemalloc

import pyarrow as pa
from page_samples import LAMP_CRUMBS, LAMP_LD, LAMP_PAGE, LAMP_URL, LAMP_VARIANTS, page
from pyspark.sql import functions as F

from skuloom.functions import text as tx
from skuloom.functions.prices import nested_prices
from skuloom.operators import extract as ex
from skuloom.operators import validate as va
from skuloom.schemas import HIT
from workload.standins import extracted

HIT_FIELDS = [f.split()[0] for f in HIT.split(", ")]


def paired(spark, *rows):
    """rows: (url, html, hit dict, category path)"""
    data = []
    for url, html, hit, path in rows:
        hit = dict(hit)
        sku, price = hit.pop("sku", None), hit.pop("price", None)
        data.append((url, html, path, sku, price, *[hit.get(f) for f in HIT_FIELDS]))
    schema = "product_url string, html string, category_path string, j_sku string, j_price string, "
    schema += ", ".join(f"h_{f} string" for f in HIT_FIELDS)
    df = spark.createDataFrame(data, schema)
    cols = {f: F.col(f"h_{f}") for f in HIT_FIELDS}
    cols["sku"], cols["price"] = F.parse_json("j_sku"), F.parse_json("j_price")
    return df.select(
        "product_url",
        "html",
        "category_path",
        F.struct(*[c.alias(f) for f, c in cols.items()]).alias("hit"),
    )


def rows(spark, *pairs):
    out = ex.extract_products(paired(spark, *pairs), scraped_at="2024-01-01 00:00:00")
    return {(r.product_url, r.ordinal): r for r in out.collect()}


LISTING = {"objectID": "lamp-set", "manufacturer_name": "Wholesaler"}


def test_grouped_page_gives_variant_row(spark):
    (row,) = rows(spark, (LAMP_URL, LAMP_PAGE, LISTING, "Outdoor /// Lamps")).values()
    assert row.page_error is None
    assert (row.parent_sku, row.sku, row.source_product_id) == ("NRL", "NRL-AM", "8")
    assert (row.product_name, row.brand) == ("Night rider lamp, amber", "Nordlys")
    assert (row.unit_pack_size, row.unit_pack_size_source) == ("2 pieces per pack", "rule")
    assert (row.price, row.currency, row.availability) == (21.75, "SEK", "Two weeks")
    assert row.category_hierarchy == ["Cycling", "Lighting", "Lamp sets", "By battery"]
    assert row.specifications == {"Run time": "40 hours", "variant": "Amber glass, 2 pieces per pack"}
    assert row.description == "Front & rear lamp set, Run time: 40 hours with clips"
    assert row.image_urls == [f"https://cdn.bikes.test/lamp-{n}.png" for n in ("amber", "front", "box")]
    assert row.scraped_at == datetime.datetime(2024, 1, 1)


def test_page_without_variants_gives_parent_row(spark):
    no_offer = {k: v for k, v in LAMP_LD.items() if k not in ("offers", "sku", "brand")}
    hit = {
        "objectID": " 12 ",
        "sku": '["L1","L2"]',
        "price": '{"USD":{"default":19.99}}',
        "manufacturer_name": " Maker  One ",
        "stock_status_label": "Ships  soon",
        "image_url": "https://img.test/hit.jpg",
    }
    found = rows(
        spark,
        ("u1", page(LAMP_LD), LISTING, " A /// B ///  "),
        ("u2", page(no_offer), hit, "A /// B"),
    )
    first, second = found["u1", 0], found["u2", 0]
    assert (first.sku, first.parent_sku, first.price) == ("NRL", None, 18.2)
    assert first.availability == "Out of stock"
    assert first.category_hierarchy == ["A", "B"]
    assert (second.sku, second.price, second.currency) == ("L1", 19.99, "USD")
    assert second.brand == "Maker One"
    assert second.source_product_id == "12"
    assert second.availability == "Ships soon"
    assert second.image_urls[-1] == "https://img.test/hit.jpg"


def variant(**changes):
    v = copy.deepcopy(LAMP_VARIANTS)
    v["amber"].update(changes)
    return v


def test_one_bad_variant_fails_the_whole_page(spark):
    good = LAMP_VARIANTS["amber"]
    cases = {
        "inner": page(LAMP_LD, variants='{"a": '),
        "inner-tail": page(LAMP_LD, variants='{"a": {}} x'),
        "scalar": page(LAMP_LD, variants={"a": good, "b": 5}),
        "price": page(LAMP_LD, variants={"a": good, "b": {**good, "product_price": "$1.2.3"}}),
        "nested": page(LAMP_LD, variants=variant(product_price={"USD": {"price": "$1.2.3"}})),
        "text": page(LAMP_LD, variants=variant(name=["x"])),
        "ld-text": page({**LAMP_LD, "description": 5}, variants=LAMP_VARIANTS),
        "ld-name": page({**LAMP_LD, "name": 5}, variants=variant(name="")),
        "brand-list": page({**LAMP_LD, "brand": ["Nordlys"]}),
        "brand-number": page({**LAMP_LD, "brand": {"name": 7}}, variants=variant(manufacturer_name="")),
        "maker": page(LAMP_LD, variants=variant(manufacturer_name=["Nordlys"])),
        "crumb": page(LAMP_LD, {"@type": "BreadcrumbList", "itemListElement": [{"name": 3}]}),
        "missing": None,
    }
    found = rows(spark, *[(u, h, LISTING, "A") for u, h in cases.items()])
    assert {k[0] for k in found} == set(cases) and len(found) == len(cases)
    assert all(r.page_error for r in found.values())
    df = ex.extract_products(paired(spark, *[(u, h, LISTING, "A") for u, h in cases.items()]))
    assert ex.good_rows(df).count() == 0
    assert ex.page_failures(df).count() == len(cases)


def test_shapes_that_do_not_fail_a_page(spark):
    cases = {
        "list": page(LAMP_LD, variants=[1]),
        "not-string": '<script>window.masterData = {"a":1};</script>',
        "cut-off": "window.masterData = \"{",
        "unknown-stock": page({**LAMP_LD, "offers": {"availability": "x/LimitedStock"}}),
        "graph": page({"@graph": [{"@type": "Other"}, {**LAMP_LD, "sku": 0}]}),
        "bad-script": page() + '<script type="application/ld+json">{"@type":"Product"} ;</script>',
        "in-comment": "<!-- " + page(LAMP_LD) + " -->",
        "upper": '<SCRIPT async TYPE=\'Application/LD+JSON\'>[{"@type":"Product","sku":"Z"}]</SCRIPT >',
        "list-type": page({**LAMP_LD, "@type": ["Product"]}),
        "zero": page(LAMP_LD, variants=variant(product_price=0, price="0")),
        "html-price": page(LAMP_LD, variants=variant(product_price='<i data-price-amount="7.5">$9</i>')),
        "thousands": page(LAMP_LD, variants=variant(product_price="only $1,234.50 now")),
        "ld-name-unused": page({**LAMP_LD, "name": 5}, variants=LAMP_VARIANTS),
        "bool": page(LAMP_LD, variants=variant(product_price=True)),
        "brand-unused": page({**LAMP_LD, "brand": 7}, variants=LAMP_VARIANTS),
    }
    found = rows(spark, *[(u, h, {}, "A") for u, h in cases.items()])
    assert all(r.page_error is None for r in found.values())
    row = {u: found[u, 0] for u in cases}
    assert row["list"].sku == "NRL"
    assert row["not-string"].sku == "" and row["cut-off"].sku == ""
    assert row["unknown-stock"].availability == "LimitedStock"
    assert row["graph"].sku == "0"
    assert row["bad-script"].sku == "" and row["in-comment"].sku == ""
    assert row["upper"].sku == "Z"
    assert row["list-type"].sku == ""
    assert row["zero"].price == 0.0
    assert row["html-price"].price == 7.5
    assert row["thousands"].price == 1234.5
    assert row["bool"].price is None


def test_variant_order_and_repeated_skus(spark):
    base = LAMP_VARIANTS["amber"]
    variants = {
        "z": {**base, "sku": "S", "name": ""},
        "y": {**base, "sku": "S", "name": "second"},
        "x": {**base, "sku": "S", "name": "third", "id": False},
        "w": {**base, "sku": None},
    }
    ld = {k: v for k, v in LAMP_LD.items() if k != "name"}
    df = ex.extract_products(paired(spark, ("u", page(ld, LAMP_CRUMBS, variants=variants), {}, "")))
    checked = va.check_required(ex.good_rows(df))
    assert [r.product_name for r in va.accepted(checked).collect()] == ["second"]
    errors = sorted(r.error for r in va.rejected(checked).collect())
    assert errors == ["u: missing product_name", "u: missing sku"]


def test_latest_page_per_url(spark):
    pages = spark.createDataFrame(
        [("u", "old", 1), ("u", "new", 2), ("v", None, 1)], "url string, html string, n int"
    )
    assert {r.url: r.html for r in ex.latest_pages(pages, F.col("n")).collect()} == {
        "u": "new",
        "v": None,
    }


def test_a_page_task_has_one_python_worker(spark, sf_dir):
    """The texts and the nested prices go to Python side by side, in one step of the plan."""
    plan = extracted(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\b(?:ArrowEvalPython|BatchEvalPython|ArrowAggregatePython)\b", plan)) == 1, plan


def test_texts_and_prices_of_a_batch_keep_their_places(spark):
    """More texts than are converted at a time; rows that are null, empty, or hold nulls."""
    many = [f"<b>{i}</b> &amp;lt; &lt;i&gt;x&lt;/i&gt;  y" for i in range(2_345)]
    rows = [(0, many), (1, None), (2, []), (3, [None, "a  b", "&nbsp;"]), (4, ["plain <u>text</u>", None]), (5, many[:3])]
    df = spark.createDataFrame(rows, "id int, texts array<string>").coalesce(1)
    out = {r.id: r for r in tx.with_plain_text(df, "texts", "decoded", "plain").collect()}
    assert [len(out[i].plain) for i in (0, 5)] == [2_345, 3]
    assert (out[0].decoded[2_344], out[0].plain[2_344]) == ("<b>2344</b> &lt; <i>x</i>  y", "2344 < x y")
    assert out[5].plain == out[0].plain[:3]
    assert (out[1].decoded, out[1].plain, out[2].decoded, out[2].plain) == (None, None, [], [])
    assert (out[3].decoded, out[3].plain) == ([None, "a  b", "\xa0"], [None, "a b", None])
    assert (out[4].decoded, out[4].plain) == (["plain <u>text</u>", None], ["plain text", None])
    asked = spark.createDataFrame([(0, '{"USD": {"default": 2.5}}'), (1, '"$3"'), (2, None), (3, '{"price": "$1.2.3"}')], "id int, json string")
    values = F.array(F.try_parse_json("json"), F.try_parse_json("json"))
    found = asked.coalesce(1).select("id", nested_prices(values).alias("p")).collect()
    assert {r.id: r.p and [tuple(x) for x in r.p] for r in found} == {
        0: [(2.5, None)] * 2, 1: None, 2: None, 3: [(None, "1.2.3")] * 2,
    }


def test_markup_goes_alike_with_and_without_entities(spark):
    """Texts beside an entity are cleaned in Python, others in the JVM."""
    texts = [
        "a<!-- x > y\n-->b", "<a title=\"p > q\" b='r > s'>t</a>", "<p title=\"open>u", "1 < 2 > 0", "<", "<br/>x<BR>", "a<!b>c</ d>e",
        "<a 'b\"c>d' e\"f>g\">h", "x<!-- never closed", "<é>ü</é>", "\U0001f600<b\n>\x1cy z</b>", "<a b=\"\n>\">c", "", " \n",
    ]
    df = spark.createDataFrame([(0, texts), (1, [*texts, "&"])], "id int, texts array<string>")
    out = {r.id: r.plain for r in tx.with_plain_text(df, "texts", "decoded", "plain").collect()}
    assert out[1][:-1] == out[0] and out[1][-1] == "&"


def test_long_texts_become_python_objects_a_few_at_a_time():
    texts = ["", None, "short", *["\U0001f600" + "x" * 100_000] * 60, "y" * 3_000_000, "", "z", None]
    rows = pa.array([["before"], texts[:20], None, [], texts[20:], ["after"]], pa.list_(pa.string())).slice(1, 4)
    run = tx.by_element(lambda t: str(len(t)) + t[:1], pa.string())
    tracemalloc.start()
    found = run(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = [None if t is None else f"{len(t)}{t[:1]}" for t in texts]
    assert found.to_pylist() == [expected[:20], None, [], expected[20:]]
    assert peak < 10_000_000, peak  # all of them take 27 MB
