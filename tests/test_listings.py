import json

import pytest
from pyspark.sql import functions as F

from skuloom import schemas
from skuloom.operators import listings as li

CONFIG = {
    "isCategoryPage": True,
    "request": {"level": 3, "path": "Garden /// Tools /// Rakes", "categoryId": "rakes-07"},
    "indexName": "garden",
}


def category_page(**changes):
    return f"<html><script>\nwindow.algoliaConfig = {json.dumps({**CONFIG, **changes})};\n</script></html>"


def test_category_configs_and_failures(spark):
    seeds = spark.createDataFrame([(i, u) for i, u in enumerate("abcdef")], "category_ord int, url string")
    pages = spark.createDataFrame(
        [
            ("a", category_page()),
            ("b", category_page(isCategoryPage=False)),
            ("c", "<html></html>"),
            ("d", "window.algoliaConfig = {oops"),
            ("e", category_page(request={"path": "X", "level": "x"})),
        ],
        "url string, html string",
    )
    configs = li.category_configs(seeds, pages)
    good = li.usable_configs(configs).collect()
    assert [(r.category_url, r.category_path, r.category_level, r.category_id) for r in good] == [
        ("a", "Garden /// Tools /// Rakes", 3, "rakes-07")
    ]
    bad = li.discovery_failures(configs).collect()
    assert {r.url for r in bad} == set("bcdef")
    assert {r.stage for r in bad} == {"category_discovery"}


def response(cat, page, total, urls, error=None):
    hits = [{"objectID": f"{cat}{page}{i}", **u} if isinstance(u, dict) else {"url": u} for i, u in enumerate(urls)]
    return json.dumps({"category_url": cat, "page_no": page, "nbPages": total, "hits": hits, "error": error})


def responses(spark, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    schema = f"category_url string, page_no int, nbPages int, error string, hits array<struct<{schemas.HIT}>>"
    return df.select(F.from_json("j", schema).alias("r")).select("r.*")


def test_page_bounds(spark):
    df = responses(
        spark,
        response("a", 0, 3, ["u1"]), response("a", 1, 3, ["u2"]), response("a", 2, 3, ["u3"]),
        response("a", 3, 3, ["late"]),
        response("b", 0, 9, ["u1"]), response("b", 1, 9, []), response("b", 2, 9, ["u9"]),
        response("c", 0, 0, ["only"]), response("c", 1, 0, ["x"]),
        response("d", 0, 5, ["x"]), response("d", 1, 5, [], "HTTP 500"), response("d", 2, 5, ["y"]),
        response("e", 0, 1, ["x"]), response("e", 1, 1, [], "never asked"),
    )
    kept = {(r.category_url, r.page_no) for r in li.pages_in_bounds(df).collect()}
    assert kept == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("d", 0), ("e", 0)}
    assert [(r.url, r.error) for r in li.traversal_failures(df).collect()] == [("d", "HTTP 500")]


def test_first_hit_limit_and_order(spark):
    df = responses(
        spark,
        response("a", 0, 3, ["u1", {"url": "u0", "family_url": "f"}, {"family_url": ""}, "u1"]),
        response("a", 1, 3, ["f", "u2", "u3"]),
        response("b", 0, 1, ["u3", "u1", "z"]),
    )
    configs = spark.createDataFrame([("a", 1, "A", 1, "1"), ("b", 0, "B", 1, "2")], schemas.CATEGORY)
    hits = li.attach_category(li.hits_of(li.pages_in_bounds(df)), configs)
    first = li.first_in_category(li.with_family_url(hits))
    place = lambda d: {(r.category_url, r.product_url): (r.page_no, r.pos) for r in d.collect()}
    assert place(first) == {
        ("a", "u1"): (0, 0), ("a", "f"): (0, 1), ("a", "u2"): (1, 1), ("a", "u3"): (1, 2),
        ("b", "u3"): (0, 0), ("b", "u1"): (0, 1), ("b", "z"): (0, 2),
    }
    assert set(place(li.limit_per_category(first, 3))) == {
        ("a", "u1"), ("a", "f"), ("a", "u2"), ("b", "u3"), ("b", "u1"), ("b", "z"),
    }
    assert li.limit_per_category(first, None) is first
    with pytest.raises(ValueError):
        li.limit_per_category(first, 0)
    ranked = {(r.product_url, r.attempt): r.category_url for r in li.ranked_across_categories(first).collect()}
    assert ranked["u1", 1] == "b" and ranked["u1", 2] == "a" and ranked["u2", 1] == "a"
    done = spark.createDataFrame([("u1",)], "url string")
    left = li.not_completed(li.first_across_categories(first), done)
    assert {r.product_url for r in left.collect()} == {"f", "u2", "u3", "z"}


def test_limit_over_page_blocks(spark, monkeypatch):
    monkeypatch.setattr(li, "PAGES_PER_BLOCK", 3)
    rows = [("c", p, i, f"{p}-{i}") for p in range(20) for i in range(p % 4)]
    df = spark.createDataFrame(rows, "category_url string, page_no int, pos int, product_url string")
    for limit in (1, 7, 13, 29, 100):
        got = [r.product_url for r in li.limit_per_category(df, limit).orderBy("page_no", "pos").collect()]
        assert got == [r[3] for r in rows][:limit]


def test_limit_ends_the_traversal(spark):
    """A page that fails after the limit was reached was never asked for."""
    df = responses(
        spark,
        response("a", 0, 5, ["u1", "u2"]), response("a", 1, 5, [], error="HTTP 500"),
        response("b", 0, 5, ["u1", "u1"]), response("b", 1, 5, [], error="HTTP 503"),
        response("c", 0, 5, [], error="HTTP 504"),
    )
    failed = lambda limit: {r.url for r in li.traversal_failures(df, limit).collect()}
    assert failed(None) == {"a", "b", "c"} == failed(3)
    assert failed(2) == {"b", "c"}
    assert failed(1) == {"c"}
