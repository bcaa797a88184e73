import csv
import glob
import json

import pytest
from page_samples import LAMP_CRUMBS, LAMP_LD, LAMP_VARIANTS, page
from pyspark.sql import functions as F
from test_listings import category_page, response, responses

from skuloom import schemas
from skuloom.plans import catalog
from skuloom.sources import ledger, readers, state
from skuloom.streaming import incremental
from skuloom.session import shared_dir

STAMP = "2024-05-01 10:00:00"


def family(i, **changes):
    variants = {
        f"{i}{s}": {**LAMP_VARIANTS["amber"], "sku": f"{i}{s}", "name": f"Lamp {i} {s}", **changes}
        for s in "ab"
    }
    return page({**LAMP_LD, "sku": f"F{i}"}, LAMP_CRUMBS, variants=variants)


@pytest.fixture(scope="module")
def inputs(spark):
    seeds = spark.createDataFrame([(0, "A", "ca"), (1, "B", "cb"), (2, "X", "cx")], "category_ord int, name string, url string")
    categories = spark.createDataFrame(
        [("ca", category_page()), ("cb", category_page()), ("cx", "nothing")], schemas.PAGE
    )
    found = responses(
        spark,
        response("ca", 0, 2, ["u1", "u2", {"url": "retry", "price": "$1.2.3"}, "broken"]),
        response("ca", 1, 2, ["u3", "gone"]),
        response("cb", 0, 1, ["u1", "u4", {"url": "retry", "price": 5, "sku": "R"}, "noname"]),
    )
    pages = spark.createDataFrame(
        [(f"u{i}", family(i)) for i in range(1, 5)]
        + [
            ("retry", page({"@type": "Product", "name": "Retry"})),
            ("broken", page(LAMP_LD, variants="{")),
            ("noname", page({"@type": "Product", "sku": "N"})),
        ],
        schemas.PAGE,
    )
    answers = spark.createDataFrame(
        [
            (f"{i}{s}", "tags", json.dumps({"product_type": "lamp", "attributes": ["amber", f"m{i % 2}"]}), 0)
            for i in range(1, 5)
            for s in "ab"
        ],
        schemas.MODEL_RESPONSE,
    )
    return dict(seeds=seeds, category_pages=categories, responses=found, pages=pages, model_responses=answers)


def exported(root):
    lines = [l for f in sorted(glob.glob(f"{root}/products_json/part-*")) for l in open(f)]
    return [json.loads(l) for l in lines]


def test_full_run_resume_and_fresh(spark, inputs, tmp_path):
    root = str(tmp_path / "out")
    left = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/skuloom/*"))
    before = left()
    summary = catalog.run(spark, root, scraped_at=STAMP, **inputs).first()
    assert left() == before
    assert summary.asDict() == {
        "categories_attempted": 3,
        "product_pages_attempted": 9,
        "product_rows_exported": 9,
        "failures": 5,
    }
    failures = state.read(spark, root, "failures").collect()
    assert sorted((r.stage, r.url) for r in failures) == [
        ("category_discovery", "cx"),
        ("product_extraction", "broken"),
        ("product_extraction", "gone"),
        ("product_extraction", "retry"),
        ("validation", "noname"),
    ]
    done = {r.url for r in state.completed_urls(spark, root).collect()}
    assert done == {"u1", "u2", "u3", "u4", "retry", "noname"}
    rows = exported(root)
    assert [r["sku"] for r in rows] == ["1a", "1b", "2a", "2b", "3a", "3b", "4a", "4b", "R"]
    assert list(rows[0]) == sorted(rows[0])
    assert rows[0]["scraped_at"] == "2024-05-01T10:00:00.000000Z"
    assert rows[0]["specifications"]["Run time"] == "40 hours"
    assert [a["sku"] for a in rows[0]["alternative_products"]] == ["3a", "3b", "2a"]
    assert rows[-1]["alternative_products"] == [] and rows[-1]["price"] == 5.0

    files = sorted(glob.glob(f"{root}/products_csv/part-*"))
    table = [r for f in files for r in csv.DictReader(open(f))]
    assert [r["sku"] for r in table] == [r["sku"] for r in rows]
    assert json.loads(table[0]["specifications"]) == rows[0]["specifications"]
    assert json.loads(table[0]["alternative_products"]) == rows[0]["alternative_products"]
    assert json.loads(table[0]["image_urls"]) == rows[0]["image_urls"]

    # resume: only what failed is tried again
    again = catalog.run(spark, root, scraped_at=STAMP, **inputs).first()
    assert (again.product_pages_attempted, again.product_rows_exported) == (2, 9)
    assert exported(root) == rows
    assert state.begin(spark, root, "resume").number == 2

    # fresh: everything is done again
    fresh = catalog.run(spark, root, scraped_at=STAMP, mode="fresh", limit_per_category=2, **inputs)
    assert fresh.first().product_rows_exported == 6
    with pytest.raises(ValueError):
        state.begin(spark, root, "other")


def test_a_plugged_in_model_and_the_ledger(spark, inputs, tmp_path):
    """A model inside the job: a second run from the start asks it nothing new; both runs are on record."""
    root = str(tmp_path / "out")
    seen = spark.sparkContext.accumulator(0)

    def model(batches):
        for batch in batches:
            seen.add(len(batch))
            said = {"tags": json.dumps({"product_type": "lamp", "attributes": ["amber"]}), "pack_size": json.dumps({"pack_size": None})}
            yield batch.assign(payload=batch["kind"].map(said))[["sku", "kind", "payload"]]

    given = {k: v for k, v in inputs.items() if k != "model_responses"}
    catalog.run(spark, root, scraped_at=STAMP, model=model, **given)
    asked, rows = seen.value, exported(root)
    assert asked > 9 and rows[0]["normalized_tags"] == ["lamp", "amber"]
    some = {**given, "pages": given["pages"].filter("url <> 'u4'")}
    catalog.run(spark, root, scraped_at=STAMP, model=model, mode="fresh", **some)
    assert seen.value == asked and len(exported(root)) == 7
    assert ledger.runs(spark, root) == [0, 1]
    changed = {r.category: r.change for r in ledger.change(spark, root).collect()}
    assert sum(changed.values()) == -2
    whole = {(r.run, r.metric): r.value for r in ledger.read(spark, root).where("category is null and parser_version is null").collect()}
    assert whole[0, "product_rows_exported"] == 9 and whole[1, "product_rows_exported"] == 7


def test_batch_rerun_replaces_itself_and_last_row_wins(spark, tmp_path):
    root = str(tmp_path)
    schema = state.TABLES["products"]
    names = [c.split()[0] for c in schemas.PRODUCT.split(", ")]

    def rows(*items):
        data = []
        for sku, name, pos in items:
            values = dict.fromkeys(names)
            values.update(sku=sku, product_name=name)
            data.append((*values.values(), (0, 0, pos), 0, None))
        return spark.createDataFrame(data, schema)

    assert state.latest_products(spark, root).count() == 0 and not state.has_rows(spark, root)
    state.append(rows(("a", "old", 0), ("b", "first", 0), ("b", "second", 1)), root, "products", 0)
    state.append(rows(("a", "lost", 0), ("c", "lost", 0)), root, "products", 1)
    state.append(rows(("a", "new", 0)), root, "products", 1)
    assert state.has_rows(spark, root)
    latest = {r.sku: r.product_name for r in state.latest_products(spark, root).collect()}
    assert latest == {"a": "new", "b": "second"}


def test_jsonl_log(spark, tmp_path):
    torn = tmp_path / "torn"
    torn.mkdir()
    (torn / "a.jsonl").write_text('{"sku":"a","n":1}\n\n{"sku":"b","n":2}\n{"sku":"a","n":3}\n{"sku":')
    (torn / "b.jsonl").write_text('{"sku":"c","n":4}\n')
    df = readers.read_jsonl_log(spark, str(torn), "sku string, n int")
    rows = sorted(df.collect(), key=lambda r: r.line)
    assert [(r.sku, r.n) for r in rows] == [("a", 1), ("b", 2), ("a", 3), ("c", 4)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.jsonl").write_text('{"sku":"a"}\n{"sku":\n{"sku":"b"}\n')
    with pytest.raises(readers.MalformedLog):
        readers.read_jsonl_log(spark, str(bad), "sku string")


def test_other_readers(spark, tmp_path):
    seeds = tmp_path / "seeds.json"
    seeds.write_text(json.dumps({"categories": [{"name": "A", "url": "a"}, {"name": "B", "url": "b"}]}, indent=1))
    assert [tuple(r) for r in readers.read_seeds(spark, str(seeds)).collect()] == [(0, "A", "a"), (1, "B", "b")]
    (tmp_path / "x.html").write_bytes(b"<p>caf\xe9 \xc3\xa9</p>")
    assert readers.read_page_files(spark, str(tmp_path)).first().html == "<p>caf� é</p>"
    (tmp_path / "r.json").write_text(response("a", 0, 1, [{"url": "u", "sku": ["S"], "price": {"USD": 1}}]))
    hit = readers.read_search_responses(spark, str(tmp_path / "r.json")).select(F.explode("hits").alias("h"))
    assert hit.select(F.to_json("h.sku"), F.to_json("h.price")).first()[:] == ('["S"]', '{"USD":1}')


def test_streamed_pages_equal_a_batch(spark, inputs, tmp_path):
    pages_dir, root, checkpoint = (str(tmp_path / n) for n in ("pages", "out", "checkpoint"))
    families = catalog.families_to_visit(
        spark.createDataFrame([("ca", 0, "A /// B", 1, "1")], schemas.CATEGORY),
        inputs["responses"].filter("category_url = 'ca'"),
        spark.createDataFrame([], schemas.COMPLETED),
        None,
    )
    parts = [inputs["pages"].filter("url in ('u1', 'broken')"), inputs["pages"].filter("url in ('u2', 'u3')")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{pages_dir}/{i}")
        for _ in range(2):  # the second call finds nothing new
            stream = incremental.page_stream(spark, f"{pages_dir}/*")
            incremental.process_new_pages(stream, families, root, checkpoint, scraped_at=STAMP)
        expected = {"1a", "1b"} if i == 0 else {"1a", "1b", "2a", "2b", "3a", "3b"}
        assert {r.sku for r in state.latest_products(spark, root).collect()} == expected
    assert {r.batch_id for r in state.read(spark, root, "products").select("batch_id").distinct().collect()} == {0, 1}
    assert [r.url for r in state.read(spark, root, "failures").collect()] == ["broken"]


def families_of(spark, inputs):
    return catalog.families_to_visit(
        spark.createDataFrame([("ca", 0, "A /// B", 1, "1")], schemas.CATEGORY),
        inputs["responses"].filter("category_url = 'ca'"),
        spark.createDataFrame([], schemas.COMPLETED),
        None,
    )


def saved(spark, root):
    skus = sorted(r.sku for r in state.latest_products(spark, root).collect())
    urls = sorted(r.url for r in state.completed_urls(spark, root).collect())
    failed = sorted({r.url for r in state.read(spark, root, "failures").collect()})
    return skus, urls, failed


def test_runs_and_streams_share_one_state(spark, inputs, tmp_path):
    """Batch, stream, batch, stream with a new checkpoint; nothing is replaced."""
    root, pages_dir = str(tmp_path / "out"), str(tmp_path / "pages")
    families = families_of(spark, inputs)

    def stream(part, checkpoint):
        inputs["pages"].filter(part).coalesce(1).write.mode("append").parquet(pages_dir)
        found = incremental.page_stream(spark, pages_dir)
        incremental.process_new_pages(found, families, root, str(tmp_path / checkpoint), scraped_at=STAMP)

    some = {**inputs, "pages": inputs["pages"].filter("url = 'u1'")}
    catalog.run(spark, root, scraped_at=STAMP, **some)
    first = saved(spark, root)
    assert "1a" in first[0] and "u1" in first[1]
    stream("url in ('u1', 'u2')", "one")
    second = saved(spark, root)
    assert set(first[0]) < set(second[0]) and set(first[1]) < set(second[1]) and set(first[2]) <= set(second[2])
    catalog.run(spark, root, scraped_at=STAMP, **some)
    assert set(second[0]) <= set(saved(spark, root)[0])
    stream("url in ('u3', 'broken')", "two")
    last = saved(spark, root)
    assert {"1a", "1b", "2a", "2b", "3a", "3b"} <= set(last[0]) and {"u1", "u2", "u3"} <= set(last[1])
    order = [r.seq for r in state.read(spark, root, "completed").select("seq").distinct().orderBy("seq").collect()]
    assert len(order) == len(set(order)) and "broken" in last[2]


def test_pages_wait_for_their_listing(spark, inputs, tmp_path):
    root, pages_dir = str(tmp_path / "out"), str(tmp_path / "pages")
    families = families_of(spark, inputs)
    inputs["pages"].filter("url in ('u1', 'u2')").coalesce(1).write.parquet(pages_dir)
    stream = incremental.page_stream(spark, pages_dir)
    incremental.process_new_pages(stream, families.filter("product_url = 'u1'"), root, str(tmp_path / "c"), scraped_at=STAMP)
    assert saved(spark, root) == (["1a", "1b"], ["u1"], [])
    incremental.process_pending(spark, families, root, scraped_at=STAMP)
    assert saved(spark, root) == (["1a", "1b", "2a", "2b"], ["u1", "u2"], [])
    incremental.process_pending(spark, families, root, scraped_at=STAMP)
    rows = state.read(spark, root, "products")
    assert rows.count() == 4


def test_quartiles_are_exact(spark):
    import random

    from skuloom.operators import quality

    rng = random.Random(4)
    rows = [("a", rng.random() ** 8 * 1e6) for _ in range(20_000)] + [("b", 5.0)] * 7 + [("c", None), (None, 2.0), (None, 1.0)]
    found = {r.k: r for r in quality.price_distribution(spark.createDataFrame(rows, "k string, price double"), "k").collect()}
    for key in ("a", "b", None):
        prices = sorted(p for k, p in rows if k == key)
        want = [prices[-(-len(prices) * q // 4) - 1] for q in (1, 2, 3)]
        assert found[key].quartiles == want and found[key].priced == len(prices)
    assert found["c"].quartiles is None and found["c"].priced == 0
