"""Exact ranks over ranges, facets of both shapes, the ledger of runs, answers that are kept."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skuloom import schemas
from skuloom.operators import enrich as en
from skuloom.operators import listings as li
from skuloom.operators import quality as qu
from skuloom.sources import ledger, state
from workload.registry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def quartiles(prices):
    prices = sorted(prices)
    return [prices[-(-len(prices) * q // 4) - 1] for q in (1, 2, 3)]


@pytest.mark.parametrize("ranges,most", [(64, 200_000), (4, 40), (2, 7)])
def test_quartiles_over_ranges(spark, monkeypatch, ranges, most):
    monkeypatch.setattr(qu, "RANGES", ranges)
    monkeypatch.setattr(qu, "RANGE_PRICES", most)
    rng = random.Random(4)
    rows = [("a", rng.random() ** 8 * 1e6) for _ in range(1500)] + [("a", 1e12), ("a", -1e12)]
    rows += [("b", 5.0)] * 90 + [("c", None), (None, 2.0), (None, 1.0)] + [("d", float(i % 70)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, price double")
    found = {r.k: r for r in qu.price_distribution(df, "k").collect()}
    for key in ("a", "b", "d", None):
        prices = [p for k, p in rows if k == key]
        r = found[key]
        assert (r.quartiles, r.priced, r.least, r.greatest) == (quartiles(prices), len(prices), min(prices), max(prices))
    assert found["c"].quartiles is None and found["c"].priced == 0
    whole = qu.price_distribution(df)
    assert "CartesianProduct" not in plan(whole) and "NestedLoop" not in plan(whole)
    assert whole.first().quartiles == quartiles([p for _, p in rows if p is not None])
    assert qu.price_distribution(df.limit(0), "k").count() == 0


def test_far_prices_do_not_crowd_a_range(spark, monkeypatch):
    """One price of 1e12 leaves the others spread over the ranges; what is sorted at last is small."""
    sizes = []
    plain = qu.materialize

    def watched(df, name):
        out = plain(df, name)
        if name == "price-ranges":
            sizes.append(out.agg(F.max("size")).first()[0])
        return out

    monkeypatch.setattr(qu, "materialize", watched)
    monkeypatch.setattr(qu, "RANGE_PRICES", 1_000)
    prices = spark.range(40_000).select(F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 100).alias("price"))
    assert qu.price_distribution(prices).first().quartiles == [100.0, 200.0, 300.0]
    assert sizes[0] == 40_000 and len(sizes) == 2 and sizes[1] <= 1_000


def test_facets(spark, sf_dir):
    rows = spark.createDataFrame(
        [(1, "A", ["A", "A /// B"]), (2, "B", [None, "A"]), (3, None, None), (4, "A", [])],
        "id int, top string, tree array<string>",
    )
    for level, wanted in ((0, [1, 4]), (1, [1, 2]), (2, [])):
        asked = rows.withColumns({"category_level": F.lit(level), "category_path": F.lit("A")})
        found = asked.filter(li.in_category(asked, {0: "top", 1: "tree"}))
        assert sorted(r.id for r in found.collect()) == wanted
    each = rows.withColumns({"category_level": F.col("id") % 2, "category_path": F.lit("A")})
    assert [r.id for r in each.filter(li.in_category(each, {0: "top", 1: "tree"})).orderBy("id").collect()] == [1, 4]


def test_a_fixed_facet_reaches_the_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumns({"category_level": F.lit(1), "category_path": F.lit("R")})
    text = plan(lines.filter(li.in_category(lines, {0: "l_linestatus", 1: "l_returnflag"})).select("l_orderkey"))
    assert "EqualTo(l_returnflag,R)" in text and "l_linestatus" not in text


def test_ledger(spark, tmp_path):
    root = str(tmp_path)
    assert ledger.runs(spark, root) == [] and ledger.as_of(spark, root).count() == 0
    assert ledger.change(spark, root).count() == 0
    summary = spark.createDataFrame([(2, 3, 4, 1)], "categories_attempted long, product_pages_attempted long, product_rows_exported long, failures long")
    failures = spark.createDataFrame([("u", "validation", "e")], schemas.FAILURE)

    def products(*rows):
        schema = f"{schemas.PRODUCT}, parser_version string"
        names = [c.split()[0] for c in schema.split(", ")]
        data = []
        for sku, category, version, price in rows:
            values = dict.fromkeys(names) | dict(sku=sku, product_url=f"u{sku}", price=price, parser_version=version)
            data.append(tuple((values | dict(category_hierarchy=category and ["top", category])).values()))
        return spark.createDataFrame(data, schema)

    runs = [
        products(("a", "x", "1", 1.0), ("b", "x", "1", 3.0), ("b", "y", "1", None)),
        products(("a", "x", "1", 1.0), ("c", "x", "2", 2.0), ("d", None, "2", 5.0)),
    ]
    for n, rows in enumerate(runs):
        metrics = ledger.product_metrics(rows).unionByName(ledger.run_metrics(summary, failures))
        assert ledger.record(spark, root, metrics) == n
    first = {(r.metric, r.category): r.value for r in ledger.as_of(spark, root, 0).collect()}
    assert first["products", "x"] == 2 and first["price_middle", "x"] == 1 and first["missing_rate:brand", "y"] == 1
    assert first["product_rows_exported", None] == 4 and first["failures:validation", None] == 1
    assert ("price_middle", "y") not in first
    changed = {(r.category, r.parser_version): (r.current_value, r.previous_value, r.change) for r in ledger.change(spark, root).collect()}
    assert changed == {("x", "1"): (1, 2, -1), ("x", "2"): (1, 0, 1), ("y", "1"): (0, 1, -1), (None, "2"): (1, 0, 1)}
    assert {r.change for r in ledger.change(spark, root, run=0).collect()} == {2.0, 1.0}
    state.clear(spark, root)  # a fresh run forgets its state, not the ledger
    assert ledger.runs(spark, root) == [0, 1]


REQUEST = "sku string, kind string, input_text string"


def test_answers_are_kept(spark, tmp_path):
    root = str(tmp_path / "answers")
    seen = spark.sparkContext.accumulator(0)

    def answer(batches):
        for batch in batches:
            seen.add(len(batch))
            texts = batch["input_text"].map(lambda t: None if t == "none" else json.dumps({"said": t}))
            yield batch.assign(payload=texts)[["sku", "kind", "payload"]]

    def ask(rows, version="1", parts=1):
        before = seen.value
        found = en.answer_open_requests(spark.createDataFrame(rows, REQUEST), answer, root, version=version, parts=parts)
        rows = sorted((r.sku, r.kind, json.loads(r.payload)["said"]) for r in found.collect())
        return rows, seen.value - before

    rows = [("a", "tags", "x"), ("b", "tags", "y"), ("c", "tags", "x"), ("d", "pack_size", "x"), ("e", "tags", "none")]
    wanted = [("a", "tags", "x"), ("b", "tags", "y"), ("c", "tags", "x"), ("d", "pack_size", "x")]
    assert ask(rows) == (wanted, 4)  # equal requests are one
    assert ask(rows) == (wanted, 1)  # only what was not answered
    assert ask([*rows[:1], ("b", "tags", "new"), *rows[2:4]], parts=3) == ([wanted[0], ("b", "tags", "new"), *wanted[2:]], 1)
    assert ask(rows[:4], version="2") == (wanted, 3)
    assert ask([]) == ([], 0)


def test_a_job_that_is_cut_short_goes_on(spark, tmp_path):
    root = str(tmp_path / "answers")
    rows = spark.createDataFrame([(f"s{i}", "tags", f"t{i}") for i in range(40)], REQUEST)

    def answering(limit):
        def answer(batches):
            for batch in batches:
                if limit and "t7" in set(batch["input_text"]):
                    raise RuntimeError("the service is gone")
                yield batch.assign(payload=batch["input_text"])[["sku", "kind", "payload"]]

        return answer

    with pytest.raises(PySparkException):
        en.answer_open_requests(rows, answering(True), root, parts=8)
    kept = state.read(spark, root, "answers").count()
    found = en.answer_open_requests(rows, answering(False), root, parts=8)
    assert kept < 40 and found.count() == 40
    assert state.read(spark, root, "answers").count() == 40
