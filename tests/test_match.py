import random

import duckdb
import pytest

from skuloom.operators.match import _Search, similar_products
from workload.standins import MATCH_SQL

COLUMNS = (
    "sku string, product_name string, product_url string, brand string, "
    "category_hierarchy array<string>, normalized_tags array<string>"
)


def expected(products, k, min_score):
    """The matching SQL of the registered queries, over these products."""
    con = duckdb.connect()
    con.execute("CREATE TABLE item_rows (sku VARCHAR, name VARCHAR, url VARCHAR, brand VARCHAR, path VARCHAR[], tags VARCHAR[])")
    con.executemany("INSERT INTO item_rows VALUES (?, ?, ?, ?, ?, ?)", [list(p) for p in products])
    items = """
WITH item AS (
    SELECT sku, name AS product_name, url AS product_url, nullif(lower(brand), '') AS brand,
           coalesce(lower(path[-1]), '') AS leaf, list_sort(list_distinct(tags)) AS tags FROM item_rows),
"""
    rest = MATCH_SQL[MATCH_SQL.index("pair AS (") :]
    rest = rest.replace("CAST(a.brand = b.brand AS INTEGER)", "CAST(coalesce(a.brand = b.brand, false) AS INTEGER)")
    found = con.execute(
        items + rest + f"""
SELECT sku, coalesce(other_sku, 'None') AS other, score, list_sort(shared) FROM scored WHERE score >= {min_score}
QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, coalesce(other_sku, 'None')) <= {k}
ORDER BY sku, score DESC, other"""
    ).fetchall()
    result = {p[0]: [] for p in products}
    for sku, other, score, shared in found:
        result[sku].append((other, score, shared))
    return result


def matched(spark, products, k, min_score):
    df = similar_products(
        spark.createDataFrame(products, COLUMNS), max_alternatives=k, min_score=min_score
    )
    out = {}
    for row in df.collect():
        out[row.sku] = [
            (
                str(a.sku),
                a.score,
                a.reason.split(": ", 1)[1].split(", ") if a.reason.startswith("Shared") else [],
            )
            for a in row.alternative_products
        ]
    return out


def catalog(seed, n, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = rng.choice([None, *[f"u{j}" for j in range(n // 3)]])
        brand = rng.choice([None, "", "A", "a", "B", "C"])
        path = rng.choice([None, [], ["x", "Rakes"], ["rakes"], ["Twine"], ["Pots"]])
        tags = rng.sample([f"t{min(int(rng.expovariate(0.25)), 30)}" for _ in range(8)], rng.randint(0, 6))
        if rng.random() < hot:
            brand, path, tags = "A", ["rakes"], ["t1", "t2", "hot"]
        if rng.random() < 0.1:
            tags, url = ["solo"], "one-page"
        sku = None if i == 0 else f"S{rng.randint(0, 9)}{i}"
        rows.append((sku, f"n{i}", url, brand, path, tags))
    return rows


@pytest.mark.parametrize(
    "seed,n,k,min_score,hot",
    [
        (1, 150, 3, 0.45, 0.0),
        (2, 150, 3, 0.45, 0.4),
        (3, 120, 1, 0.72, 0.3),
        (4, 120, 2, 0.36, 0.0),
        (5, 60, 3, 0.35, 0.2),
        (6, 60, 3, 0.1, 0.0),
        (7, 50, 4, 0.0, 0.3),
    ],
)
def test_equals_expected(spark, seed, n, k, min_score, hot):
    products = catalog(seed, n, hot)
    assert matched(spark, products, k, min_score) == expected(products, k, min_score)


def test_hot_page_hides_nothing(spark):
    # many products of one page share a tag with "P"; the only others do not
    products = [("P", "p", "p", "B", ["leaf"], ["a"])]
    products += [(f"A{i:02}", "x", "hot", "B", ["leaf"], ["a", f"x{i}"]) for i in range(20)]
    products += [(f"B{i:02}", "x", "hot", "B", ["leaf"], [f"y{i}"]) for i in range(20)]
    products += [(f"C{i}", "x", f"c{i}", "B", ["leaf"], [f"z{i}"]) for i in range(5)]
    for min_score in (0.35, 0.2):
        assert matched(spark, products, 25, min_score) == expected(products, 25, min_score)
    assert matched(spark, products, 2, 0.35) == expected(products, 2, 0.35)


def test_copies_are_served_from_one_list(spark):
    products = [(f"S{i:03}", "n", f"u{i % 40}", "B", ["leaf"], ["a", "b"]) for i in range(200)]
    assert matched(spark, products, 3, 0.45) == expected(products, 3, 0.45)


def test_fields_and_missing_values(spark):
    products = [
        ("R1", "Leaf rake", "rakes", "Fjord", ["Garden", "Rakes"], ["rake", "ash handle", "wide"]),
        ("R2", "Leaf rake, long", "rakes", "Fjord", ["Garden", "Rakes"], ["rake", "ash handle", "wide"]),
        ("R3", "Lawn rake", "lawn", "fjord", ["RAKES"], ["wide", "rake", "steel"]),
        ("T1", "Garden twine", "twine", "Fjord", ["Garden", "Twine"], ["jute"]),
        ("N1", "Untagged rake", "none", "Fjord", ["Garden", "Rakes"], []),
    ]
    df = similar_products(spark.createDataFrame(products, COLUMNS))
    found = {r.sku: r.alternative_products for r in df.collect()}
    assert [a.sku for a in found["R1"]] == ["R3"] and [a.sku for a in found["R3"]] == ["R1", "R2"]
    assert found["R1"][0].asDict() == {
        "sku": "R3",
        "product_name": "Lawn rake",
        "product_url": "lawn",
        "score": 0.675,
        "reason": "Shared normalized tags: rake, wide",
        "source": "inferred",
        "method": "llm_normalized_tags_v1",
    }
    assert found["T1"] == [] and found["N1"] == []
    bare = spark.createDataFrame(
        [(s, None, s, None, None, ["pot", t, u]) for s, t, u in (("P", "clay", "round"), ("Q", "iron", "square"))], COLUMNS
    )
    assert all(r.alternative_products == [] for r in similar_products(bare, min_score=0.2).collect())


def test_arguments_are_checked(spark):
    empty = spark.createDataFrame([], COLUMNS)
    with pytest.raises(ValueError):
        similar_products(empty, max_alternatives=0)
    with pytest.raises(ValueError):
        similar_products(empty, min_score=1.1)
    assert similar_products(empty).count() == 0


@pytest.mark.parametrize("seed,k,min_score", [(8, 3, 0.45), (10, 3, 0.36)])
def test_hot_keys_are_chunked_without_loss(spark, monkeypatch, seed, k, min_score):
    from skuloom.operators import match

    monkeypatch.setattr(match, "_CHUNK", 4)
    monkeypatch.setattr(match, "_PROBE_SHARE", 2)
    products = catalog(seed, 100, 0.2)
    assert matched(spark, products, k, min_score) == expected(products, k, min_score)


def small_sets(seed, n):
    """Features with one tag in common, and few or no others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tags = ["every", *[f"r{rng.randrange(40)}" for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5]))]]
        tags += [f"own{i}-{j}" for j in range(rng.choice([0, 0, 1, 2]))]
        rows.append((f"S{i:03}", "n", f"u{i % 70}", rng.choice("AB"), [rng.choice(["p", "q"])], tags))
    return rows


@pytest.mark.parametrize("min_score", [0.45])
def test_one_crowded_tag_without_loss(spark, monkeypatch, min_score):
    from skuloom.operators import match

    monkeypatch.setattr(match, "_CHUNK", 6)
    products = small_sets(3, 110)
    assert matched(spark, products, 3, min_score) == expected(products, 3, min_score)


def test_features_with_one_crowded_tag_in_common_do_not_meet(spark):
    """50,000 features share a tag; a few share more. Tested pairs stay far below all pairs."""
    from pyspark.sql import functions as F

    from skuloom.operators import match

    n = 50_000
    word = lambda s, by=None: F.concat(F.lit(s), (F.col("id") if by is None else F.expr(f"id div {by}")).cast("string"))
    rows = spark.range(n).select(
        word("S").alias("sku"), F.lit("n").alias("product_name"), word("u").alias("product_url"), F.lit("B").alias("brand"),
        F.array(F.lit("leaf")).alias("category_hierarchy"),
        F.array(F.lit("every"), word("a", 4), word("b"), word("c")).alias("normalized_tags"),
    )
    search = match._Search(rows, 3, 0.45)
    pairs = search._tag_pairs(search.features, 0.45)
    assert pairs.count() <= 16 * n  # of 1,250 million
    # groups of four share two of six tags: 0.65 / 3 and the same leaf and brand
    found = similar_products(rows).select("sku", F.size("alternative_products").alias("n"), "alternative_products.score")
    scores = found.groupBy("n", "score").count().collect()
    assert [(r.n, r.score, r["count"]) for r in scores] == [(3, [0.5667] * 3, n)]


def test_few_candidates_of_a_key_leave_it(spark):
    """Sixty products of one brand and category: a key hands on what one list can hold, not all pairs."""
    products = [(f"S{i:02}", f"n{i}", f"u{i // 2}", "A", ["rakes"], ["steel", "long", "red", f"t{i}"]) for i in range(60)]
    search = _Search(spark.createDataFrame(products, COLUMNS), 2, 0.45)
    rows = search._tag_candidates(search.features, 0.7, 1.0001).groupBy("fid").count().collect()
    assert len(rows) == 60
    assert max(r["count"] for r in rows) <= 2 * search.total  # two prefix tags at most; 59 partners each
    assert matched(spark, products, 2, 0.45) == expected(products, 2, 0.45)


def test_crowded_pages_are_capped_as_a_whole(spark):
    """A page with more good partners than a list holds does not crowd out those of other pages."""
    products = [
        (f"S{i:02}", f"n{i}", "one-page" if i < 40 else f"u{i}", "A", ["rakes"], ["steel", "long", f"c{i % 3}", f"t{i}"])
        for i in range(60)
    ]
    assert matched(spark, products, 3, 0.45) == expected(products, 3, 0.45)
