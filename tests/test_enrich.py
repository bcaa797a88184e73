import json

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from skuloom import schemas
from skuloom.functions import text as tx
from skuloom.operators import enrich as en

PROSE = "Seven tubes in a crate, each wrapped in paper."

# (pack size, evidence, source text; None: the evidence itself, supported)
EVIDENCE = [
    ("7 tubes/crate", PROSE, "Paint set\n" + PROSE, True),
    ("7 tubes/crate", "Seven tubes each", "Paint set\n" + PROSE, False),
    ("24 vials per kit", "Kit of 24", "kit of 24, mixed colours", True),
    ("24 vials per kit", "Kit of 24", "kit of 25, mixed colours", False),
    ("8/sleeve", "8", "Series 8 brush", False),
    ("40 pcs/bag", "40 pieces per bag", None, True),
    ("18 jars/kit", "18 jar kit", None, True),
    ("6/case", "6/cs", None, True),
    ("6/case", "6 bx", None, False),
    ("1.50 oz", "1.5 fl oz tin", None, True),
    ("0.75 ml", ".750cc tube", None, True),
    ("9 bottles", "Rack holding 9 boxes", None, False),
    ("30 ml", "30 ml priming volume", None, False),
    ("22 ml", "22 drops per ml", None, False),
    ("Refill kit", "refill kit for felt pens", "The REFILL kit for felt pens", True),
    ("Refill kit", "refill kit for felt pens", "A kit for felt pens", False),
    ("5 oz", "5 oz &amp; lid", None, True),
    ("", "", None, False),
]


def test_evidence_table(spark):
    rows = [(i, p, e, s or e, ok) for i, (p, e, s, ok) in enumerate(EVIDENCE)]
    df = spark.createDataFrame(rows, "i int, p string, e string, s string, ok boolean")
    out = tx.with_evidence_check(df, "p", "e", "s", "found").collect()
    assert {r.i: r.found for r in out} == {r.i: r.ok for r in out}


@pytest.mark.parametrize(
    "value,expected",
    [("0.50", "0.5"), ("100", "100"), ("007", "7"), ("0.0", "0"), ("00", "0"), ("10.0", "10"), ("1.05", "1.05")],
)
def test_canonical_quantity(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tx.canonical_quantity(F.col("v"))).first()[0] == expected


def product(**changes):
    values = dict.fromkeys(schemas.PRODUCT_COLUMNS)
    values.update(
        source="t", sku="S", product_name="Paint set", product_url="u",
        category_hierarchy=["Paint"], description=PROSE, normalized_tags=["old"],
        specifications={}, image_urls=[],
    )
    values.update(changes)
    return tuple(values[c] for c in schemas.PRODUCT_COLUMNS)


def pack(size="7 tubes/crate", evidence=PROSE, confidence=0.92):
    return json.dumps({"pack_size": size, "evidence": evidence, "confidence": confidence})


def enriched(spark, products, responses):
    df = spark.createDataFrame(products, schemas.PRODUCT)
    res = spark.createDataFrame([(*r, None)[:4] for r in responses], schemas.MODEL_RESPONSE)
    return {r.sku: r for r in en.enrich(df, res).collect()}


def test_enrichment_rules(spark):
    tags = json.dumps({"product_type": "Paint  Set", "attributes": ["Washable", "for children", "washable", ""]})
    out = enriched(
        spark,
        [product(sku=s) for s in ("ok", "unsure", "wrong", "shape", "none", "null")]
        + [product(sku="has", unit_pack_size="1/box", unit_pack_size_source="rule")],
        [
            ("ok", "pack_size", pack(confidence=0.92345)),
            ("ok", "tags", tags),
            ("unsure", "pack_size", pack(confidence=0.64)),
            ("wrong", "pack_size", pack(evidence="Seven tubes each")),
            ("wrong", "tags", '{"attributes": ["A"]}'),
            ("shape", "pack_size", "not json"),
            ("shape", "tags", "[]"),
            ("null", "pack_size", pack(size=None)),
            ("has", "pack_size", pack()),
        ],
    )
    ok = out["ok"]
    assert (ok.unit_pack_size, ok.unit_pack_size_source) == ("7 tubes/crate", "llm")
    assert (ok.pack_size_evidence, ok.pack_size_confidence) == (PROSE, 0.923)
    assert ok.normalized_tags == ["paint set", "washable", "for children"]
    assert ok.enrichment_errors == []
    assert out["unsure"].unit_pack_size is None and out["unsure"].enrichment_errors == []
    assert out["wrong"].unit_pack_size is None and len(out["wrong"].enrichment_errors) == 1
    assert out["wrong"].normalized_tags == ["a"]
    assert len(out["shape"].enrichment_errors) == 2
    assert out["none"].normalized_tags == ["old"] and out["none"].enrichment_errors == []
    assert out["null"].enrichment_errors == []
    assert out["has"].unit_pack_size == "1/box"


def test_requests_and_stub_model(spark):
    df = spark.createDataFrame(
        [
            product(sku="a", specifications={"z": "1", "variant": "V", "b": "2"}),
            product(sku="b", unit_pack_size="1/box", description=None),
        ],
        schemas.PRODUCT,
    )
    requests = en.model_requests(df)
    rows = {(r.sku, r.kind): r.input_text for r in requests.collect()}
    assert set(rows) == {("a", "pack_size"), ("a", "tags"), ("b", "tags")}
    assert rows["a", "pack_size"] == f"Paint set\n{PROSE}\nV"
    context = json.loads(rows["a", "tags"])
    assert list(context) == ["category_hierarchy", "description", "name", "specifications", "variant"]
    assert list(context["specifications"]) == ["b", "variant", "z"]
    assert json.loads(rows["b", "tags"])["description"] is None

    def answer(batches):
        for batch in batches:
            yield batch.assign(payload='{"product_type":"Kit","attributes":[]}')[["sku", "kind", "payload"]]

    answers = en.answer_requests(requests, answer).filter("kind = 'tags'")
    assert all(r.normalized_tags == ["kit"] for r in en.enrich(df, answers).collect())


def test_last_answer_counts(spark):
    tags = lambda kind: json.dumps({"product_type": kind, "attributes": []})
    answers = [("a", "tags", tags("zebra"), 1), ("a", "tags", tags("apple"), 2), ("a", "tags", tags("mid"), None)]
    assert enriched(spark, [product(sku="a")], answers)["a"].normalized_tags == ["apple"]


@pytest.mark.parametrize("confidence", [None, "", [], {}, "much"])
def test_confidence_that_is_no_number_is_an_error(spark, confidence):
    out = enriched(spark, [product(sku="a")], [("a", "pack_size", pack(confidence=confidence))])["a"]
    assert out.unit_pack_size is None and len(out.enrichment_errors) == 1


@pytest.mark.parametrize("attributes", [None, 5, True, "x"])
def test_attributes_that_are_no_list_are_an_error(spark, attributes):
    answer = json.dumps({"product_type": "X", "attributes": attributes})
    out = enriched(spark, [product(sku="a")], [("a", "tags", answer)])["a"]
    assert out.normalized_tags == ["old"] and len(out.enrichment_errors) == 1
    missing = enriched(spark, [product(sku="a")], [("a", "tags", '{"product_type": "X"}'), ("a", "pack_size", '{"pack_size": null}')])
    assert missing["a"].normalized_tags == ["x"] and missing["a"].enrichment_errors == []


def test_tag_request_after_the_pack_size_holds_its_evidence(spark):
    df = spark.createDataFrame([product(sku="a", specifications={"z": "1", "b": "2"})], schemas.PRODUCT)
    answer = spark.createDataFrame([("a", "pack_size", pack(confidence=0.92345), 1)], schemas.MODEL_RESPONSE)
    (request,) = en.tag_requests(en.enrich(df, answer)).collect()
    specs = json.loads(request.input_text)["specifications"]
    assert list(specs.items()) == [("b", "2"), ("pack_size_confidence", 0.923), ("pack_size_evidence", PROSE), ("z", "1")]
    assert [r.kind for r in en.pack_size_requests(df).collect()] == ["pack_size"]


def test_claims_read_their_text_once(spark):
    rows = spark.createDataFrame([("24 gloves/box, box of 24, 1.50 ml",), ("",), (None,)], "text string")
    found = rows.select("text", tx.pack_claims(tx.match_text(F.col("text"))).alias("claims"))
    assert [[tuple(c) for c in r.claims] if r.claims is not None else None for r in found.collect()] == [
        [("count", "24", "box"), ("measure", "1.5", "ml")], [], None,
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(regexp_replace(") == 1, plan


@pytest.mark.parametrize("name", ["x18_match_text", "x19_pack_claims", "x20_evidence_supported", "u2_common_claims"])
def test_heavy_text_work_is_not_left_in_the_tasks_that_read(spark, tmp_path, name):
    spark.range(40).selectExpr(
        "id as p_partkey", "'red pot' as p_name", "'PROMO' as p_type", "'B' as p_brand", "cast(id as int) as p_size",
        "1.0D as p_retailprice",
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = queries()[name](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert found.count() == 40
