"""Model responses, evidence checks and tags."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom import schemas
from skuloom.functions import text as tx
from skuloom.operators import enrich as en
from skuloom.session import materialize, scratch_path
from skuloom.sources import readers
from workload.registry import query, spread, table

# Pack size, evidence and source text of a part, as SQL both engines read. ``said`` is the size
# on even parts and one more on odd ones, so what agrees follows from the table's values.
SAID = "(p_size + p_partkey % 2)"
SHAPES = [
    ("p_size || ' vials per kit'", f"'Kit of ' || {SAID}", "p_name || ' kit of ' || " + SAID),
    ("p_size || '.50 oz'", f"{SAID} || '.5 fl oz tin'", f"p_type || ', ' || {SAID} || '.5 fl oz tin'"),
    ("p_size || ' tubes/pack'", "'Four kits, each with tubes of ' || p_type", None),
    ("'Refill Kit'", "'refill kit for ' || p_name", None),
    ("p_size || ' boxes'", "'Rack holding ' || p_size || ' boxes'", "p_name || '. Rack holding ' || p_size || ' boxes'"),
    ("p_size || ' ml'", "p_size || ' drops per ml'", "p_type || ' ' || p_size || ' drops per ml'"),
    ("p_size || '/bag'", "CAST(p_size AS STRING)", "'Series ' || p_size || ' ' || p_name"),
]
# without a source of its own, the evidence is quoted from the source on even parts only
QUOTED = "CASE WHEN p_partkey % 2 = 0 THEN p_name || ': ' || {evidence} ELSE p_name END"
SHAPE_NO = "(p_partkey % 7)"


def _by_shape(texts: list[str]) -> str:
    return f"CASE {SHAPE_NO} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


CASE_COLUMNS = {
    "pack": _by_shape([p for p, _, _ in SHAPES]),
    "evidence": _by_shape([e for _, e, _ in SHAPES]),
    "source": _by_shape([s or QUOTED.format(evidence=e) for _, e, s in SHAPES]),
}


def cases(spark, sf_dir) -> DataFrame:
    """Parts with one evidence case each, made of their own values."""
    return table(spark, sf_dir, "part").withColumns({c: F.expr(e) for c, e in CASE_COLUMNS.items()})


def products(spark, sf_dir) -> DataFrame:
    """Products without a pack size, except large ones; the name is the source text."""
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    values = dict.fromkeys(schemas.PRODUCT_COLUMNS, text)
    values |= {
        "source": F.lit("shop.test"),
        "sku": F.concat(F.lit("P"), F.col("p_partkey").cast("string")),
        "product_name": F.col("source"),
        "product_url": F.concat(F.lit("u"), F.col("p_partkey").cast("string")),
        "brand": F.col("p_brand"),
        "category_hierarchy": F.array("p_type"),
        "price": F.col("p_retailprice"),
        "unit_pack_size": F.when(F.col("p_size") > 45, "1/box"),
        "unit_pack_size_source": F.when(F.col("p_size") > 45, "rule"),
        "normalized_tags": none,
        "specifications": F.create_map(F.lit("variant"), F.col("p_name")),
        "pack_size_confidence": F.lit(None).cast("double"),
        "image_urls": none,
        "scraped_at": F.lit("2024-01-01 00:00:00").cast("timestamp"),
    }
    return cases(spark, sf_dir).select(*[v.alias(c) for c, v in values.items()])


def responses(spark, sf_dir) -> DataFrame:
    """A pack-size response per part (confidence p_size / 50), tags for most."""
    pack = F.to_json(
        F.struct(
            F.col("pack").alias("pack_size"), F.col("evidence"), (F.col("p_size") / 50).alias("confidence")
        )
    )
    words = F.split("p_name", " ")
    tags = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.upper("p_type"), F.lit("  item")).alias("product_type"),
            F.concat(F.transform(words, F.upper), words, F.array(F.lit(" "), F.lit("Ä  b"))).alias("attributes"),
        )
    )
    # some confidences are null, some attributes no list, and an earlier answer is outdated
    pack = F.when(F.col("p_size") == 44, F.regexp_replace(pack, '"confidence":[0-9.]+', '"confidence":null')).otherwise(pack)
    bad = F.when(F.col("p_size") == 1, F.lit("{")).otherwise(F.lit('{"product_type":"x","attributes":null}'))
    answer = lambda kind, seq, payload: F.struct(
        F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(seq).cast("bigint").alias("seq")
    )
    payloads = F.array(
        answer(en.PACK_SIZE, 1, pack),
        answer(en.TAGS, 2, F.when(F.col("p_size") > 2, tags).otherwise(bad)),
        answer(en.TAGS, 1, F.lit('{"product_type":"zzz outdated","attributes":[]}')),
    )
    return cases(spark, sf_dir).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku"), F.inline(payloads)
    )


def enriched(spark, sf_dir) -> DataFrame:
    return en.enrich(products(spark, sf_dir), responses(spark, sf_dir))


CASE_SQL = f"""
WITH texts AS (
    SELECT part.*, {", ".join(f"{e} AS {c}" for c, e in CASE_COLUMNS.items())} FROM part
),
judged AS (
    SELECT *,
           (lower(evidence) = 'kit of ' || p_size OR evidence = p_size || '.5 fl oz tin')
           AND position(lower(evidence) IN lower(source)) > 0 AS agree,
           evidence LIKE 'Four kits%' AND evidence LIKE '%each%' AS verbal,
           lower(pack) = 'refill kit' AS descriptor,
           position(evidence IN source) > 0 AS quoted
    FROM texts
),
item AS (
    SELECT *, agree OR (quoted AND (verbal OR descriptor)) AS supported,
           p_size <= 45 AND p_size <> 44 AND p_size / 50.0 >= 0.65 AS considered
    FROM judged
)
"""


@query(
    "s6_model_responses",
    CASE_SQL
    + """
SELECT 'P' || p_partkey AS sku, 'pack_size' AS kind, pack AS said,
       'P' || p_partkey || '-' || CASE p_size WHEN 44 THEN '' ELSE CAST(p_size AS VARCHAR) END AS marker FROM item
UNION ALL SELECT 'P' || p_partkey, 'tags', NULL, 'P' || p_partkey || '-' FROM item
UNION ALL SELECT 'P' || p_partkey, 'tags', NULL, 'P' || p_partkey || '-' FROM item""",
)
def s6(spark, sf_dir):
    path = scratch_path(spark, "responses")
    responses(spark, sf_dir).write.parquet(path)
    read = F.from_json("payload", "pack_size string, evidence string, confidence double")
    confidence = F.coalesce(F.round(read["confidence"] * 50).cast("int").cast("string"), F.lit(""))
    return readers.read_model_responses(spark, path).select(
        "sku", "kind", read["pack_size"].alias("said"), F.concat("sku", F.lit("-"), confidence).alias("marker")
    )


@query(
    "j3_products_with_responses",
    """SELECT 'P' || p_partkey AS sku, true AS has_pack, true AS has_tags FROM part""",
)
def j3(spark, sf_dir):
    joined = products(spark, sf_dir).join(
        en.responses_by_sku(responses(spark, sf_dir)), "sku", "left"
    )
    return joined.select(
        "sku",
        F.col("pack_payload").isNotNull().alias("has_pack"),
        F.col("tag_payload").isNotNull().alias("has_tags"),
    )


@query("p14_without_pack_size", "SELECT 'P' || p_partkey AS sku FROM part WHERE p_size <= 45")
def p14(spark, sf_dir):
    return products(spark, sf_dir).filter(en.lacks_pack_size()).select("sku")


@query(
    "p13_confident_responses",
    CASE_SQL + "SELECT 'P' || p_partkey AS sku, evidence FROM item WHERE considered AND supported",
)
def p13(spark, sf_dir):
    return (
        enriched(spark, sf_dir)
        .filter("unit_pack_size_source = 'llm'")
        .select("sku", F.col("pack_size_evidence").alias("evidence"))
    )


@query(
    "p15_source_text",
    CASE_SQL + "SELECT 'P' || p_partkey AS sku, source || chr(10) || p_name AS input_text FROM item",
)
def p15(spark, sf_dir):
    return products(spark, sf_dir).select("sku", en.source_text().alias("input_text"))


@query(
    "p16_tag_requests",
    CASE_SQL
    + """
SELECT 'P' || p_partkey AS sku, '{"category_hierarchy":["' || p_type || '"],"description":null,"name":"' || source
       || '","specifications":{' || CASE WHEN considered AND supported THEN '"pack_size_confidence":'
       || rtrim(rtrim(printf('%.3f', p_size / 50.0::DOUBLE), '0'), '.') || ',"pack_size_evidence":"' || evidence || '",'
          ELSE '' END
       || '"variant":"' || p_name || '"},"variant":"' || p_name || '"}' AS input_text
FROM item""",
)
def p16(spark, sf_dir):
    """Tag requests of products whose pack sizes were answered before."""
    return en.tag_requests(enriched(spark, sf_dir)).select("sku", "input_text")


@query(
    "x18_match_text",
    r"""
SELECT p_partkey, regexp_replace(lower(p_name), ' +', ' ', 'g') || ' ' || p_size || ' box 0.5 ml 2 glove per case' AS comparable
FROM part""",
)
def x18(spark, sf_dir):
    text = F.concat(
        F.upper("p_name"), F.lit(" - &quot;"), F.col("p_size").cast("string"),
        F.lit("&quot;/BX (.5CC) 2  Gloves per cs"),
    )
    return (
        spread(table(spark, sf_dir, "part"))
        .select("p_partkey", F.array(text).alias("texts"))
        .withColumn("decoded", tx.decode_entities(F.col("texts")))
        .select("p_partkey", tx.match_text(F.get("decoded", F.lit(0))).alias("comparable"))
    )


@query(
    "x19_pack_claims",
    """
SELECT p_partkey, array_to_string(list_sort(['count:' || p_size || ':box', 'count:' || p_size || ':case',
       'count:7:sleeve', 'measure:' || p_size || '.5:ml']), '|') AS claims
FROM part""",
)
def x19(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(
        size, F.lit(" gloves/box, "), size, F.lit(" per case, sleeve of 7, "), size,
        F.lit(".50 fl ml, 9 ml priming volume, holds 3 boxes, 15 drops/ml, "), size, F.lit(" bx"),
    )
    claims = F.transform(
        tx.pack_claims(tx.match_text(text)),
        lambda c: F.concat_ws(":", c["kind"], c["quantity"], c["unit"]),
    )
    return spread(table(spark, sf_dir, "part")).select(
        "p_partkey", F.array_join(F.sort_array(claims), "|").alias("claims")
    )


@query("x20_evidence_supported", CASE_SQL + "SELECT p_partkey, supported FROM item")
def x20(spark, sf_dir):
    return tx.with_evidence_check(
        spread(cases(spark, sf_dir)), "pack", "evidence", "source", "supported"
    ).select("p_partkey", "supported")


@query(
    "u2_common_claims",
    CASE_SQL + "SELECT p_partkey, agree FROM item",
)
def u2(spark, sf_dir):
    claims = tx.Evidence(
        *[tx.pack_claims(tx.match_text(F.col(c))) for c in ("pack", "evidence", "source")]
    )
    return spread(cases(spark, sf_dir)).select("p_partkey", tx.claims_agree(claims).alias("agree"))


@query("x21_verbal_evidence", CASE_SQL + "SELECT p_partkey, verbal FROM item")
def x21(spark, sf_dir):
    verbal = tx.is_verbal_evidence(tx.match_text(F.col("evidence")))
    return spread(cases(spark, sf_dir)).select("p_partkey", verbal.alias("verbal"))


@query("x22_pack_descriptor", CASE_SQL + "SELECT p_partkey, descriptor FROM item")
def x22(spark, sf_dir):
    descriptor = tx.is_pack_descriptor(tx.match_text(F.col("pack")))
    return spread(cases(spark, sf_dir)).select("p_partkey", descriptor.alias("descriptor"))


@query(
    "x23_canonical_quantity",
    """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
       CASE WHEN CAST(round(l_discount * 100) AS BIGINT) = 0 THEN '0'
            ELSE '0.' || rtrim(lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 2, '0'), '0') END AS discount
FROM lineitem""",
)
def x23(spark, sf_dir):
    whole = F.concat(F.lit("00"), F.col("l_quantity").cast("bigint").cast("string"), F.lit(".00"))
    hundredths = F.round(F.col("l_discount") * 100).cast("bigint").cast("string")
    part = F.concat(F.lit("0."), F.lpad(hundredths, 2, "0"), F.lit("0"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        tx.canonical_quantity(whole).alias("quantity"),
        tx.canonical_quantity(part).alias("discount"),
    )


TAGS_SQL = """
SELECT 'P' || p_partkey AS sku, CASE WHEN p_size > 2 THEN
       lower(p_type) || ' item|' || replace(lower(p_name), ' ', '|') || '|ä b' ELSE '' END AS tags
FROM part"""


@query(
    "a7_distinct_tags",
    """
SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || [lower(p_brand)])), '|') AS tags
FROM part""",
)
def a7(spark, sf_dir):
    words = F.split("p_name", " ")
    tags = tx.normalized_tags(F.concat(words, F.array("p_brand"), F.transform(words, F.upper)))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.sort_array(tags), "|").alias("tags")
    )


@query("x24_normalized_tags", TAGS_SQL)
def x24(spark, sf_dir):
    return enriched(spark, sf_dir).select("sku", F.array_join("normalized_tags", "|").alias("tags"))


@query(
    "x28_applied_pack_sizes",
    CASE_SQL
    + """
SELECT 'P' || p_partkey AS sku,
       CASE WHEN p_size > 45 THEN '1/box' WHEN considered AND supported THEN pack END AS unit_pack_size,
       CASE WHEN p_size > 45 THEN 'rule' WHEN considered AND supported THEN 'llm' END AS unit_pack_size_source,
       CASE WHEN considered AND supported THEN CAST(printf('%.3f', p_size / 50.0::DOUBLE) AS DOUBLE) END AS confidence,
       CAST(CASE WHEN considered AND NOT supported OR p_size = 44 THEN 1 ELSE 0 END
            + CASE WHEN p_size <= 2 THEN 1 ELSE 0 END AS INTEGER) AS errors
FROM item""",
)
def x28(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        "sku", "unit_pack_size", "unit_pack_size_source",
        F.col("pack_size_confidence").alias("confidence"), F.size("enrichment_errors").alias("errors"),
    )


@query(
    "s9_enrichment_failures",
    CASE_SQL
    + """
SELECT 'u' || p_partkey AS url, 'ai_enrichment' AS stage, 'P' || p_partkey
       || ': pack size: evidence is not supported by the source text (pack_size=''' || pack || ''', evidence='''
       || evidence || ''')' AS error
FROM item WHERE considered AND NOT supported
UNION ALL SELECT 'u' || p_partkey, 'ai_enrichment', 'P' || p_partkey || ': tags: response has another shape'
FROM item WHERE p_size <= 2
UNION ALL SELECT 'u' || p_partkey, 'ai_enrichment', 'P' || p_partkey || ': pack size: response has another shape'
FROM item WHERE p_size = 44""",
)
def s9(spark, sf_dir):
    return en.enrichment_failures(enriched(spark, sf_dir))


@query(
    "f1_plugged_in_model",
    """SELECT 'P' || p_partkey AS sku, 'thing|known' AS tags, CASE WHEN p_size > 45 THEN '1/box' END AS unit_pack_size
FROM part""",
)
def f1(spark, sf_dir):
    items = products(spark, sf_dir)

    def answer(batches):  # shipped by value
        for batch in batches:
            said = ['{"product_type": "Thing", "attributes": ["Known"]}' if k == "tags" else '{"pack_size": null}' for k in batch["kind"]]
            yield batch.assign(payload=said)[["sku", "kind", "payload"]]

    answers = en.answer_requests(en.model_requests(items), answer)
    return en.enrich(items, answers).select(
        "sku", F.array_join("normalized_tags", "|").alias("tags"), "unit_pack_size"
    )


@query(
    "f1_resumed_model",
    """
SELECT 'P' || p_partkey AS sku, 'tags' AS kind, 'thing|' || lower(p_name) AS tags, CAST(p_partkey % 2 AS BIGINT) AS run FROM part""",
)
def f1_resumed(spark, sf_dir):
    """Odd products are asked about in a second run, together with the even ones of the first, which
    are not asked again; ``run`` tells the run of the answer."""
    number = F.regexp_extract("sku", "([0-9]+)", 1).cast("long")
    items = products(spark, sf_dir).withColumn("description", F.col("sku"))  # no two requests are equal
    root = scratch_path(spark, "answers")

    def answer(batches):
        for batch in batches:
            names = batch["input_text"].map(lambda text: json.loads(text)["variant"])
            yield batch.assign(payload=[json.dumps({"product_type": "Thing", "attributes": [n]}) for n in names])[["sku", "kind", "payload"]]

    en.answer_open_requests(en.tag_requests(items.filter(number % 2 == 0)), answer, root)
    answers = materialize(en.answer_open_requests(en.tag_requests(items), answer, root, parts=2), "answers")
    tags = en.enrich(items, answers).select("sku", F.array_join("normalized_tags", "|").alias("tags"))
    run = F.when(F.col("seq") == 0, 0).otherwise(1).cast("long").alias("run")
    return answers.select("sku", "kind", run).join(tags, "sku").select("sku", "kind", "tags", "run")


@query(
    "f2_composed_stages",
    "SELECT 'P' || p_partkey AS sku, upper(p_brand) AS brand FROM part WHERE p_size <= 45",
)
def f2(spark, sf_dir):
    def upper_brand(df: DataFrame) -> DataFrame:
        return df.withColumn("brand", F.upper("brand"))

    def only_open(df: DataFrame) -> DataFrame:
        return df.filter(en.lacks_pack_size())

    return products(spark, sf_dir).transform(only_open).transform(upper_brand).select("sku", "brand")
