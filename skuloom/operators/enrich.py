"""Model responses joined to products, and the checks that gate them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import loose_json as lj
from skuloom.functions.similarity import rounded_to
from skuloom.functions.text import (
    blank_to_null,
    normalized_tags,
    squeeze,
    with_evidence_check,
)
from skuloom.session import materialize
from skuloom.sources import state

PACK_SIZE, TAGS = "pack_size", "tags"


def lacks_pack_size() -> Column:
    return F.coalesce("unit_pack_size", F.lit("")) == ""


def source_text() -> Column:
    """Name, description and variant text, one per line, blanks left out."""
    variant = F.element_at("specifications", F.lit("variant"))
    return F.concat_ws(
        "\n", *[blank_to_null(c) for c in (F.col("product_name"), F.col("description"), variant)]
    )


def tag_context() -> Column:
    """JSON of what a tag request may look at; keys in sorted order.

    A pack size that a model gave shows with its evidence and its confidence, a number.
    """
    given = F.filter(
        F.array(
            F.struct(
                F.lit("pack_size_confidence").alias("key"),
                F.col("pack_size_confidence").cast("variant").alias("value"),
            ),
            F.struct(
                F.lit("pack_size_evidence").alias("key"),
                F.col("pack_size_evidence").cast("variant").alias("value"),
            ),
        ),
        lambda e: e["value"].isNotNull(),
    )
    own = F.transform(
        F.map_entries("specifications"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value")),
    )
    own = F.filter(own, lambda e: ~F.array_contains(F.transform(given, lambda g: g["key"]), e["key"]))
    entries = F.concat(own, given)
    keys = F.array_sort(F.transform(entries, lambda e: e["key"]))
    values = F.map_from_entries(entries)
    specs = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(values, k)))
    return F.to_json(
        F.struct(
            F.col("category_hierarchy").alias("category_hierarchy"),
            F.col("description").alias("description"),
            F.col("product_name").alias("name"),
            specs.alias("specifications"),
            F.element_at("specifications", F.lit("variant")).alias("variant"),
        ),
        {"ignoreNullFields": "false"},
    )


def pack_size_requests(products: DataFrame) -> DataFrame:
    """The first step: pack sizes, where the rules found none."""
    return model_requests(products).filter(F.col("kind") == PACK_SIZE)


def tag_requests(products: DataFrame) -> DataFrame:
    """The second step, over products enriched with the answers of the first: their contexts
    hold the evidence of the pack sizes."""
    return model_requests(products).filter(F.col("kind") == TAGS)


def model_requests(products: DataFrame) -> DataFrame:
    """``sku, kind, input_text`` for an external model job, both kinds at once.

    Pack sizes are only asked for where the rules found none.
    """
    asked = F.array_compact(
        F.array(
            F.when(
                lacks_pack_size(),
                F.struct(F.lit(PACK_SIZE).alias("kind"), source_text().alias("input_text")),
            ),
            F.struct(F.lit(TAGS).alias("kind"), tag_context().alias("input_text")),
        )
    )
    return products.select("sku", F.inline(asked))


def answer_requests(
    requests: DataFrame,
    answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
) -> DataFrame:
    """Run a user's model function over the request table, in Arrow batches.

    ``answer`` maps batches of ``sku, kind, input_text`` to ``sku, kind, payload``.
    """
    answers = requests.mapInPandas(answer, "sku string, kind string, payload string")
    return answers.withColumn("seq", F.lit(0).cast("bigint"))


def request_ids(requests: DataFrame, version: str) -> DataFrame:
    """``requests`` with ``request_id``: the hash of kind, input and ``version`` (of the prompt and of the
    answer's form). The SKU is no part of it: equal questions have one answer."""
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("kind"), F.lit(version), F.col("input_text"))]
    return requests.withColumn("request_id", F.sha2(F.concat_ws("\u0000", *parts).cast("binary"), 256))


def answer_open_requests(
    requests: DataFrame,
    answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    root: str,
    *,
    version: str = "1",
    parts: int = 1,
) -> DataFrame:
    """``sku, kind, payload, seq`` for the requests; ``answer`` sees only what it has not answered yet.

    Answers are kept under ``root`` by request id. The open requests are asked in ``parts`` jobs, each kept
    when it is done, so a job that is cut short goes on where it was. Equal requests are asked once,
    in the name of the smallest SKU. A null payload is no answer and is asked for again next time.
    """
    spark = requests.sparkSession
    asked = materialize(request_ids(requests.select("sku", "kind", "input_text"), version), "model-requests")
    kept = lambda: state.read(spark, root, "answers")
    missing = asked.join(kept().select("request_id"), "request_id", "left_anti")
    one = missing.groupBy("request_id").agg(F.min(F.struct("sku", "kind", "input_text")).alias("r"))
    todo = materialize(one.select("request_id", "r.*"), "open-requests")
    for part in range(parts):
        mine = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("request_id"), F.lit(parts)) == part)
        if mine.isEmpty():
            continue
        batch = state.begin_batch(spark, root, "answers")
        found = answer_requests(mine.select("sku", "kind", "input_text"), answer).where("payload is not null")
        named = mine.select("request_id", "sku", "kind").join(found.drop("seq"), ["sku", "kind"])
        state.append(named.select("request_id", "payload"), root, "answers", batch)
    last = kept().groupBy("request_id").agg(F.max(F.struct("seq", "payload")).alias("a"))
    return asked.join(last, "request_id").select("sku", "kind", "a.payload", "a.seq")


def model_answers(products: DataFrame, answer: Callable, root: str, *, version: str = "1", parts: int = 1) -> DataFrame:
    """Answers to all requests of the products, the tags asked with the evidence of the pack sizes;
    what was answered before is not asked again."""
    ask = lambda requests: answer_open_requests(requests, answer, f"{root}/answers", version=version, parts=parts)
    sizes = materialize(ask(pack_size_requests(products)), "pack-size-answers")
    return sizes.unionByName(ask(tag_requests(enrich(products, sizes))))


def responses_by_sku(responses: DataFrame) -> DataFrame:
    """One row per SKU with both payloads, so that products are joined once.

    Of repeated responses the last by ``seq`` counts (of equal ones the greatest text); they
    are reduced in the map tasks.
    """
    answer = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), F.col("payload"))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, answer))["payload"]
    return responses.filter(F.col("payload").isNotNull()).groupBy("sku").agg(
        last(PACK_SIZE).alias("pack_payload"), last(TAGS).alias("tag_payload")
    )


def _blank(value: Column) -> Column:
    return squeeze(lj.text(value))


def enrich(
    products: DataFrame,
    responses: DataFrame,
    *,
    threshold: float = fv.PACK_CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Fill pack sizes and tags from model responses.

    Adds ``enrichment_errors``; a product with errors is kept. A response that is
    missing, empty or not confident enough changes nothing and is no error.
    """
    joined = (
        products.join(responses_by_sku(responses), "sku", "left")
        .withColumn("pack_payload", F.when(lacks_pack_size(), F.col("pack_payload")))
        .withColumns(
            {
                "pack": lj.parse_whole(F.col("pack_payload")),
                "tag": lj.parse_whole(F.col("tag_payload")),
            }
        )
    )
    pack, tag = F.col("pack"), F.col("tag")
    confidence = lj.field(pack, "confidence")
    read = joined.withColumns(
        {
            "said": _blank(lj.field(pack, "pack_size")),
            "quoted": _blank(lj.field(pack, "evidence")),
            "confidence": F.coalesce(F.try_variant_get(confidence, "$", "double"), F.lit(0.0)),
            "bad_pack": F.col("pack_payload").isNotNull()
            & (
                F.coalesce(lj.kind(pack) != "OBJECT", F.lit(True))
                | lj.truthy_but_not_text(lj.field(pack, "pack_size"))
                | lj.truthy_but_not_text(lj.field(pack, "evidence"))
                # given, but no number: also null, an empty text or list
                | (confidence.isNotNull() & F.try_variant_get(confidence, "$", "double").isNull())
            ),
            "bad_tags": F.col("tag_payload").isNotNull()
            & (
                F.coalesce(lj.kind(tag) != "OBJECT", F.lit(True))
                # given, but no list
                | F.coalesce(lj.kind(lj.field(tag, "attributes")) != "ARRAY", F.lit(False))
            ),
        }
    ).withColumn(
        "usable",
        ~F.col("bad_pack")
        & (F.col("said") != "")
        & (F.col("quoted") != "")
        & (F.col("confidence") >= threshold),
    )
    # Only the rows under consideration carry texts into the check.
    checked = (
        read.withColumns(
            {
                "check_source": F.when(F.col("usable"), source_text()),
                "check_pack": F.when(F.col("usable"), F.col("said")),
                "check_quote": F.when(F.col("usable"), F.col("quoted")),
            }
        )
        .transform(with_evidence_check, "check_pack", "check_quote", "check_source", "supported")
        .withColumn("take", F.col("usable") & F.col("supported"))
    )
    take = F.col("take")
    said, quoted = F.col("said"), F.col("quoted")
    values = F.concat(
        F.array(lj.as_text(lj.field(tag, "product_type"))),
        F.transform(lj.elements(lj.field(tag, "attributes")), lj.as_text),
    )
    tagged = F.col("tag_payload").isNotNull() & ~F.col("bad_tags")
    prefix = F.concat("sku", F.lit(": pack size: "))
    errors = F.array_compact(
        F.array(
            F.when(F.col("bad_pack"), F.concat(prefix, F.lit("response has another shape"))),
            F.when(
                F.col("usable") & ~F.col("supported"),
                F.concat(
                    prefix,
                    F.lit("evidence is not supported by the source text (pack_size='"),
                    said,
                    F.lit("', evidence='"),
                    quoted,
                    F.lit("')"),
                ),
            ),
            F.when(
                F.col("bad_tags"), F.concat("sku", F.lit(": tags: response has another shape"))
            ),
        )
    )
    changed = {
        "unit_pack_size": F.when(take, said).otherwise(F.col("unit_pack_size")),
        "unit_pack_size_source": F.when(take, F.lit(fv.PACK_SOURCE_MODEL)).otherwise(
            F.col("unit_pack_size_source")
        ),
        "pack_size_evidence": F.when(take, quoted).otherwise(F.col("pack_size_evidence")),
        "pack_size_confidence": F.when(take, rounded_to(F.col("confidence"), 3)).otherwise(
            F.col("pack_size_confidence")
        ),
        "normalized_tags": F.when(tagged, normalized_tags(F.array_compact(values))).otherwise(
            F.col("normalized_tags")
        ),
    }
    kept = [changed.get(c, F.col(c)).alias(c) for c in products.columns]
    return checked.select(*kept, errors.alias("enrichment_errors"))


def enrichment_failures(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        F.col("product_url").alias("url"),
        F.lit(fv.STAGE_ENRICHMENT).alias("stage"),
        F.explode("enrichment_errors").alias("error"),
    )
