"""The corpus operators over the given tables, with checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.llm import (
    bpe,
    compression,
    decontaminate,
    hard_negatives,
    html_main,
    langid,
    mixing,
    neardup,
    pii,
    ppm,
    quality_model,
    token_rollups,
    variants,
)
from skuloom.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_compression_bands")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rate(table(spark, sf_dir, "documents"))


@query("op2_chosen_path_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


@query("op3_consensus_host_paths")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op4_evidence_fusion_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


@query("op5_partial_matching")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query("op6_hashed_ngram_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_weak_supervision_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination", decontaminate.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scanned.drop("spans")


@query("op9_delta_token_rollups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: every document with two tokenizers; the even ids revised
    (without their first word, counted again) and each seventh deleted; the first batch once more, as
    after a failure."""

    def counted(docs: DataFrame, name: str) -> DataFrame:
        n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        rows = token_rollups.count_tokens(docs, "text", "bpe").withColumn("words", n_words)
        return materialize(rows.drop("text"), name)

    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = counted(documents, "token-counts")
    both = lambda df, sign: token_rollups.changes(
        df, sign, F.lit("bpe-50k/1"), F.col("bpe")
    ).unionByName(token_rollups.changes(df, sign, F.lit("words/1"), F.col("words")))
    first = both(rows, 1)
    gone = F.col("doc_id") % 7 == 0
    revised = (F.col("doc_id") % 2 == 0) & ~gone
    cut = F.regexp_replace("text", r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "")
    after = counted(documents.where(revised).withColumn("text", cut), "revised-counts")
    second = both(rows.where(gone), -1).unionByName(both(rows.where(revised), -1)).unionByName(both(after, 1))
    root = scratch_path(spark, "token-rollups")
    token_rollups.commit(spark, root, 1, first)
    token_rollups.commit(spark, root, 2, second)
    token_rollups.commit(spark, root, 1, first)
    return token_rollups.totals(spark, root)


@query("op10_weighted_fair_mix", mixing.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op11_reduced_alphabet_variants", variants.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), dropped_letter_modulus=199)
    return variants.group_variants(words)


@query("op12_secondary_sort_negatives", hard_negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth id against all rows; the labels of each seventh are noise."""
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("vector", lambda x: F.floor(256 * x))
    ready = rows.select(F.col("id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector"))
    return hard_negatives.mine(ready, F.col("id") % 100 == 0)


@query("op13_prefix_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode(bpe.encode(rows, path).drop("text"), path)
    return decoded.select("doc_id", *bpe.digests(F.col("tokens"), F.col("decoded")))
