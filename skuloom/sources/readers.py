"""Readers of seeds, documents, search responses, model responses and JSONL logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom import schemas


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Category seeds of a JSON object with a ``categories`` array, with their order."""
    return (
        spark.read.schema(f"categories array<struct<{schemas.SEED}>>")
        .json(path, multiLine=True, mode="FAILFAST")
        .select(F.posexplode("categories").alias("category_ord", "seed"))
        .select("category_ord", "seed.*")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents from a table with ``url`` and ``html``."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Documents from files, one each; bytes that are not UTF-8 are replaced."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("url"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
        )
    )


def read_search_responses(spark: SparkSession, path: str) -> DataFrame:
    """Result pages of the category searches (JSON Lines)."""
    return spark.read.schema(schemas.SEARCH_RESPONSE).json(path, mode="FAILFAST")


def read_model_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_RESPONSE).parquet(path)


class MalformedLog(ValueError):
    """A line other than the last one of a JSONL file cannot be read."""


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON Lines with the order of the lines in ``line``.

    Blank lines are skipped. A broken last line of a file (a write cut short) is
    dropped; a broken line anywhere else raises ``MalformedLog``. Lines are
    numbered inside the scan tasks, where the id follows the file; nothing is
    sorted and no file is read as a whole.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("id"),
            ).alias("place"),
            F.col("value"),
        )
    )
    broken = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    ends = lines.groupBy("file").agg(
        F.max("place").alias("last"), F.min(F.when(broken, F.col("place"))).alias("first_broken")
    )
    bad = ends.filter(F.col("first_broken") < F.col("last")).select("file").limit(1).collect()
    if bad:
        raise MalformedLog(bad[0]["file"])
    return (
        lines.filter((F.trim("value") != "") & ~broken)
        .select(
            F.struct("file", "place").alias("line"),
            F.from_json("value", schema).alias("row"),
        )
        .select("row.*", "line")
    )
