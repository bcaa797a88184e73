"""Pages stored by URL, so that joins on the URL leave the documents where they are."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom import schemas
from skuloom.operators.extract import latest_pages
from skuloom.sources import versions


def _name(path: str) -> str:
    return f"skuloom_pages_{hashlib.md5(path.encode()).hexdigest()}"


def _about(path: str) -> str:
    # folders that start with an underscore are not data
    return f"{path}/_buckets"


def write_pages(pages: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store (url, html) under ``path`` in ``buckets`` buckets by URL, sorted, and return the table.

    Of several documents of a URL the one with the greatest text stays (reduce them by another
    rule before); rows without a URL are left out. What was stored there before is replaced.
    A bucket should fit a task: pages of a hundred bytes times the number of buckets up to some
    hundred megabytes each.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark = pages.sparkSession
    one = latest_pages(pages.where(F.col("url").isNotNull()).select("url", "html"), F.col("html"))
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    writer = one.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url")
    writer.mode("overwrite").option("path", path).format("parquet").saveAsTable(_name(path))
    versions.update(spark, _about(path), lambda _: {"buckets": buckets})
    return read_pages(spark, path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages stored by ``write_pages``, in this or another session: a scan whose rows Spark
    knows to be dealt out by URL."""
    _, about = versions.latest(spark, _about(path))
    if about is None:
        raise ValueError(f"no page table in {path}")
    # only this session's catalog learns of the table; the files stay as they are
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({schemas.PAGE}) USING parquet "
        f"CLUSTERED BY (url) SORTED BY (url) INTO {int(about['buckets'])} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_name(path))
