"""Incremental processing of page documents as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skuloom import schemas
from skuloom.operators import extract as ex
from skuloom.plans.catalog import save_batch
from skuloom.session import materialize
from skuloom.sources import state


def page_stream(
    spark: SparkSession, path: str, *, glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Page documents of a folder as a stream."""
    return (
        spark.readStream.schema(schemas.PAGE)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def process_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run ``handle`` on everything new since the last call and stop.

    A batch that fails is repeated with the same id; ``handle`` has to write it
    under that id so that the repetition replaces it.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _writer_of(spark: SparkSession, checkpoint: str) -> str:
    """Name of the stream that owns a checkpoint folder, kept inside it: a new folder is a new
    writer, whose batch numbers start again."""
    path = f"{checkpoint}/writer"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = f"stream-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(name).alias("value")).coalesce(1).write.text(path)
    return name


def save_pages(
    pages: DataFrame,
    families: DataFrame,
    root: str,
    batch: state.Batch,
    *,
    model_responses: DataFrame | None = None,
    source: str = "catalog",
    scraped_at: str | None = None,
) -> None:
    """Extract and store pages and those that waited for a listing; keep what still waits.

    URLs that were completed by other batches are skipped. A page is stored once while it
    waits; when its listing is there, a mark says so. Documents of waiting pages are read
    only if some of them have a listing now. All tables of the batch change together.
    """
    spark = pages.sparkSession
    done = state.completed_before(spark, root, batch)
    fresh = ex.latest_pages(pages.select("url", "html"), F.col("html"))
    docs = materialize(fresh.join(done, "url", "left_anti"), "stream-pages")
    listed = families.select(F.col("product_url").alias("url"))
    waiting = state.waiting_urls(spark, root, batch)
    todo = docs
    if waiting is not None:
        for known in (done, docs.select("url")):
            waiting = waiting.join(known, "url", "left_anti")
        found = materialize(waiting.join(listed, "url", "left_semi"), "stream-waiting")
        if not found.isEmpty():
            todo = docs.unionByName(state.stored_pages(spark, root, found))
    paired = families.join(todo.withColumnRenamed("url", "product_url"), "product_url")
    extracted = materialize(
        ex.extract_products(paired, source=source, scraped_at=scraped_at, keep=("place",)),
        "stream-extracted",
    )
    others = {
        "pending": docs.join(listed, "url", "left_anti"),
        "taken_up": extracted.select(F.col("product_url").alias("url")).distinct(),
    }
    save_batch(extracted, root, batch, model_responses=model_responses, others=others)


def process_pending(
    spark: SparkSession,
    families: DataFrame,
    root: str,
    *,
    model_responses: DataFrame | None = None,
    source: str = "catalog",
    scraped_at: str | None = None,
) -> None:
    """Take up pages that waited for their listing, when listings came but no pages."""
    batch = state.begin_batch(spark, root, "pending")
    none = spark.read.schema(schemas.PAGE).parquet()
    save_pages(
        none, families, root, batch, model_responses=model_responses, source=source, scraped_at=scraped_at
    )


def process_new_pages(
    stream: DataFrame,
    families: DataFrame,
    root: str,
    checkpoint: str,
    *,
    model_responses: DataFrame | None = None,
    source: str = "catalog",
    scraped_at: str | None = None,
) -> StreamingQuery:
    """Extract and store the pages that arrived; the export is a separate job.

    ``families`` has ``product_url, hit, category_path, place``, one row per URL. A page
    without a listing waits until a later batch (or ``process_pending``) has one. URLs that
    are complete are skipped.
    """
    writer = _writer_of(stream.sparkSession, checkpoint)

    def handle(pages: DataFrame, batch_id: int) -> None:
        batch = state.begin_batch(pages.sparkSession, root, writer, batch_id)
        save_pages(
            pages, families, root, batch, model_responses=model_responses, source=source, scraped_at=scraped_at
        )

    return process_available(stream, handle, checkpoint)
