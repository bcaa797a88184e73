"""The whole job: seeds, pages, search and model responses in; catalog out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.operators import enrich as en
from skuloom.operators import extract as ex
from skuloom.operators import listings as li
from skuloom.operators import validate as va
from skuloom.operators.dedup import run_summary
from skuloom.operators.match import similar_products
from skuloom.schemas import PARSER_VERSION, PRODUCT_COLUMNS
from skuloom.session import materialize, prepare, scratch_scope
from skuloom.sources import ledger, state
from skuloom.sources.export import write_csv, write_json

SUMMARY = (
    "categories_attempted bigint, product_pages_attempted bigint, product_rows_exported bigint, failures bigint"
)
Stage = Callable[[DataFrame], DataFrame]


def families_to_visit(
    configs: DataFrame, responses: DataFrame, completed: DataFrame, limit: int | None
) -> DataFrame:
    """Listings left to do, each URL's candidates ranked in ``attempt``.

    The limit counts families before finished ones are skipped, so a limited run
    that is resumed does not move on to further families.
    """
    hits = li.hits_of(li.pages_in_bounds(responses))
    families = (
        li.attach_category(hits, configs)
        .transform(li.with_family_url)
        .transform(li.first_in_category)
        .transform(li.limit_per_category, limit)
        .transform(li.ranked_across_categories)
        .transform(li.not_completed, completed)
    )
    return families.select(
        "product_url",
        "hit",
        "category_path",
        "attempt",
        F.struct("category_ord", "page_no", "pos").alias("place"),
    )


def extract_families(
    families: DataFrame, pages: DataFrame, *, source: str, scraped_at: str | None
) -> DataFrame:
    """Extract every URL from its first listing that raises no error, with a row for each that does.

    Pages are scanned, joined and parsed once, however many categories list a URL.
    """
    paired = ex.attach_listings(ex.listings_of(families), pages)
    return materialize(
        ex.extract_listed(paired, source=source, scraped_at=scraped_at, keep=("place", "attempt")),
        "extracted",
    )


def save_batch(
    extracted: DataFrame,
    root: str,
    batch: state.Batch,
    *,
    model_responses: DataFrame | None = None,
    stage: Stage | None = None,
    other_failures: DataFrame | None = None,
    others: dict[str, DataFrame] | None = None,
) -> None:
    """Validate, enrich and store one batch: products, failures, completed URLs, and ``others``.

    They appear together, so a batch that is cut short leaves nothing and is done again. A
    page whose rows were all rejected is complete; a failed page is not.
    """
    checked = va.check_required(ex.good_rows(extracted))
    rows = va.accepted(checked)
    failures = ex.page_failures(extracted).unionByName(va.rejected(checked))
    if stage is not None:
        rows = rows.transform(stage)
    if model_responses is not None:
        rows = materialize(en.enrich(rows, model_responses), "enriched")
        failures = failures.unionByName(en.enrichment_failures(rows))
    if other_failures is not None:
        failures = failures.unionByName(other_failures)
    tables = {
        "products": rows.select(
            *PRODUCT_COLUMNS, "place", "ordinal", F.lit(PARSER_VERSION).alias("parser_version")
        ),
        "failures": failures,
        "completed": ex.good_rows(extracted).select(F.col("product_url").alias("url")).distinct(),
    }
    state.commit(extracted.sparkSession, root, batch, tables | (others or {}))


def export_current(
    spark: SparkSession,
    root: str,
    *,
    max_alternatives: int = fv.MAX_ALTERNATIVES,
    min_score: float = fv.MIN_SCORE,
) -> DataFrame:
    """Export all saved rows with their alternatives; can be run at any time."""
    latest = materialize(state.latest_products(spark, root), "latest")
    final = materialize(
        similar_products(latest, max_alternatives=max_alternatives, min_score=min_score), "final"
    )
    write_json(final, f"{root}/products_json")
    write_csv(final, f"{root}/products_csv")
    return final


def run(
    spark: SparkSession,
    root: str,
    *,
    seeds: DataFrame,
    category_pages: DataFrame,
    responses: DataFrame,
    pages: DataFrame,
    model_responses: DataFrame | None = None,
    model: Callable | None = None,
    stage: Stage | None = None,
    mode: str = "auto",
    limit_per_category: int | None = None,
    source: str = "catalog",
    scraped_at: str | None = None,
    max_alternatives: int = fv.MAX_ALTERNATIVES,
    min_score: float = fv.MIN_SCORE,
) -> DataFrame:
    """Build or extend the catalog under ``root``; returns the run summary row.

    Leaves state, exports, the summary and the run's metrics (``sources.ledger``) there; its own
    intermediate results are deleted. With a ``model`` (see ``enrich.answer_requests``) the products
    of the run are enriched by its answers, of which those given before are kept.
    """
    prepare(spark)
    with scratch_scope(spark):
        batch = state.begin(spark, root, mode)
        configs = materialize(li.category_configs(seeds, category_pages), "configs")
        usable = li.usable_configs(configs)
        mine = responses.join(usable.select("category_url"), "category_url")
        families = materialize(
            families_to_visit(usable, mine, state.completed_urls(spark, root), limit_per_category),
            "families",
        )
        extracted = extract_families(families, pages, source=source, scraped_at=scraped_at)
        if model is not None:
            good = va.accepted(va.check_required(ex.good_rows(extracted)))
            asked = materialize(good if stage is None else good.transform(stage), "asked-products")
            answers = en.model_answers(asked, model, root)
            model_responses = answers if model_responses is None else model_responses.unionByName(answers)
        save_batch(
            extracted,
            root,
            batch,
            model_responses=model_responses,
            stage=stage,
            other_failures=li.discovery_failures(configs).unionByName(li.traversal_failures(mine, limit_per_category)),
        )
        exported = export_current(
            spark, root, max_alternatives=max_alternatives, min_score=min_score
        )
        summary = materialize(
            run_summary(
                seeds,
                extracted.select("product_url", "attempt").distinct(),
                exported,
                state.read(spark, root, "failures").filter(F.col("seq") == batch.seq),
            ),
            "summary",
        )
        summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary")
        latest = state.latest_products(spark, root, "parser_version")
        own = state.read(spark, root, "failures").filter(F.col("seq") == batch.seq)
        ledger.record(
            spark, root, ledger.product_metrics(latest).unionByName(ledger.run_metrics(summary, own))
        )
    return spark.read.schema(SUMMARY).json(f"{root}/summary")
