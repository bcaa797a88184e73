"""Final exports: JSON Lines and CSV, sorted by SKU, columns in name order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE_COLUMNS = ("pack_size_evidence", "pack_size_confidence")


def _all_specifications(products: DataFrame) -> Column:
    """Specifications with the typed side columns put back, keys sorted."""
    entries = F.transform(
        F.map_entries("specifications"),
        lambda e: F.struct(e["key"].alias("key"), e["value"].cast("variant").alias("value")),
    )
    sides = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(F.lit(name).alias("key"), F.col(name).cast("variant").alias("value")),
        )
        for name in SIDE_COLUMNS
        if name in products.columns
    ]
    merged = F.map_from_entries(F.concat(entries, F.array_compact(F.array(*sides)))) if sides else (
        F.map_from_entries(entries)
    )
    keys = F.array_sort(F.map_keys(merged))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(merged, k)))


def export_view(products: DataFrame) -> DataFrame:
    """What is exported: merged specifications, ISO timestamps, names in order."""
    shaped = {
        "specifications": _all_specifications(products),
        "scraped_at": F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
    }
    if "alternative_products" in products.columns:
        shaped["alternative_products"] = F.transform(
            "alternative_products",
            lambda a: F.struct(
                *[
                    a[name].alias(name)
                    for name in (
                        "method", "product_name", "product_url", "reason", "score", "sku", "source",
                    )
                ]
            ),
        )
    names = sorted(c for c in products.columns if c not in SIDE_COLUMNS)
    return products.select(*[shaped.get(c, F.col(c)).alias(c) for c in names])


def nested_as_json(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(
        *[
            F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name)
            if f.dataType.typeName() in nested
            else F.col(f.name)
            for f in df.schema
        ]
    )


def write_json(products: DataFrame, path: str) -> None:
    export_view(products).orderBy("sku").write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(products: DataFrame, path: str) -> None:
    nested_as_json(export_view(products)).orderBy("sku").write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue=""
    )
