"""Catalog building on Spark: listings + pages + model responses -> clean SKU rows."""
