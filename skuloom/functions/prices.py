"""Prices from numbers, text, markup and nested objects."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions.loose_json import kind
from skuloom.functions.text import by_element

PRICE_TYPE = "array<struct<amount:double,bad:string>>"


def _captured(text: Column) -> Column:
    patterns = (fv.PRICE_ATTRIBUTE, fv.PRICE_DOLLAR, fv.PRICE_BARE)
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
    return F.replace(F.coalesce(*found), F.lit(","), F.lit(""))


def scalar_price(value: Column) -> Column:
    """``struct<amount, bad>`` of a JSON number or string; nulls for other types.

    ``bad`` is the captured text when it looks like a price but is not a number.
    """
    k = kind(value)
    captured = F.when(k == "STRING", _captured(F.try_variant_get(value, "$", "string")))
    number = F.when(
        ~k.isin("STRING", "BOOLEAN", "VOID", "OBJECT", "ARRAY"),
        F.try_variant_get(value, "$", "double"),
    )
    amount = F.coalesce(number, captured.try_cast("double"))
    return F.struct(
        amount.alias("amount"),
        F.when(amount.isNull(), captured).alias("bad"),
    )


def _object_reader():
    keys = fv.PRICE_KEYS
    patterns = [re.compile(p) for p in (fv.PRICE_ATTRIBUTE, fv.PRICE_DOLLAR, fv.PRICE_BARE)]

    def leaves(node):
        """Scalars of a nested price, most trusted key first."""
        if not isinstance(node, dict):
            yield node
            return
        inner = [node[k] for k in keys if k in node]
        for child in inner or (node.values() if len(node) == 1 else ()):
            yield from leaves(child)

    def read(text):
        for leaf in leaves(json.loads(text)):
            if isinstance(leaf, (int, float)) and not isinstance(leaf, bool):
                return {"amount": float(leaf), "bad": None}
            if isinstance(leaf, str):
                match = next((m for m in (p.search(leaf) for p in patterns) if m), None)
                if match:
                    captured = match.group(1).replace(",", "")
                    try:
                        return {"amount": float(captured), "bad": None}
                    except ValueError:
                        return {"amount": None, "bad": captured}
        return {"amount": None, "bad": None}

    price = pa.struct([("amount", pa.float64()), ("bad", pa.string())])
    return F.arrow_udf(by_element(read, price), PRICE_TYPE).asNondeterministic()


def nested_prices(values: Column) -> Column:
    """Prices of the objects among ``values`` (null elsewhere).

    Only the objects' JSON text goes to Python; rows without any send null.
    """
    texts = F.transform(values, lambda v: F.when(kind(v) == "OBJECT", F.to_json(v)))
    return _object_reader()(F.when(F.exists(texts, lambda t: t.isNotNull()), texts))
