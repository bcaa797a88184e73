"""Column expressions that are built once."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext

# of the context that the expressions were made in; another one starts anew
_KEPT: dict[Any, Any] = {}


def kept(build: Callable) -> Callable:
    """``build`` whose result is made once per Spark context and arguments.

    A column says nothing about rows, so it can be used for any number of DataFrames. Large
    expressions take thousands of calls to the JVM; a stream would make them for every batch.
    Not for columns with Python functions.
    """

    @functools.wraps(build)
    def columns(*args):
        context = SparkContext._active_spark_context
        if _KEPT.get("context") is not context:
            _KEPT.clear()
            _KEPT["context"] = context
        key = (build, args)
        if key not in _KEPT:
            _KEPT[key] = build(*args)
        return _KEPT[key]

    return columns
