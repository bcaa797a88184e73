"""Dropping rows that cannot have a partner before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# bits of the bitmap; its table has at most BITS / 64 rows of 16 bytes, whatever goes in
BITS = 1 << 23


def possible_keys(rows: DataFrame, column: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted`` (one column).

    A bitmap of the hashes of the wanted keys is broadcast; its size is fixed. Rows that pass
    still have to be joined. The more keys are wanted, the fewer rows it drops: of n wanted
    keys, about a share of n / ``bits`` of the other rows passes. Null keys are dropped.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = (
        wanted.toDF("__key")
        .select(place(F.col("__key")).alias("__bit"))
        .groupBy(F.expr("__bit div 64").alias("__word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__bit % 64 as int)))").alias("__marks"))
    )
    at = rows.where(F.col(column).isNotNull()).withColumn("__bit", place(F.col(column)))
    passed = F.expr("(shiftright(__marks, cast(__bit % 64 as int)) & 1L) = 1L")
    joined = at.join(F.broadcast(marks), F.expr("__bit div 64") == F.col("__word"))
    return joined.where(passed).select(*rows.columns)
