"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# Rows handled at once inside a task; bounds the Python objects that live together.
SLICE_ROWS = 128


def positions(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed to c0, c1, .. so that clashing names (also those
    that differ in case only) cannot make a reference ambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def position_of(df: DataFrame, name: str) -> int:
    """Index of the column called ``name``; an exact match goes before one in other case."""
    if name in df.columns:
        return df.columns.index(name)
    lower = [c.lower() for c in df.columns]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``, whatever else it carries."""
    plain = positions(df)
    return plain.select(*[F.col(f"c{position_of(df, n)}").alias(n) for n in names])


def append_result(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., dict[str, Sequence]]],
    schema: StructType,
    result: str,
) -> DataFrame:
    """``df`` with a struct column ``result``, computed in Python over Arrow batches.

    ``make()`` runs once per task and returns a function from the lists of the input
    columns (a slice of rows) to one sequence per field of ``schema``. All columns of
    ``df`` pass through untouched; ``result`` must not be one of them.
    """
    out = StructType([*df.schema.fields, StructField(result, schema)])
    fields = to_arrow_schema(schema)
    names = list(df.columns)
    at = [names.index(i) for i in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = function(*[part.column(i).to_pylist() for i in at])
                struct = pa.StructArray.from_arrays(
                    [pa.array(found[f.name], type=f.type) for f in fields], fields=list(fields)
                )
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*names, result])

    return df.mapInArrow(run, out)


def flat(df: DataFrame, result: str) -> DataFrame:
    """The columns of the struct ``result`` beside the others."""
    kept = [c for c in df.columns if c != result]
    return df.select(*kept, f"{result}.*")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` parts at exactly these characters."""
    return [] if text is None else text.encode("utf-8").split()


def lower_words(text: str | None) -> list[bytes]:
    """The same of the text with A-Z in lower case (``bytes.lower`` changes ASCII only)."""
    return [] if text is None else text.encode("utf-8").lower().split()


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# bits of a sieve; its table has at most SIEVE_BITS / 64 rows, whatever goes in
SIEVE_BITS = 1 << 23


def sieved(rows: DataFrame, digest: str, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: false where no row of ``wanted`` (one column) has
    this digest, true where one may have.

    A bitmap of fixed size is broadcast, so that large rows need not be shuffled to find that
    they are not among the wanted ones. It helps less the more is wanted; the result of the
    join that follows does not depend on it.
    """
    bit = F.pmod(F.xxhash64(F.col(digest)), F.lit(SIEVE_BITS))
    named = wanted.toDF("wanted_digest").select(F.pmod(F.xxhash64("wanted_digest"), F.lit(SIEVE_BITS)).alias("bit"))
    words = named.groupBy(F.expr("bit div 64").alias("sieve_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("sieve_bits")
    )
    at = rows.withColumn("sieve_bit", bit)
    joined = at.join(F.broadcast(words), F.expr("sieve_bit div 64") == F.col("sieve_word"), "left")
    found = F.expr("(shiftright(sieve_bits, cast(sieve_bit % 64 as int)) & 1L) = 1L")
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("sieve_bit", "sieve_word", "sieve_bits")


def without(rows: DataFrame, digest: str, removed: DataFrame, match: Column) -> DataFrame:
    """``rows`` without those that ``match`` a row of ``removed`` (which has ``r_digest``);
    only rows that may match take part in the join."""
    marked = sieved(rows, digest, removed.select("r_digest"), "may_match")
    open_rows = marked.where("may_match").join(removed, match, "left_anti")
    return marked.where(~F.col("may_match")).unionByName(open_rows).drop("may_match")
