"""Text functions: whitespace, entities, tags, pack sizes, labelled specs, claims."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from skuloom import fixed_values as fv

# A comment, or a tag whose quoted attribute values may hold ">". The possessive
# quantifiers keep the matcher iterative, so long tags cannot exhaust its stack.
MARKUP = (
    r"(?s)<!--.*?-->"
    r"|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<[a-zA-Z/!?][^>]*+>"
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), fv.WHITESPACE, " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def by_element(function: Callable, kind: pa.DataType) -> Callable:
    """``function`` over the texts of a batch of arrays (nulls stay null).

    At most a thousand texts, of a megabyte together (or one text), become Python objects at a time;
    the others stay in Arrow's memory.
    """

    # Built inside a function so that it is shipped to the workers by value.
    def run(texts: pa.Array) -> pa.Array:
        flat, step, most = texts.flatten(), 1_000, 1 << 20
        read = pc.cumulative_sum(pc.fill_null(pc.binary_length(flat), 0).cast(pa.int64())).to_numpy()
        parts, i = [], 0
        while i < len(flat):
            fit = int(read.searchsorted((read[i - 1] if i else 0) + most, "right"))
            end = min(max(fit, i + 1), i + step)
            parts.append(pa.array([None if t is None else function(t) for t in flat[i:end].to_pylist()], kind))
            i = end
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(texts), 0))
        starts = pa.concat_arrays([pa.array([0], ends.type), ends])
        values = pa.concat_arrays(parts) if parts else pa.array([], kind)
        return pa.ListArray.from_arrays(starts, values, mask=texts.is_null())

    return run


# Both are not deterministic for the optimizer: filters above stay above, so neither
# they nor the page parsing below are evaluated a second time for them.
def _entity_decoder():
    decode = by_element(lambda t: html.unescape(t), pa.string())
    return F.arrow_udf(decode, ArrayType(StringType())).asNondeterministic()


def _entity_cleaner():
    markup = re.compile(MARKUP)

    def clean(text):
        decoded = html.unescape(text)
        return {"decoded": decoded, "plain": html.unescape(markup.sub(" ", decoded))}

    kind = pa.struct([("decoded", pa.string()), ("plain", pa.string())])
    return F.arrow_udf(by_element(clean, kind), "array<struct<decoded:string,plain:string>>").asNondeterministic()


def _with_entity(texts: Column) -> Column:
    """``texts`` if one of them has an '&', else null."""
    return F.when(F.exists(texts, lambda t: F.coalesce(F.contains(t, F.lit("&")), F.lit(False))), texts)


def decode_entities(texts: Column) -> Column:
    """HTML entities of an array of texts. Arrays without '&' never leave the JVM."""
    return F.coalesce(_entity_decoder()(_with_entity(texts)), texts)


def drop_markup(c: Column) -> Column:
    return F.regexp_replace(c, MARKUP, " ")


def with_plain_text(df: DataFrame, source: str, decoded: str, plain: str, **beside: Column) -> DataFrame:
    """Add two arrays made from the text array ``source``.

    ``decoded`` has entities resolved once; ``plain`` has them resolved, the
    markup dropped, what then still looks like an entity resolved again and the
    whitespace squeezed (blank becomes null). Both come from one Python function, and columns
    ``beside`` them that have one too share its worker: a task has one, not one per function.
    """
    cleaned = f"__{plain}"
    own = lambda name: F.transform(cleaned, lambda c: c[name])
    stripped = F.coalesce(own("plain"), F.transform(source, drop_markup))
    return (
        df.withColumns({cleaned: _entity_cleaner()(_with_entity(F.col(source))), **beside})
        .withColumns(
            {
                decoded: F.coalesce(own("decoded"), F.col(source)),
                plain: F.transform(stripped, lambda t: blank_to_null(squeeze(t))),
            }
        )
        .drop(cleaned)
    )


def html_to_text(df: DataFrame, source: str, target: str) -> DataFrame:
    """``with_plain_text`` for a single text column."""
    return (
        df.withColumn("__text", F.array(source))
        .transform(with_plain_text, "__text", "__decoded", "__plain")
        .withColumn(target, F.get("__plain", F.lit(0)))
        .drop("__text", "__decoded", "__plain")
    )


def pack_size(c: Column) -> Column:
    """First pack-size rule that matches, in its original spelling; else null."""
    found = [blank_to_null(F.regexp_extract(c, p, 0)) for p in fv.PACK_SIZE_PATTERNS]
    return blank_to_null(squeeze(F.coalesce(*found)))


def labelled_specs(decoded: Column) -> Column:
    """``Label: value`` lines of an entity-decoded text as a map; last label wins."""
    lines = F.filter(F.split(decoded, fv.LINE_BREAKS), lambda l: F.contains(l, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            squeeze(F.substring_index(l, ":", 1)).alias("key"),
            squeeze(F.substr(l, F.instr(l, ":") + 1)).alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: F.length(p["key"]).between(1, fv.SPEC_KEY_MAX) & (p["value"] != ""),
    )
    return F.coalesce(
        F.map_from_entries(kept), F.create_map().cast("map<string,string>")
    )


# --- comparing pack sizes with their evidence --------------------------------


def match_text(decoded: Column) -> Column:
    """Comparable form: folded, ``.5`` as ``0.5``, only numbers and words, aliases applied."""
    folded = F.regexp_replace(casefold(decoded), fv.MATCH_LEADING_DOT, "0.")
    aliases = F.create_map(*[F.lit(x) for pair in fv.MATCH_ALIASES.items() for x in pair])
    tokens = F.regexp_extract_all(folded, F.lit(fv.MATCH_TOKEN), 0)
    return F.array_join(
        F.transform(tokens, lambda t: F.coalesce(F.element_at(aliases, t), t)), " "
    )


def canonical_quantity(c: Column) -> Column:
    no_leading = F.regexp_replace(c, r"^0+(?=\d)", "")
    no_trailing = F.regexp_replace(no_leading, r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(no_trailing, r"\.$", "")


def _claims_of(text: Column, pattern: str, kind: str, quantity: int, unit: int) -> Column:
    def claim(found: Column) -> Column:
        amount = F.regexp_extract(found, pattern, quantity)
        return F.struct(
            F.lit(kind).alias("kind"),
            (canonical_quantity(amount) if kind == "measure" else amount).alias("quantity"),
            F.regexp_extract(found, pattern, unit).alias("unit"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), claim)


def pack_claims(matchable: Column) -> Column:
    """Distinct (kind, quantity, unit) claims of a text in ``match_text`` form."""
    text = matchable
    for noise in fv.CLAIM_NOISE:
        text = F.regexp_replace(text, noise, " ")

    def claims(clean: Column) -> Column:
        return F.array_distinct(
            F.concat(
                _claims_of(clean, fv.CLAIM_COUNT, "count", 1, 2),
                _claims_of(clean, fv.CLAIM_CONTAINER_OF, "count", 2, 1),
                _claims_of(clean, fv.CLAIM_MEASURE, "measure", 1, 2),
            )
        )

    # the three rules look at one text: it is made once, as the variable of a lambda
    return F.get(F.transform(F.array(text), claims), F.lit(0))


def is_verbal_evidence(matchable: Column) -> Column:
    return F.rlike(matchable, F.lit(fv.VERBAL_COUNT)) & F.rlike(matchable, F.lit(fv.VERBAL_EACH))


def is_pack_descriptor(matchable: Column) -> Column:
    return F.rlike(matchable, F.lit(fv.PACK_DESCRIPTOR))


class Evidence(NamedTuple):
    pack: Column
    evidence: Column
    source: Column


def claims_agree(claims: Evidence) -> Column:
    """At least one claim is made by the pack size, its evidence and the source."""
    return F.size(
        F.array_intersect(F.array_intersect(claims.pack, claims.evidence), claims.source)
    ) > 0


def with_evidence_check(
    df: DataFrame, pack: str, evidence: str, source: str, target: str
) -> DataFrame:
    """Boolean ``target``: the source text supports the pack size and its evidence."""
    names = ("__pack", "__evidence", "__source")
    staged = df.withColumn("__decoded", decode_entities(F.array(pack, evidence, source)))
    staged = staged.withColumns(
        {n: match_text(F.get("__decoded", F.lit(i))) for i, n in enumerate(names)}
    )
    staged = staged.withColumns({f"{n}_claims": pack_claims(F.col(n)) for n in names})
    text = Evidence(*(F.col(n) for n in names))
    claims = Evidence(*(F.col(f"{n}_claims") for n in names))
    quoted = (text.evidence != "") & F.contains(text.source, text.evidence)
    wording = is_verbal_evidence(text.evidence) | (
        is_pack_descriptor(text.pack) & F.contains(text.evidence, text.pack)
    )
    supported = claims_agree(claims) | (quoted & wording)
    return staged.withColumn(target, F.coalesce(supported, F.lit(False))).drop(
        "__decoded", *names, *(f"{n}_claims" for n in names)
    )


def normalized_tags(values: Column) -> Column:
    """Squeezed, folded, blank-free tags in first-seen order."""
    tags = F.transform(values, lambda v: casefold(squeeze(v)))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))
