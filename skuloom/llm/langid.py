"""Language identification by fusing evidence with Bayes' rule.

Log posterior of a language = tempered text likelihood (byte trigrams) + declared language +
address suffix + prior of the host. Declared values and suffixes count by how often they go
with each language in this corpus, and a host's prior is smoothed towards its domain's, that
towards the corpus; all of it comes from grouped counts over all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import SLICE_ROWS, append_result, pick, position_of, positions, without
from skuloom.llm.html_main import host_of, visible_text
from skuloom.session import materialize

BUCKETS = 1 << 16
# Declared languages with this many trigrams of text get a model, however few of all rows they are;
# rows of the others are kept on their declaration.
LEAST_TRIGRAMS = 5_000
# languages counted at once in a task before they are handed on (half a megabyte each)
HELD = 64
UNKNOWN = "und"
# a text counts as this many independent trigrams at most
EVIDENCE_TRIGRAMS = 150.0
# pseudo-counts towards the parent in host, domain and corpus, and for rates of other evidence
HOST_WEIGHT, DOMAIN_WEIGHT, RATE_WEIGHT = 20.0, 50.0, 5.0
UNKNOWN_PRIOR = 1e-3
LEAST_POSTERIOR = 0.5

_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams around every byte of a letter, in lower case."""
    raw = b" " + (text or "").lower().encode("utf-8").translate(_SPACED) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(16))[b[1:-1] != 32].astype(np.int64)


def _counts(rows: DataFrame) -> DataFrame:
    """Trigram counts (declared, bucket, n) of rows (declared, text), from every row that declares
    a language."""

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def flush():
            for declared, counts in total.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([declared] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    names=["declared", "bucket", "n"],
                )
            total.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for declared, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if declared not in total:
                        if len(total) == HELD:
                            yield from flush()
                        total[declared] = np.zeros(BUCKETS, dtype=np.int64)
                    total[declared] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        yield from flush()

    found = rows.where(~F.col("declared").isin("", UNKNOWN)).select("declared", "text")
    found = found.mapInArrow(run, "declared string, bucket int, n long")
    return found.groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


class Models:
    """Log probabilities of the trigram buckets in each language, held sparsely: what a language
    gives to a bucket it has not seen, and by bucket what the others that have seen it add."""

    def __init__(self, language: np.ndarray, bucket: np.ndarray, n: np.ndarray, size: int):
        totals = np.bincount(language, weights=n, minlength=size)
        # the last one is the unknown language, uniform
        self.floor = np.append(np.log(0.01 / (totals + 0.01 * BUCKETS)), math.log(1.0 / BUCKETS))
        by_bucket = np.argsort(bucket, kind="stable")
        self.language = language[by_bucket].astype(np.int32)
        self.more = np.log((n[by_bucket] + 0.01) / 0.01).astype(np.float32)
        self.first = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))

    def text(self, at: np.ndarray) -> np.ndarray:
        """Summed log probability of the buckets in each language."""
        total = len(at) * self.floor
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            first = self.first[part]
            sizes = self.first[part + 1] - first
            ends = np.cumsum(sizes)
            if not len(ends) or not ends[-1]:
                continue
            entry = np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)
            total += np.bincount(self.language[entry], weights=self.more[entry], minlength=len(total))
        return total


TEXT = T.StructType(
    [T.StructField("n_trigrams", T.LongType()), T.StructField("text_log", T.ArrayType(T.DoubleType()))]
)


def _text_evidence(rows: DataFrame, models: Models, text: str, result: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def make():
        own = shared.value

        def one(value):
            at = trigram_buckets(value)
            if not len(at):
                return 0, [0.0] * len(own.floor)
            return len(at), (own.text(at) * min(1.0, EVIDENCE_TRIGRAMS / len(at))).tolist()

        def every(texts):
            found = [one(t) for t in texts]
            return {"n_trigrams": [f[0] for f in found], "text_log": [f[1] for f in found]}

        return every

    return append_result(rows, [text], make, TEXT, result)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def suffix_of(address: Column) -> Column:
    """Last label of the host of an address, and a two-letter first path segment."""
    host = F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)
    return F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), F.lower(path))


def markup_language(html: Column) -> Column:
    """Language declared by the first html tag, without region."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))


def _by_best(rows: DataFrame, key: str) -> DataFrame:
    """(key, by): how many rows of a key have each language as their best one, as a map."""
    counted = rows.groupBy(key, "best").agg(F.sum("n").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("by"))


def _number(by: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(by, i), F.lit(0))


def _sum(by: Column) -> Column:
    return F.aggregate(F.map_values(by), F.lit(0).cast("long"), lambda acc, x: acc + x)


def _totals(rows: DataFrame, size: int) -> list[int]:
    out = [0] * size
    for best, n in rows.groupBy("best").agg(F.sum("n")).collect():  # a row per language
        out[best] = n
    return out


def _rates(rows: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(value, logs): log P(value | language) per language, last the unknown one."""
    rows = rows.where(F.col(column) != "")
    sums = _totals(rows, len(languages))
    share = _sum(F.col("by")) / (sum(sums) or 1)
    logs = F.zip_with(
        F.lit(list(range(len(languages)))),
        F.lit([float(s) for s in sums]),
        lambda i, s: F.log((_number(F.col("by"), i) + RATE_WEIGHT * share) / (s + RATE_WEIGHT)),
    )
    values = _by_best(rows, column)
    return values.select(F.col(column).alias(f"{column}_key"), F.concat(logs, F.array(F.log(share))).alias(f"{column}_log"))


def _priors(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior_log): language counts of a host, smoothed by its domain and the corpus."""
    rows = rows.groupBy("host", "best").agg(F.sum("n").alias("n"))
    domain = domain_of(F.coalesce("host", F.lit("")))
    hosts = _by_best(rows, "host").withColumn("domain", domain)
    domains = _by_best(rows.withColumn("domain", domain), "domain").withColumnRenamed("by", "d_by")
    totals = _totals(rows, len(languages))
    size = sum(totals) + len(languages)
    d_sum, h_sum = _sum(F.col("d_by")), _sum(F.col("by"))

    def smoothed(i, corpus):
        above = (_number(F.col("d_by"), i) + DOMAIN_WEIGHT * corpus) / (d_sum + DOMAIN_WEIGHT)
        return F.log((_number(F.col("by"), i) + HOST_WEIGHT * above) / (h_sum + HOST_WEIGHT) * (1 - UNKNOWN_PRIOR))

    logs = F.zip_with(F.lit(list(range(len(languages)))), F.lit([(t + 1) / size for t in totals]), smoothed)
    joined = hosts.join(domains, "domain")
    return joined.select(
        F.col("host").alias("host_key"), F.concat(logs, F.array(F.lit(math.log(UNKNOWN_PRIOR)))).alias("prior_log")
    )


def _on_declaration(rows: DataFrame, languages: list[str], trust: float) -> DataFrame:
    """Texts whose declared language has no model keep it: nothing else could name it."""
    rare = (F.col("n_trigrams") > 0) & ~F.col("declared").isin("", UNKNOWN, *languages)
    return rows.withColumns(
        {
            "language": F.when(rare, F.col("declared")).otherwise(F.col("language")),
            "posterior": F.when(rare, trust).otherwise(F.col("posterior")),
            "kept": rare | F.col("kept"),
        }
    )


def _fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` (text_log, n_trigrams, declared, suffix, host, ..) with language, posterior, kept."""
    if not languages:  # no language has a model
        unknown = rows.withColumn("language", F.lit(UNKNOWN)).withColumn("posterior", F.lit(0.0))
        return _on_declaration(unknown.withColumn("kept", F.lit(False)), languages, 1.0)
    best = F.array_position("text_log", F.array_max("text_log")) - 1
    rows = rows.withColumn("best", F.when(F.col("n_trigrams") > 0, best.cast("int")))
    # only texts with a clear winner teach the other evidence
    second = F.get(F.sort_array("text_log", asc=False), F.lit(1))
    clear = rows.where((F.array_max("text_log") - second > 3) & (F.col("best") < len(languages)))
    clear = materialize(
        clear.groupBy("declared", "suffix", "host", "best").agg(F.count(F.lit(1)).alias("n")), "language-evidence"
    )
    declared, suffix = _rates(clear, "declared", languages), _rates(clear, "suffix", languages)
    joined = rows.join(_priors(clear, languages), F.col("host").eqNullSafe(F.col("host_key")), "left")
    joined = joined.join(declared, F.col("declared") == F.col("declared_key"), "left")
    joined = joined.join(suffix, F.col("suffix") == F.col("suffix_key"), "left")
    flat_log = math.log((1 - UNKNOWN_PRIOR) / len(languages))
    default = F.lit([flat_log] * len(languages) + [math.log(UNKNOWN_PRIOR)])
    none = F.lit([0.0] * (len(languages) + 1))
    parts = [F.coalesce("prior_log", default), F.coalesce("declared_log", none), F.coalesce("suffix_log", none)]
    total = F.col("text_log")
    for part in parts:
        total = F.zip_with(total, part, lambda x, y: x + y)
    joined = joined.withColumn("log", total).withColumn("most", F.array_max("log"))
    share = F.aggregate("log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("most")))
    winner = F.get(F.lit([*languages, UNKNOWN]), F.array_position("log", F.col("most")).cast("int") - 1)
    joined = joined.withColumn("language", F.when(F.col("n_trigrams") > 0, winner).otherwise(UNKNOWN))
    joined = joined.withColumn("posterior", F.when(F.col("n_trigrams") > 0, 1 / share).otherwise(0.0))
    joined = joined.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST_POSTERIOR))
    # how often declarations are right where a model can tell
    named = clear.where(F.col("declared").isin(languages))
    right = F.col("declared") == F.get(F.lit(languages), F.col("best"))
    agree, told = named.agg(
        F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    return _on_declaration(joined, languages, (agree + RATE_WEIGHT) / (told + RATE_WEIGHT))


def _evidence(plain: DataFrame, text: str, declared: Column, address: Column | None, host: Column) -> tuple[DataFrame, list[str]]:
    suffix = suffix_of(F.coalesce(address, F.lit(""))) if address is not None else F.lit("")
    rows = plain.select(
        "*",
        F.lower(F.trim(F.coalesce(declared.cast("string"), F.lit("")))).alias("declared"),
        # no host and no path: nothing to count
        F.when(suffix != "/", suffix).otherwise("").alias("suffix"),
        host.cast("string").alias("host"),
    )
    named = rows.withColumnRenamed(text, "text") if text != "text" else rows
    counts = materialize(_counts(named), "language-counts")
    sizes = counts.groupBy("declared").agg(F.sum("n").alias("size")).where(F.col("size") >= LEAST_TRIGRAMS)
    languages = sorted(r[0] for r in sizes.collect())  # at most one per LEAST_TRIGRAMS trigrams of text
    # at most BUCKETS rows per language
    table = counts.join(sizes, "declared", "left_semi").select("declared", "bucket", "n").toArrow()
    place = {n: i for i, n in enumerate(languages)}
    names = table.column(0).combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    number = np.array([place[n] for n in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy()]
    models = Models(number, table.column(1).to_numpy(), table.column(2).to_numpy(), len(languages))
    return _text_evidence(named, models, "text", "_text_").select("*", "_text_.*"), languages


def identify(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    declared_column: str = "lang",
    host_column: str = "source",
    address_column: str | None = None,
) -> DataFrame:
    """One row per document: id, language, posterior, kept, n_trigrams.

    Every declared value with at least ``LEAST_TRIGRAMS`` trigrams of text has a text model,
    learned from the rows that declare it. A text that fits none better than chance is "und".
    Rows are kept whose language is known with a posterior of at least ``LEAST_POSTERIOR``.
    Texts that declare a language with less text keep it and are kept; their posterior is the
    rate at which declarations of modelled languages agree with the text. "und" declares nothing.

    Null and empty texts, and texts without letters, are "und" with posterior 0. Null
    declarations, addresses and hosts give no evidence (a null host is one host). Null ids and
    repeated rows keep a row each. Ties go to the first language by name. Long texts count as
    ``EVIDENCE_TRIGRAMS`` independent trigrams, averaged over the whole text. Without any declared
    language all is "und". Further columns are ignored.
    """
    names = [id_column, text_column, declared_column, host_column] + [address_column] * (address_column is not None)
    rows = positions(pick(documents, *names))
    address = F.col("c4") if address_column is not None else None
    scored, languages = _evidence(rows, "c1", F.col("c2"), address, F.col("c3"))
    scored = materialize(scored.select("c0", "declared", "suffix", "host", "n_trigrams", "text_log"), "language-text")
    return _fuse(scored, languages).select(
        F.col("c0").alias(id_column), "language", "posterior", "kept", "n_trigrams"
    )


def identify_tables(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per row of either table: table, doc_id or page_id, and what ``identify`` gives.

    Documents (doc_id, text, lang, source) have text, declaration and source; pages (page_id,
    url, html) have their visible text, the language their markup declares, and host, suffix
    and language segment of their address. All evidence is counted over both tables together.
    """
    docs = pick(documents, "doc_id", "text", "lang", "source").toDF("doc_id", "text", "declared", "host")
    web = visible_text(pick(pages, "page_id", "url", "html").toDF("page_id", "url", "html"), "html", "visible")
    key = lambda table, doc_id, page_id: F.struct(
        F.lit(table).alias("table"), doc_id.alias("doc_id"), page_id.alias("page_id")
    ).alias("key")
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
    both = docs.select(
        key("documents", F.col("doc_id"), none(web, "page_id")),
        "text", F.col("declared").cast("string").alias("declared"), F.col("host").cast("string").alias("host"),
        F.lit(None).cast("string").alias("address"),
    ).unionByName(
        web.select(
            key("pages", none(docs, "doc_id"), F.col("page_id")),
            F.col("visible.text").alias("text"),
            markup_language(F.col("html")).alias("declared"),
            host_of(F.col("url")).alias("host"),
            F.col("url").alias("address"),
        )
    )
    found = identify(materialize(both, "language-rows"), "key", "text", "declared", "host", "address")
    return found.select("key.*", *[c for c in found.columns if c != "key"])


def keep_known(
    documents: DataFrame,
    text_column: str = "text",
    declared_column: str = "lang",
    host_column: str = "source",
) -> DataFrame:
    """``documents`` (all columns) without those that ``identify`` does not keep.

    The verdict depends on text, declaration and host alone, so equal ones share it.
    """
    names, plain = documents.columns, positions(documents)
    at = [F.col(f"c{position_of(documents, n)}") for n in (text_column, declared_column, host_column)]
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in reversed(at)]).cast("binary"))
    rows = plain.select(digest.alias("digest"), at[0].alias("text"), at[1].alias("d"), at[2].alias("h"))
    scored, languages = _evidence(rows, "text", F.col("d"), None, F.col("h"))
    scored = materialize(scored.select("digest", "declared", "suffix", "host", "n_trigrams", "text_log"), "language-text")
    rejected = _fuse(scored, languages).where(~F.col("kept")).select(F.col("digest").alias("r_digest")).distinct()
    rejected = materialize(rejected, "language-rejected")
    keyed = plain.withColumn("digest", digest)
    return without(keyed, "digest", rejected, F.col("digest") == F.col("r_digest")).drop("digest").toDF(*names)
