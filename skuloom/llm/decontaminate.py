"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows form a set of hashes that is broadcast; every window of every
document is hashed inside one generated loop and looked up; hits are verified on the words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import pick, position_of, positions, sieved, without
from skuloom.session import materialize

# words of text whose A-Z are in lower case: ASCII letters and digits, and all beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Benchmark windows up to this number, and of at most so many bytes with their items, are
# broadcast; beyond, Spark joins by shuffle.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 200_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay (``lower`` would change them too)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _window_hash(array: str, at: str, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), F.col(at) + k) for k in range(width)])


def benchmark_windows(
    benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """Distinct windows (width, hash, window, items) of all items."""
    rows = pick(benchmark, id_column, text_column).toDF("item", "text")
    rows = rows.select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width")))
    each = rows.select("item", "w", "width", starts.alias("at")).select(
        "item", "width", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("width"))).alias("window")
    )
    merged = each.groupBy("width", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    split = F.split("window", " ", -1)
    hashed = F.lit(None).cast("long")
    for width in range(1, window + 1):
        hashed = F.when(F.col("width") == width, _window_hash("v", "zero", width)).otherwise(hashed)
    return (
        merged.withColumn("v", split)
        .withColumn("zero", F.lit(0))
        .select("width", hashed.alias("hash"), "window", "items")
    )


def find_windows(rows: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, .., n_words, at, width, items): for each row of ``rows`` (which has an array ``w``
    of words) one line with ``at`` = -1, and one for each place where a window occurs."""
    # widths below the full one exist only for items of fewer words: at most window - 1
    short = [r[0] for r in windows.where(F.col("width") < window).select("width").distinct().collect()]
    weight = F.octet_length("window") + F.aggregate("items", F.lit(64), lambda acc, x: acc + F.octet_length(x) + 8)
    n_windows, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    kept = [c for c in rows.columns if c != "w"]
    base = rows.withColumn("n_words", F.size("w").cast("long"))
    each = base.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    inside = lambda width: (F.col("at") >= 0) & (F.col("at") + width <= F.size("w"))
    if short:
        options = [
            F.struct(F.lit(k).alias("k"), F.when(inside(k), _window_hash("w", "at", k)).alias("h"))
            for k in sorted(short)
        ]
        full = F.struct(
            F.lit(window).alias("k"), F.when(inside(window), _window_hash("w", "at", window)).alias("h")
        )
        each = each.select("*", F.explode(F.array(full, *options)).alias("o")).select("*", "o.k", "o.h")
    else:
        each = each.withColumn("k", F.lit(window)).withColumn(
            "h", F.when(inside(window), _window_hash("w", "at", window))
        )
    known = windows.select(
        F.col("width").alias("width"), F.col("hash").alias("b_hash"), F.col("window").alias("b_window"), "items"
    )
    found = F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("k")))
    if n_windows <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES:
        # Two inequalities, so that the words are joined to text only where the hash is equal.
        joined = each.join(
            F.broadcast(known),
            (F.col("h") == F.col("b_hash"))
            & (F.col("k") == F.col("width"))
            & (F.col("b_window") >= found)
            & (F.col("b_window") <= found),
            "left",
        )
    else:
        # Only places whose hash a bitmap of fixed size has go on, with the words there as text; the
        # array of all words stays. First lines go by a hash of their own, as no window can match them.
        first = F.col("at") == -1
        if short:
            first = first & (F.col("k") == window)
        lines = sieved(each.where(first | F.col("h").isNotNull()), "h", windows.select("hash"), "may_match")
        lines = lines.where(first | F.col("may_match")).select(
            *kept, "n_words", "at", "k",
            F.coalesce("h", F.xxhash64("n_words", *kept)).alias("h"), F.when(~first, found).alias("found"),
        )
        joined = lines.join(
            known, (F.col("h") == F.col("b_hash")) & (F.col("k") == F.col("width")) & (F.col("found") == F.col("b_window")), "left"
        )
    base_line = F.col("at") == -1
    if short:
        base_line = base_line & (F.col("k") == window)
    return joined.where(base_line | F.col("width").isNotNull()).select(*kept, "n_words", "at", "width", "items")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (structs at, end)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], acc["last"]))).cast("long").alias("n"),
        F.greatest(acc["last"], s["end"]).alias("last"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def scan(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole; a word
    of a document inside any occurrence of a window is hit. ``spans`` holds the occurrences
    as (at, end) word positions, end exclusive.

    Null and empty texts have no words; items without words have no window. Null item ids
    mark words but are no item; items that share an id count once. Null document ids and
    repeated rows keep a row each. Without benchmark rows nothing is hit. Further columns of
    either table are ignored.
    """
    rows = pick(documents, id_column, text_column).toDF("id", "text")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", words(F.col("text")).alias("w"))
    lines = find_windows(rows, benchmark_windows(benchmark, item_column, item_text_column, window), window)
    hit = F.col("width").isNotNull()
    span = F.when(hit, F.struct(F.col("at").alias("at"), (F.col("at") + F.col("width")).alias("end")))
    merged = lines.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.collect_list(span).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )
    return merged.select(
        F.col("id").alias(id_column),
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _contaminated_texts(plain: DataFrame, text: str, benchmark: DataFrame, item: tuple[str, str], window: int) -> DataFrame:
    """(digest, spans) of the distinct texts that hold a window."""
    rows = plain.select(F.md5(F.col(text).cast("binary")).alias("digest"), words(F.col(text)).alias("w"))
    lines = find_windows(rows, benchmark_windows(benchmark, *item, window), window)
    hits = lines.where(F.col("width").isNotNull())
    span = F.struct(F.col("at").alias("at"), (F.col("at") + F.col("width")).alias("end"))
    return hits.groupBy("digest").agg(F.collect_set(span).alias("spans"))


def remove(
    documents: DataFrame,
    benchmark: DataFrame,
    mode: str = "documents",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``documents`` (all columns) without contaminated documents, or (``mode`` "spans")
    with the hit words, each with the separators after it, cut out of the text.

    A hit depends on the text alone, so equal texts share one decision; null texts stay.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    names, plain = documents.columns, positions(documents)
    text = f"c{position_of(documents, text_column)}"
    found = _contaminated_texts(plain, text, benchmark, (item_column, item_text_column), window)
    digest = F.md5(F.col(text).cast("binary"))
    if mode == "documents":
        hit = materialize(found.select(F.col("digest").alias("r_digest")), "benchmark-hits")
        keyed = plain.withColumn("digest", digest)
        return without(keyed, "digest", hit, F.col("digest") == F.col("r_digest")).drop("digest").toDF(*names)
    joined = plain.join(found, digest == found["digest"], "left")
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    free = F.filter(pieces, lambda _, i: ~F.exists("spans", lambda s: (s["at"] <= i) & (i < s["end"])))
    cut = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.concat(lead, F.array_join(free, "")))
    return joined.withColumn(text, cut).select(*plain.columns).toDF(*names)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS width,
         array_to_string(w[pos:pos + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (
  SELECT rid, pos, width, array_to_string(w[pos:pos + width - 1], ' ') AS win
  FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS pos FROM d, widths WHERE len(w) >= width)),
hits AS (SELECT DISTINCT dw.rid, dw.pos, dw.width, bw.item FROM dw JOIN bw ON dw.width = bw.width AND dw.win = bw.win),
places AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + width)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""
