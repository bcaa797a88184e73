"""Small tables with everything that tends to break operators."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x" for i in range(30_000))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside, or that differ in case only
        T.StructField("Text", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("_result_", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("key", T.StringType()),
        # names that operators give to their results
        T.StructField("copies", T.StringType()),
        T.StructField("Tokens", T.StringType()),
    ]
)

TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the fire all day long while rain fell on the roof outside", "en", "a"),
    (1, "the cat sat on the mat and the dog lay by the fire all day long while rain fell on the roof outside", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", "b"),
    (4, " \t\n\r\x0b\x0c ", None, "b"),
    (None, "a short note", "en", None),
    (None, None, None, None),
    (5, LONG, "xx", "a"),
    (6, "x" * 200_000, "en", "c"),
    (7, "ÉCOLE école Straße ñandú 数据 😀 word", "fr", "c"),
    (8, "one\ntwo\none\n\n\ntwo two", "en", "a"),
    (9, "a@b.co, 1.2.3.4, 4111111111111111, +1 (555) 010-9999", "en", "a"),
]


def hostile(spark):
    rows = [(i, t, lang, s, len(t or ""), "decoy", "no", 7, "r", "s", "d", "k", "c", "t") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, rows):
    """(doc_id, text[, lang, source]) tuples as a table of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
