"""Spelling variants: groups of words that differ by one edit, each pointing to its common form.

Letters are hashed to a few symbols, which makes the set of all one-edit neighbours of a reduced
word small enough to be generated in full. It is joined with the reduced vocabulary: an edit of a
word is an edit, or none, of its reduced word, so every near pair meets exactly once in each
direction. Pairs are verified on the words themselves.

Reduced words are compared by a polynomial hash, from which the hash of each neighbour follows in
one step, so a neighbourhood takes memory in proportion to the word, not to its square. What
collides is told apart when pairs are verified. Reduced words that very many words share are
taken out of the join and done with a larger alphabet.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import SLICE_ROWS, pick, sieved
from skuloom.session import materialize

# symbols that letters are hashed to; the second number is for crowded reduced words
SYMBOLS, MORE_SYMBOLS = 8, 61
# words that may share a reduced word before it counts as crowded
CROWDED = 2_000
# runs of letters of at least this length are found; a word of any other kind is not looked for
LETTERS = "A-Za-zÀ-ÿ"
FLUSH_WORDS = 400_000
# neighbours that are computed at once
AT_ONCE = 2_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be divided by modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


# ---- neighbourhoods ----------------------------------------------------------------------


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as rows of symbols (1 and up)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return (points % symbols).astype(np.uint64).reshape(len(words), -1) + np.uint64(1)


def _sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(powers of the base, hash of each prefix of each row)."""
    n, size = rows.shape
    powers = np.ones(size + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(size, _BASE, dtype=np.uint64), out=powers[1:])
    sums = np.zeros((n, size + 1), dtype=np.uint64)
    np.cumsum(rows * powers[:size], axis=1, out=sums[:, 1:])
    return powers, sums


def own_keys(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols."""
    return _sums(rows)[1][:, -1].view(np.int64)


def neighbour_keys(rows: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number, hash) of each row itself and all its distinct one-edit neighbours."""
    n, size = rows.shape
    powers, before = _sums(rows)
    whole = before[:, -1:]
    after = whole - before
    deleted = before[:, :-1] + after[:, 1:] * np.uint64(_INVERSE)
    keys = [whole, deleted]
    for symbol in range(1, symbols + 1):
        one = np.uint64(symbol)
        keys.append(before + one * powers + after * np.uint64(_BASE))
        keys.append(whole + (one - rows) * powers[:size])
    every = np.sort(np.concatenate(keys, axis=1), axis=1)
    first = np.ones(every.shape, dtype=bool)
    first[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.repeat(np.arange(n), first.sum(axis=1)), every[first].view(np.int64)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


# ---- words -------------------------------------------------------------------------------


def count_words(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    dropped_letter_modulus: int | None = None,
) -> DataFrame:
    """(word, n): how often each word of ``least_length`` code points or more occurs, if that is
    ``least_count`` times or more.

    Words are the maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in
    lower case. With a ``dropped_letter_modulus``, a word whose crc32 of "id:word" it divides loses
    the code point at that crc32 modulo its length, in all its places in the document.

    Null and empty texts have no words; a null id counts as empty text; repeated rows count each.
    Words are counted in the tasks before the shuffle, so frequent ones are no burden.
    """
    rows = pick(documents, id_column, text_column).toDF("id", "text")
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # only runs that can still be long enough
    runs = re.compile(f"[{LETTERS}]{{{max(1, least_length)},}}")
    upper = re.compile("[A-Z]")
    modulus = dropped_letter_modulus

    def run(batches):
        counts: Counter[str] = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema
            )
            counts.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for doc_id, text in zip(*[c.to_pylist() for c in part.columns]):
                    if not text:
                        continue
                    if upper.search(text):
                        text = text.encode("utf-8").lower().decode("utf-8")  # A-Z only
                    found = runs.findall(text)
                    if modulus is None:
                        counts.update(found)
                        continue
                    seed = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in Counter(found).items():
                        digest = zlib.crc32(word.encode("utf-8"), seed)
                        if digest % modulus == 0:
                            cut = digest % len(word)
                            word = word[:cut] + word[cut + 1 :]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    found = rows.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- pairs -------------------------------------------------------------------------------


def _number(words: DataFrame) -> DataFrame:
    """(word_id, word, n, key, more_key) of (word, n): with the hashes of the reduced words."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("more_key", pa.int64())])

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = np.zeros((2, len(words)), dtype=np.int64)
            for at in _by_length(words).values():
                group = [words[i] for i in at]
                for row, symbols in zip(keys, (SYMBOLS, MORE_SYMBOLS)):
                    row[at] = own_keys(reduced(group, symbols)) if group[0] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[0]), pa.array(keys[1])], schema=schema)

    keyed = words.select("word", F.col("n").cast("long")).mapInArrow(run, "word string, n long, key long, more_key long")
    # the numbers are written, so they are the same for every reader
    return materialize(keyed.withColumn("word_id", F.monotonically_increasing_id()), "variant-words")


def _neighbourhoods(words: DataFrame, symbols: int) -> DataFrame:
    """(word_id, key) for each word's reduced word and all its one-edit neighbours."""
    schema = pa.schema([("word_id", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            words = batch.column(1).to_pylist()
            for size, at in _by_length(words).items():
                step = max(1, AT_ONCE // (2 * symbols * (size + 1)))
                for start in range(0, len(at), step):
                    part = at[start : start + step]
                    rows = reduced([words[i] for i in part], symbols) if size else np.zeros((len(part), 0), np.uint64)
                    number, keys = neighbour_keys(rows, symbols)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][number]), pa.array(keys)], schema=schema)

    return words.select("word_id", "word").mapInArrow(run, "word_id long, key long")


def near_pairs(numbered: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word_id, near_id) for all words one edit apart, in both directions; every pair once.

    ``numbered`` has word_id, word, key, more_key, each word once, and is written.
    """
    counts = numbered.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    full = materialize(counts.select("key"), "variant-crowded")
    index = numbered.join(full, "key", "left_anti").select("key", F.col("word_id").alias("near_id"))
    asked = sieved(_neighbourhoods(numbered, SYMBOLS), "key", index.select("key"), "may_match").where("may_match")
    found = asked.select("word_id", "key").join(index.hint("shuffle_hash"), "key")
    pairs = found.select("word_id", "near_id")
    if not full.isEmpty():
        # words that reach a crowded reduced word, and the words there, with a larger alphabet
        near = _neighbourhoods(numbered, SYMBOLS).join(full, "key", "left_semi").select("word_id").distinct()
        crowd = numbered.join(full, "key", "left_semi").select(F.col("more_key").alias("key"), F.col("word_id").alias("near_id"))
        again = sieved(
            _neighbourhoods(numbered.join(near, "word_id", "left_semi"), MORE_SYMBOLS), "key", crowd.select("key"), "may_match"
        ).where("may_match")
        pairs = pairs.unionByName(
            again.select("word_id", "key").join(crowd.hint("shuffle_hash"), "key").select("word_id", "near_id")
        )
    plain = numbered.select("word_id", "word")
    named = pairs.where("word_id <> near_id").join(plain, "word_id").join(plain.toDF("near_id", "near"), "near_id")
    return named.where(F.levenshtein("word", "near", 1) == 1).select("word_id", "near_id")


def _roots(links: DataFrame, depth: int) -> DataFrame:
    """(word_id, root_id) of links (word_id, to_id): the last word along the links, which are
    at most ``depth`` deep. Each turn doubles the length of all links."""
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        onward = links.toDF("to_id", "next_id")
        links = links.join(onward, "to_id", "left").select("word_id", F.coalesce("next_id", "to_id").alias("to_id"))
        links = materialize(links, "variant-links")
    return links.toDF("word_id", "root_id")


def group_variants(words: DataFrame, ratio: int = 5, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), one row for each.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code
    point. ``form`` is the one of them with the largest n (of equal ones the first in code point
    order), if that is at least ``ratio`` times the word's own n, else null; ``form_n`` is its n.
    ``root`` is the last word along the forms, the word itself if it has none.

    Words must be distinct; null words are left out, a null n counts as 0, the empty word is a
    word. Further columns are ignored. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms cannot lead back")
    given = pick(words, "word", "n").where(F.col("word").isNotNull())
    numbered = _number(given.select("word", F.coalesce("n", F.lit(0)).alias("n")))
    plain = numbered.select("word_id", "word", "n")
    near = near_pairs(numbered, crowded).join(plain.toDF("near_id", "near", "near_n"), "near_id")
    best = near.groupBy("word_id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near", "near_id")).alias("best")
    )
    ranked = plain.join(best, "word_id", "left")
    has_form = (-F.col("best.rank") >= ratio * F.col("n")) & (F.col("best.rank") < 0)
    formed = materialize(
        ranked.select(
            "word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.struct(F.col("best.near").alias("word"), F.col("best.near_id").alias("id"), (-F.col("best.rank")).alias("n"))).alias("form"),
        ),
        "variant-forms",
    )
    links = formed.where("form is not null").select("word_id", F.col("form.id").alias("to_id"))
    # each link multiplies n by the ratio
    low, high = formed.agg(F.min(F.greatest("n", F.lit(1))), F.max("n")).first()
    depth = 1 + max(0, math.ceil(math.log(max(high or 1, 1) / (low or 1), ratio) + 1))
    roots = _roots(links, depth).join(plain.select(F.col("word_id").alias("root_id"), F.col("word").alias("root")), "root_id")
    joined = formed.join(roots.select("word_id", "root"), "word_id", "left")
    return joined.select(
        "word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"),
        "n", "n_near", F.col("form.n").alias("form_n"),
    )


SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries
),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL
),
bytes AS (
    SELECT id, run, times, hex(encode(id || ':' || run)) AS digits FROM runs
),
hashed AS (
    SELECT id, run, times, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(length(digits) // 2),
            lambda i: 16 * (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
        lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)]))) AS h
    FROM bytes, crc
),
words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
        FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
cuts AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON c.rest = w.word),
near AS (
    SELECT word, n, other, other_n FROM shorter
    UNION ALL SELECT other, other_n, word, n FROM shorter
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
),
best AS (
    SELECT word, n, count(*) AS n_near, min({'rank': -other_n, 'other': other}) AS best FROM near GROUP BY word, n
),
forms AS (SELECT word, best.other AS form, -best.rank AS form_n FROM best WHERE -best.rank >= 5 * n),
walk AS (
    WITH RECURSIVE steps AS (
        SELECT word, form AS top, 1 AS depth FROM forms
        UNION ALL SELECT s.word, f.form, s.depth + 1 FROM steps s JOIN forms f ON s.top = f.word
    )
    SELECT word, arg_max(top, depth) AS root FROM steps GROUP BY word
)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN forms f ON w.word = f.word LEFT JOIN walk r ON w.word = r.word
"""
