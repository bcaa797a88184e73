"""Prefix encoding against merges done one by one, against the library, and after edits."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_samples import empty, hostile
from pyspark.sql import functions as F

from skuloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_of(path):
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


def merged(ranks, data):
    """Lowest rank first, leftmost first."""
    parts = [bytes([b]) for b in data]
    while True:
        due = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not due:
            return [ranks[p] for p in parts]
        i = min(due)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def texts(n):
    rnd = random.Random(7)
    odd = [32, 10, 9, 0x85, 0xA0, 39, 115, 116, 108, 0x4E2D, 0x1F600, 0xE9, 0x301, 0x661, 0x88F, 0x323B0, 45]
    for i in range(n):
        size = rnd.randint(0, 120)
        if i % 3 == 0:
            yield "".join(rnd.choice("ab 'sl") for _ in range(size))
        elif i % 3 == 1:
            yield "".join(chr(rnd.choice(odd)) for _ in range(size))
        else:
            yield "".join(chr(c) for c in (rnd.randrange(0x110000) for _ in range(size)) if not 0xD800 <= c < 0xE000)


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_like_the_library(words, library):
    for text in [*texts(900), "x" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>"]:
        ids = list(words.encode(text))
        assert ids == library.encode_ordinary(text)
        assert words.decode(ids) == text.encode("utf-8")


def test_like_merges_one_by_one(words):
    rnd = random.Random(3)
    for _ in range(400):
        data = bytes(rnd.choice(b"aabcer  ") if rnd.random() < 0.8 else rnd.randrange(256) for _ in range(rnd.randint(1, 60)))
        assert list(words.read_off(data, words.last_tokens(data))) == merged(words.ranks, data)


def test_every_prefix_has_its_own_encoding(words):
    data = " unbelievabledogs".encode()
    last = words.last_tokens(data)
    for n in range(1, len(data) + 1):
        own = words.last_tokens(data[:n])
        assert own == last[:n]
        assert own[-1] == merged(words.ranks, data[:n])[-1]


def test_ties_between_equal_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258, b"zzzz": 259}
    words = bpe.Vocabulary(ranks)
    for n in range(1, 12):
        for data in (b"a" * n, b"b" + b"a" * n, b"z" * n):
            expected = [ranks[data]] if data in ranks else merged(ranks, data)
            assert list(words.read_off(data, words.last_tokens(data))) == expected


def test_a_byte_without_token():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_edits_equal_encoding_anew(words):
    rnd = random.Random(11)
    for text in texts(600):
        last, ends = bpe.prefixes(words, text)
        assert list(bpe.tokens_of(words, text, last, ends)) == list(words.encode(text))
        start, end = sorted(rnd.randint(-1, len(text) + 1) for _ in range(2))
        new = rnd.choice(["", "l", "'", "  ", "abab", "s t", "é", "数"])
        changed, last, ends, _ = bpe.replace(words, text, last, ends, start, end, new)
        cut = max(start, 0)
        assert changed == text[:cut] + new + text[max(cut, end) :]
        assert (last, ends) == bpe.prefixes(words, changed)


@pytest.mark.parametrize("text", ["ab" * 20_000, "the cat sat on the mat. " * 2_000])
def test_an_edit_costs_its_surroundings(words, text):
    last, ends = bpe.prefixes(words, text)
    middle = len(text) // 2
    for start, end, new in ((middle, middle + 1, "zz"), (len(text), len(text), "ab"), (0, 0, "x")):
        changed, found, found_ends, computed = bpe.replace(words, text, last, ends, start, end, new)
        assert (found, found_ends) == bpe.prefixes(words, changed)
        assert computed < 3 * words.longest


def test_tables_with_everything(spark, library):
    docs = hostile(spark)
    rows = bpe.decode(bpe.encode(docs, PATH), PATH, "tokens_")
    assert rows.columns == [*docs.columns, "tokens_", "decoded"]
    for row in rows.collect():
        text = row[docs.columns.index("text")] or ""
        assert row.tokens_ == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode("utf-8")
    assert bpe.encode(empty(spark), PATH).count() == 0
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0


def test_decoding_odd_lists(spark, words):
    rows = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None)], "id int, tokens array<int>")
    assert [r.decoded for r in bpe.decode(rows, PATH).collect()] == [b"hello world", b"", None]
    for bad in ([10**8], [None], [-1]):
        with pytest.raises(KeyError):
            words.decode_lists(pa.array([bad], pa.list_(pa.int32())))


def test_stores_that_change(spark, library):
    docs = spark.createDataFrame(
        [(1, "I'"), (2, "hello  "), (3, None), (4, "same"), (None, "no id"), (5, "x" * 20_000), (4, "same")],
        "doc_id long, text string",
    )
    store = bpe.encode_prefixes(docs, PATH)
    edits = spark.createDataFrame(
        [(1, None, None, "ll go"), (2, 100, 100, "world"), (3, 0, 0, "new"), (5, 10_000, 10_001, " "), (9, 0, 0, "none"), (None, 0, 0, "?")],
        "doc_id long, start int, end int, replacement string",
    )
    after = bpe.tokens_from(bpe.replace_in(store, edits, PATH), PATH)
    texts = sorted((r.doc_id or 0, r.text) for r in after.collect())
    split = "x" * 10_000 + " " + "x" * 9_999
    assert texts == sorted([(0, "no id"), (1, "I'll go"), (2, "hello  world"), (3, "new"), (4, "same"), (4, "same"), (5, split)])
    for row in after.collect():
        assert row.tokens == library.encode_ordinary(row.text)
    assert bpe.replace_in(store.limit(0), edits, PATH).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.QUERIES["op13_prefix_bpe"](spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids, row = library.encode_ordinary(text), found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode("utf-8")).hexdigest()
    nothing = bpe.digests(F.array().cast("array<int>"), F.lit("").cast("binary"))
    first = spark.range(1).select(*nothing).first()
    assert first.n_tokens == 0 and first.ids_sha256 == hashlib.sha256(b"").hexdigest()
