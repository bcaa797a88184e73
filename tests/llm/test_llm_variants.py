"""Variants against edits tried one by one."""

import random
import zlib

import numpy as np
import pytest
from llm_samples import documents, empty, hostile

from skuloom.llm import queries, variants


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b}
    found |= {a + c + b for a, b in cuts for c in letters}
    found |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    return found - {word}


def brute(counts, ratio=5):
    letters = {c for w in counts for c in w}
    out = {}
    for word, n in counts.items():
        near = [w for w in edits(word, letters) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w.encode()), default=None)
        form = best if best is not None and counts[best] >= ratio * n and counts[best] > 0 else None
        out[word] = (form, n, len(near), counts[form] if form is not None else None)
    for word, row in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        out[word] = (row[0], root, *row[1:])
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def some_words():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcéÿ") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    words = {w: rnd.choice([5, 6, 30, 160, 900]) for w in base}
    chain = {"letters": 5, "lettersx": 25, "lettersxy": 125, "lettersxyz": 625, "ettersxyz": 3125}
    return words | chain | {"x" * 500: 7, "x" * 501: 40, "": 3, "數據庫": 9, "數據": 50, "😀😀": 1, "😀": 8}


def test_neighbour_keys_are_those_of_the_neighbours():
    for word, symbols in (("abcabc", 3), ("aaaa", 2), ("q", 8), ("abcdefgh", 8)):
        rows = variants.reduced([word], symbols)
        text = "".join(map(chr, rows[0].tolist()))
        near = {text} | edits(text, [chr(s) for s in range(1, symbols + 1)])
        keys = [variants.own_keys(np.array([[ord(c) for c in w]], dtype=np.uint64).reshape(1, -1))[0] for w in near]
        _, got = variants.neighbour_keys(rows, symbols)
        assert sorted(got.tolist()) == sorted(int(k) for k in keys)


@pytest.mark.parametrize("crowded", [2_000, 3, 0])
def test_like_brute_force(spark, crowded):
    words = some_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants.group_variants(df, crowded=crowded)) == brute(words)


def test_words_with_odd_tables(spark):
    rows = [("a", 5, "x"), (None, 5, "y"), ("b", None, "z")]
    df = spark.createDataFrame(rows, "word string, n long, word_id string")
    assert found(variants.group_variants(df)) == {"a": (None, "a", 5, 1, None), "b": ("a", "a", 0, 1, 5)}
    assert found(variants.group_variants(df.limit(0))) == {}
    with pytest.raises(ValueError):
        variants.group_variants(df, ratio=1)


def letters_of(text):
    """Maximal runs, one character at a time."""
    out, run = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c.lower() if c <= "Z" else c
        else:
            out += [run] if run else []
            run = ""
    return out


def counted(rows, modulus):
    out = {}
    for doc_id, text in rows:
        for word in letters_of(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if modulus and h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] = out.get(word, 0) + 1
    return out


@pytest.mark.parametrize("modulus", [None, 3, 199])
def test_counts(spark, modulus):
    text = "Straße STRASSE élan ÉLAN strasse x" * 3 + " foo×bar÷baz İstanbul naïveté-naïveté a1b2 " + "q" * 7
    rows = [(1, text), (2, text), (None, text), (3, None), (4, ""), (1, text)]
    df = variants.count_words(documents(spark, rows), least_length=6, least_count=2, dropped_letter_modulus=modulus)
    want = {w: n for w, n in counted(rows, modulus).items() if len(w) >= 6 and n >= 2}
    assert {r.word: r.n for r in df.collect()} == want and want


def test_documents_with_everything(spark):
    words = variants.count_words(hostile(spark), least_count=1, dropped_letter_modulus=199)
    got = found(variants.group_variants(words))
    assert got["x" * 200_000] == (None, "x" * 200_000, 1, 0, None)
    assert variants.count_words(empty(spark)).count() == 0


def test_query_over_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {w: n for w, n in counted(docs, 199).items() if len(w) >= 6 and n >= 5}
    got = found(queries.QUERIES["op11_reduced_alphabet_variants"](spark, sf_dir))
    assert got == brute(want)
