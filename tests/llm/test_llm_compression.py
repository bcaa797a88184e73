import base64
import random
import re

import llm_samples as samples
from skuloom.llm import compression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 8))
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 20 or 100 * len(inside) > 30 * len(words),
    }


def test_counts_equal_a_naive_version(spark):
    rng = random.Random(1)
    texts = []
    for n in (0, 1, 7, 8, 9, 16, 17, 40, 80, 200):
        words = [rng.choice("ab cd# é& <x> |".split()) for _ in range(n)]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "\r\n", "\xa0 "]) for w in words))
        texts.append(" ".join(str(rng.randrange(50)) for _ in range(n)) + " " + "a b c d e f g h " * (n // 20))
    df = samples.documents(spark, list(enumerate(texts)))
    for row in compression.rate(df).collect():
        want = naive(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want


def test_bands(spark):
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    prose = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(600))
    noise = base64.b85encode(rng.randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    # repeated below the 8-word rule: every window holds a new word
    stamp = " ".join(f"the same seven words stand here again {i}" for i in range(600))
    half = prose + " " + " ".join(f"{i} " + "ab" * 60 for i in range(70))
    df = samples.documents(spark, [(1, prose), (2, noise), (3, stamp), (4, half), (5, None)])
    got = {r["doc_id"]: (r["kept"], r["verdict"]) for r in compression.rate(df).collect()}
    assert got[1] == (True, None)
    assert got[2] == (False, "incompressible")
    assert got[3] == (False, "repetitive")
    assert got[4][0] is False and got[4][1] in ("repetitive", "chunks")
    assert got[5] == (False, "base")
    assert compression.reject(df).count() == 4


def test_limits_follow_length():
    assert compression.band_verdict(100, 50.0, compression.WHOLE_BANDS) is None
    assert compression.band_verdict(600, 3.3, compression.WHOLE_BANDS) == "repetitive"
    assert compression.band_verdict(20_000, 3.3, compression.WHOLE_BANDS) is None
    assert compression.band_verdict(20_000, 1.35, compression.WHOLE_BANDS) == "incompressible"


def test_hostile_and_empty(spark):
    rows = compression.rate(samples.hostile(spark)).collect()
    assert len(rows) == len(samples.TEXTS)
    by_size = sorted((r["n_words"], r["word_chars"]) for r in rows)
    want = sorted((naive(t)["n_words"], naive(t)["word_chars"]) for _, t, *_ in samples.TEXTS if t is not samples.LONG)
    assert [x for x in by_size if x[0] < 30_000] == want
    assert compression.rate(samples.empty(spark)).collect() == []
