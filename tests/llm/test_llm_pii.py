import hashlib
import random
import re
import time

import llm_samples as samples
from skuloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def corpus():
    rng = random.Random(6)
    bits = "a@b.co x.y+z@mail-1.example.com 1.2.3.4 256.1.1.1 4111111111111111 4111-1111 1111 1111 +1 (555) 010-9999 +12 é @ . - + ( ) 0 77 é@é.com a@b @c.d 1.2.3.4.5.6.7.8 00.0.000.1".split(" ")
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    alphabet = "a1@.+- (4"
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_rule_spans_equal_plain_patterns(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in pii.detect(samples.documents(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = naive(text)
        row = got[i]
        assert [row[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE], text
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(row["spans"].split(",")) or not want
        assert row["n_added"] == len([s for s in row["spans"].split(",") if s]) - len(want)


def test_wide_candidates_need_support(spark):
    """Written-out addresses and local numbers beside cue words are added; numbers in other
    roles, failed checks and plain prose are not."""
    rows = [(i, f"Please mail me at user{i}@site.com or phone +1 (555) 010-{1000 + i}, thanks") for i in range(200)]
    rows += [(1000 + i, f"Please mail user{i} [at] site [dot] com for more") for i in range(30)]
    rows += [(2000 + i, f"order 4111 1111 1111 111{i % 10} and version 300.1.2.{i}") for i in range(30)]
    rows += [(3000 + i, "A plain sentence about 12 apples, 3 pears (2 of them green) in 1984.") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.detect(samples.documents(spark, rows)).collect()}
    assert all(got[i]["n_added"] == 0 for i in range(200))
    assert all(got[1000 + i]["spans"].startswith("email:") for i in range(30))
    assert all(got[3000 + i]["spans"] == "" for i in range(30))
    for i in range(30):
        assert got[2000 + i]["n_added"] == 0


def test_estimated_reliabilities():
    """Labelers that agree are trusted, one that votes at random is not."""
    rng = random.Random(1)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        vote = lambda p, y=y: (1 if y else -1) * (1 if rng.random() < p else -1)
        key = f"{vote(0.95)},{vote(0.9)},{vote(0.85)},{vote(0.5)}"
        patterns[key] = patterns.get(key, 0) + 1
    posterior, found = pii.estimate(patterns)
    assert abs(found["prior"] - 0.4) < 0.05
    right = found["rates"][1, :, 2]
    assert abs(right[0] - 0.95) < 0.04 and abs(right[3] - 0.5) < 0.06
    assert posterior["1,1,1,-1"] > 0.95 and posterior["-1,-1,-1,1"] < 0.05


def test_redact(spark):
    rows = [(1, "mail a@b.co now"), (2, None), (3, "no data"), (4, "+1 555 010 9999")]
    out = {r["doc_id"]: r for r in pii.redact(samples.documents(spark, rows), length_column="n_chars").collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: "mail [EMAIL] now", 2: None, 3: "no data", 4: "[PHONE]"}
    assert out[1]["n_chars"] == len("mail [EMAIL] now")


def test_hostile_and_empty(spark):
    got = pii.detect(samples.hostile(spark)).collect()
    assert len(got) == len(samples.TEXTS)
    nine = next(r for r in got if r["doc_id"] == 9)
    assert [nine[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert pii.detect(samples.empty(spark)).collect() == []
    assert pii.redact(samples.hostile(spark)).columns == samples.DOCUMENTS.names
    assert pii.redact(samples.empty(spark)).collect() == []


def test_patterns_are_linear():
    for odd in ("a", "1", "1.", "+1", "a@", "1-", "@", "(", "a.b-"):
        start = time.perf_counter()
        pii.candidates(odd * 100_000)
        assert time.perf_counter() - start < 8, odd
