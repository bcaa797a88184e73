import math
import random
import zlib
from collections import Counter

import llm_samples as samples
import pytest
from skuloom.llm import ppm


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def chain(words, order):
    return b" " * order + b"".join(w + b" " for w in words) + b" "


def naive_trie(texts, order):
    """context -> symbol -> count: occurrences after the longest contexts; after a shorter one, the
    number of longer contexts that the symbol follows."""
    trie = {}
    for words in texts:
        data = chain(words, order)
        for i in range(order, len(data)):
            trie.setdefault(data[i - order : i], Counter())[data[i]] += 1
    for k in range(order - 1, -1, -1):
        for context in [c for c in trie if len(c) == k + 1]:
            for symbol in trie[context]:
                trie.setdefault(context[1:], Counter())[symbol] += 1
    return trie


def naive_logp(trie, context, symbol):
    p, hidden = 1.0, set()
    for k in range(len(context) + 1):
        left = {s: n for s, n in trie.get(context[k:], {}).items() if s not in hidden}
        if not left:
            continue
        size = sum(left.values())
        if symbol in left:
            return math.log10(p * (left[symbol] - ppm.DISCOUNT) / size)
        p *= ppm.DISCOUNT * len(left) / size
        hidden |= set(left)
    return math.log10(p / (256 - len(hidden)))


def naive(rows, order):
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if not held(i) for w in [*ws, b""])
    n, v = sum(train.values()), len(train)
    trie = naive_trie([ws for i, ws in tokens.items() if not held(i)], order)
    out = {}
    for i, ws in tokens.items():
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, b""])
        data = chain(ws, order)
        score = sum(naive_logp(trie, data[j - order : j], data[j]) for j in range(order, len(data)))
        out[i] = (held(i), len(ws) + 1, sum(train[w] > 0 for w in [*ws, b""]), n, base, score)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    syllables = "th er on an re he in ed é ñu st".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.6 else word() for _ in range(rng.randint(0, 60))]
        if i % 7 == 0:
            words += [word()] * 20
        rows.append((i, " ".join(words).title() if i % 3 else " ".join(words)))
    return rows


@pytest.mark.parametrize("hot,order", [(None, ppm.ORDER), (0.01, 2), (2.0, ppm.ORDER), (2.0, 6), (0.001, 1)])
def test_scores_equal_a_naive_version(spark, monkeypatch, hot, order):
    """Also when few or no words and pairs are scored where the text is read, and over many flushes."""
    if hot is not None:
        for name, value in (("HOT_WORDS", hot), ("HOT_PAIRS", hot), ("FLUSH_WORDS", 10), ("FLUSH_SYMBOLS", 300)):
            monkeypatch.setattr(ppm, name, value)
    rows = corpus(1)
    want = naive(rows, order)
    got = ppm.score(samples.documents(spark, rows), order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        h, tokens, known, n, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_symbols_after_a_context_sum_to_one(spark):
    trie = naive_trie([t.encode().lower().split() for _, t in corpus(3, 8)], 3)
    for context in (b"   ", b"the", b"xqz", b"th ", b" \xc3\xa9"):
        total = sum(10 ** naive_logp(trie, context, symbol) for symbol in range(256))
        assert total == pytest.approx(1.0)


def test_the_order_changes_scores_of_training_texts(spark):
    docs = samples.documents(spark, [r for r in corpus(4) if r[1]])
    long, short = [{r.doc_id: r for r in ppm.score(docs, order=k).collect()} for k in (5, 1)]
    changed = [abs(long[i].score - short[i].score) > 1 for i in long if not long[i].held_out]
    assert all(changed) and len(changed) > 30
    with pytest.raises(ValueError):
        ppm.score(docs, order=7)


def test_keys_of_pairs_are_no_words():
    codes = ppm.pair_codes(ppm.chain([b"ab", b"\xff"], 3), 3)
    keys = ppm.keys_of(codes, 3).to_pylist()
    assert keys == [b" " + (b"   ab \xff  ")[i : i + 4] for i in range(6)]


def test_adaptive_mode_learns_repetition():
    rng = random.Random(2)
    once = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50))
    same = " ".join(["abcdef"] * 50)
    assert ppm.adaptive_code_length(same) > 0.3 * ppm.adaptive_code_length(once)
    assert ppm.adaptive_code_length(None) == ppm.adaptive_code_length("") < 0


def test_adaptive_mode_equals_a_trie_of_the_text_so_far(spark):
    """Each byte by a trie that is built anew, with update exclusion, from the bytes before."""
    text, order = "abra abra cadabra a\u00e9", 3
    data = chain(text.encode().split(), order)
    total, trie = 0.0, {}
    for i in range(order, len(data)):
        total += naive_logp(trie, data[i - order : i], data[i])
        knew = max([k for k in range(order + 1) if data[i] in trie.get(data[i - k : i], {})], default=0)
        for k in range(knew, order + 1):
            trie.setdefault(data[i - k : i], Counter())[data[i]] += 1
    assert ppm.adaptive_code_length(text, order) == pytest.approx(total)
    rows = ppm.adaptive_scores(samples.hostile(spark).where("doc_id is null or doc_id <> 5 and doc_id <> 6"))
    assert rows.columns[-1] == "adaptive_score" and all(r["adaptive_score"] < 0 for r in rows.collect())
    assert ppm.adaptive_scores(samples.empty(spark)).count() == 0


def test_beats_the_base_on_held_out_text(spark):
    """In sum and on most texts."""
    got = ppm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > len(got) / 2


def test_hostile_and_empty(spark):
    got = ppm.score(samples.hostile(spark)).collect()
    assert len(got) == len(samples.TEXTS)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 1, 1]
    assert ppm.score(samples.empty(spark)).collect() == []
    # nothing to learn from: only held-out rows
    alone = [i for i in range(100) if held(i)][:3]
    got = ppm.score(samples.documents(spark, [(i, "some words") for i in alone])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
