import random

import llm_samples as samples
import numpy as np
import pytest
from skuloom.llm import neardup


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    """Least id of each document's component by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    least = {}
    for (doc_id, _), name in zip(rows, label):
        least[name] = min(least.get(name, doc_id), doc_id)
    return {doc_id: least[name] for (doc_id, _), name in zip(rows, label)}


def family(rng, n_words, members, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(members - 1):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(n_words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for n in (3, 5, 40, 80, 120, 300):
        for _ in range(4):
            texts += family(rng, n, rng.randint(2, 7), max(1, n // 30))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(rng.randint(5, 200))) for _ in range(60)]
    texts += [" ".join(f"s{rng.randrange(10**7)}" for _ in range(100)) for _ in range(40)]
    texts += ["A B c", "a b C", "a b", "", None, "  "]
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, rows, width=4, percent=80):
    got = {r["doc_id"]: r for r in neardup.groups(samples.documents(spark, rows), width=width, percent=percent).collect()}
    want = brute(rows, width, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert all(r["n_shingles"] == len(shingles(t, width)) for (i, t) in rows for r in [got[i]])


def test_equals_brute_force(spark):
    check(spark, corpus(1))


@pytest.mark.parametrize("small,levels,family_size", [(4, 2, 1000), (4, 3, 8), (1000, 2, 8), (8, 1, 16)])
def test_large_nodes_and_families(spark, monkeypatch, small, levels, family_size):
    """With small limits everything goes through hubs, branching and blocks."""
    monkeypatch.setattr(neardup, "SMALL_NODE", small)
    monkeypatch.setattr(neardup, "LEVELS", levels)
    monkeypatch.setattr(neardup, "FAMILY", family_size)
    rng = random.Random(5)
    texts = family(rng, 150, 40, 8) + family(rng, 100, 30, 12) + family(rng, 300, 20, 3)
    check(spark, list(enumerate(texts)))


def test_intersections_by_presence(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (1, 5, 30, 30, 60, 80)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.common(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert got[i, j] == want[i][j]


def test_chain_reaches_its_least_member(spark):
    """Neighbours are linked, the ends are not."""
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[12 * k : 12 * k + 200]) for k in range(14)]
    check(spark, [(i, texts[(i * 5) % 14]) for i in range(14)])


def test_threshold_is_exact(spark):
    """Four of five shingles are linked, 79 of 100 are not."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, " ".join(f"k{i}" for i in range(103)))]
    words = rows[2][1].split()
    rows.append((4, " ".join([*words[:82], "z"])))  # 79 common shingles of 101
    check(spark, rows)


def test_hostile_and_empty(spark):
    rows = neardup.groups(samples.hostile(spark)).collect()
    assert len(rows) == len(samples.TEXTS)
    assert sum(r["n_shingles"] == 0 for r in rows) == 4
    assert [r["kept"] for r in rows] == [True] * len(rows)
    assert neardup.groups(samples.empty(spark)).collect() == []
    # equal rows: one stays
    left = neardup.drop_copies(samples.hostile(spark))
    assert left.columns == samples.DOCUMENTS.names and left.count() == len(samples.TEXTS) - 1


def test_copies_with_and_without_id(spark):
    rows = [(None, "q w e r t y"), (4, "q w e r t y"), (3, "Q W E R T Y"), (None, "z z"), (None, "z z")]
    got = sorted((r["doc_id"] is None, r["component_id"] is None, r["kept"]) for r in neardup.groups(samples.documents(spark, rows)).collect())
    assert got == [(False, False, False), (False, False, True), (True, False, False), (True, True, True), (True, True, True)]
    left = neardup.drop_copies(samples.documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["3", "None"]
