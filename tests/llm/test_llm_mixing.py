import hashlib
import random

import llm_samples as samples
from skuloom.llm import mixing


def naive_targets(sizes, weights=(5, 2, 1)):
    """Water level by giving out the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target, weight


def naive(rows):
    words = lambda t: len((t or "").encode().split())
    key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    target, weight = naive_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    queue, done = [], dict.fromkeys(sizes, 0)
    for number, r in sorted(enumerate(rows), key=lambda x: key(x[1])):
        done[r[3]] += words(r[1])
        for copy in (0, 1):
            finish = (done[r[3]] + copy * sizes[r[3]]) * (10 // weight[r[3]])
            queue.append((finish, order.index(r[3]), key(r), copy, words(r[1]), number))
    taken, run = [0] * len(rows), 0
    for *_, size, number in sorted(queue):
        run += size
        if run <= sum(sizes.values()) * 150 // 100:
            taken[number] += size
    return [(r[0], words(r[1]), sizes[r[3]], target[r[3]], t) for r, t in zip(rows, taken)]


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["a", "B", "é", None, "z", "tiny"]
    rows = []
    for i in range(n):
        source = rng.choice(names)
        size = 1 if source == "tiny" else rng.choice([0, 1, 5, 30, 200])
        rows.append((i, " ".join(str(rng.randrange(9)) for _ in range(size)) or None, "en", source))
    return rows


def test_equals_a_naive_version(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted(map(tuple, mixing.mix(samples.documents(spark, rows)).collect()))
        want = sorted(naive(rows))
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-6 * max(1, w[3]) for g, w in zip(got, want))


def test_sources_come_near_their_targets(spark):
    got = mixing.mix(samples.documents(spark, corpus(3, 2000))).collect()
    taken, target, largest = {}, {}, {}
    for r in got:
        source = r["target"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
        largest[source] = max(largest.get(source, 0), r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in taken)


def test_reruns_and_partitions_agree(spark):
    df = samples.documents(spark, corpus(4))
    run = lambda d: sorted(map(tuple, mixing.mix(d).collect()))
    assert run(df) == run(df.repartition(7))


def test_draw_keeps_all_columns(spark):
    df = samples.documents(spark, corpus(5))
    drawn = mixing.draw(df)
    assert drawn.columns == [*df.columns, "copies"]
    taken = sorted((r["doc_id"], r["taken"] // r["size"]) for r in mixing.mix(df).collect() if r["taken"])
    assert sorted((r["doc_id"], r["copies"]) for r in drawn.collect()) == taken


def test_hostile_and_empty(spark):
    rows = [(i, t, lang, s) for i, t, lang, s in samples.TEXTS]
    got = sorted(map(repr, (tuple(r)[:3] + tuple(r)[4:] for r in mixing.mix(samples.hostile(spark)).collect())))
    assert got == sorted(repr(w[:3] + w[4:]) for w in naive(rows))
    assert mixing.mix(samples.empty(spark)).collect() == []
    assert mixing.draw(samples.empty(spark)).collect() == []
    drawn = mixing.draw(samples.hostile(spark))
    assert drawn.columns == [*samples.DOCUMENTS.names, "copies_"] and drawn.count() > 0
    assert all(r["taken"] == 0 for r in mixing.mix(samples.documents(spark, [(1, None), (2, "")])).collect())
