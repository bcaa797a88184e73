"""Hard negatives against scores sorted one anchor at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skuloom.llm import hard_negatives as hn

SCHEMA = "id long, label long, vector array<long>"


def brute(rows, positives=5, negatives=5, percent=80):
    """Rows as (id, label, vector); ids that 100 divides are anchors."""
    out = []
    place = lambda i: (i is None, i or 0)
    for at, (anchor, label, vector) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = []
        for i, (row_id, other, v) in enumerate(rows):
            if i != at:
                score = sum(x * y for x, y in zip(vector, v))
                scored.append((-min(max(score, -(2**63) + 1), 2**63 - 1), place(row_id), row_id, other == label))
        scored.sort()
        for score, _, p_id, _ in [s for s in scored if s[3]][:positives]:
            p = -score
            fit = [s for s in scored if not s[3] and percent * p <= -100 * s[0] <= 100 * p]
            for rank, (n, _, n_id, _) in enumerate(fit[:negatives], 1):
                out.append((anchor, p_id, rank, n_id, p, -n))
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in hn.mine(df, F.col("id") % 100 == 0, **options).collect()), key=repr)


def some_rows(n, seed=1, labels=4, top=6):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(labels), [rnd.randint(-2, top) for _ in range(4)]) for i in range(n)]


def test_like_brute_force(spark):
    rows = some_rows(420)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3, percent=95) == brute(rows, 2, 3, 95)


def test_over_many_blocks(spark, monkeypatch):
    """The same rows whatever the blocks and groups."""
    rows = some_rows(900, seed=2, labels=2, top=3)  # many ties
    for name, value in (("BLOCK_ROWS", 7), ("GROUP_ROWS", 50), ("GROUP_ANCHORS", 2)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, rows) == brute(rows)


def test_one_common_vector(spark):
    rows = [(i, 1 if i % 3 else 2, [3, 4]) for i in range(500)] + [(1000, 1, [3, 4]), (1100, 9, [3, 4])]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, [1, 2, 3]), (0, 1, [1, 2, 3]), (100, 1, []), (200, 2, [0, 0, 0]), (300, 3, [-5, -5]),
        (None, 1, [1, 2, 3]), (None, 2, [1, 2, 3]), (7, 2, [1, 2, 3, 9]), (-100, 2, [2, 2]), (8, 1, [2, 2, 2]), (9, 3, [5, 5, 5]),
        (8, 2, [2, 2, 2]), (400, -4, [2**40, 2**40]), (401, -4, [2**40, 1]), (402, 5, [2**39, 2**39]), (403, 5, [1, 0]),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(1, 1, [1])]) == []


def test_extremes_of_scores():
    scores = np.array([[5, 2**62, -(2**63) + 1, 5, 2**63 - 1]])
    assert hn.first_places(scores, np.array([[True, True, True, True, False]]), 3).tolist() == [[1, 0, 3]]
    assert hn.first_places(scores[:, :2], np.array([[False, True]]), 3).tolist() == [[1, -1, -1]]
    assert hn.first_places(np.zeros((2, 0), dtype=np.int64), np.zeros((2, 0), dtype=bool), 2).tolist() == [[-1, -1]] * 2
    keys = hn.sort_keys([1, 1, -1, 1], [0, 0, 0, 0], [5, -7, 9, 5], [2, 0, 0, 1])
    assert hn.unpacked(sorted(keys)).tolist() == [[-1, 0, 9, 0], [1, 0, 5, 1], [1, 0, 5, 2], [1, 0, -7, 0]]


def test_the_iterator_holds_windows_only():
    """A million negatives below one positive, and as many ties, in constant space."""
    windows = hn.Windows(5, 5, 80)
    for i in range(200_000):
        assert not list(windows.take(1000, i, False))
        assert len(windows.ties) <= 5
    assert [r[1:3] for r in windows.take(1000, 200_001, True)] == [(i, i - 1) for i in range(1, 6)]
    for i in range(200_000):
        list(windows.take(999 - i, i, False))
        assert len(windows.open) <= 5


def test_usable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 2.0], 5), (2, None, [1.0], 5), (3, 1, None, 5), (4, 1, [None, 1.0], 5), (5, 1, [nan], 5), (6, 1, [1.0, -inf], 5), (7, 1, [], 5), (None, 1, [0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, vector int")
    assert [r.id for r in hn.usable(df, "vec_id", "label", "embedding").collect()] == [1, 7, None]


@pytest.mark.parametrize("empty_batch", [0, 1])
def test_emitting_over_batches(empty_batch):
    """Anchors that go on over the border of a batch."""
    keys = hn.sort_keys([1] * 4 + [2] * 2, [0] * 6, [9, 8, 8, 7, 4, 4], [5, 6, 7, 8, 1, 2])
    flags = [True, False, False, False, False, True]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.binary()), pa.array(flags[a:b])], names=["key", "positive"])
        for a, b in ((0, 0), (0, 2), (2, 5), (5, 6))[empty_batch:]
    ]
    rows = [tuple(r.values()) for b in hn.emit(iter(batches), 5, 2, 80) for r in b.to_pylist()]
    assert rows == [(1, 5, 1, 6, 9, 8), (1, 5, 2, 7, 9, 8), (2, 2, 1, 1, 4, 4)]
