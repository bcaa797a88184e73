"""Hard negatives: for each anchor and each of its best rows of the same label, the best rows of
other labels that score within a window below it.

Scores of anchors with all rows are made in blocks: rows and anchors are packed to matrices, dealt
to a grid of (anchor group, row group) cells, and each cell is a few matrix products. A cell hands
on only what can be among an anchor's first: its best rows of the same label in a first pass,
and, with the positives known, the best of each window in a second. These scores become keys of
(anchor, descending score, id). After one shuffle by anchor, sorted by key within partitions, an
iterator opens a window at each positive and emits negatives as they come. It holds the open
windows and the first negatives of the current score, never the rows of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.common import pick
from skuloom.session import materialize

# rows of a packed block, rows of a row group, anchors of an anchor group; bounds on memory
BLOCK_ROWS = 1024
GROUP_ROWS = 8192
GROUP_ANCHORS = 512
# row groups at most: beyond them groups grow, and with them what a cell sorts out
GROUPS = 4096
# stands for a missing id, which goes after all others
NO_ID = 2**63 - 1
_LEAST, _MOST = -(2**63), 2**63 - 1
_SIGN = np.uint64(1 << 63)

PACK = "ids binary, rows binary, labels binary, scores binary, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---- blocks ------------------------------------------------------------------------------


def _matrix(data: bytes, n: int) -> np.ndarray:
    """n vectors of whole numbers; the width of a number follows from ``width`` up front."""
    width = data[0]
    flat = np.frombuffer(data, dtype=np.int64 if width == 8 else np.int32, offset=8)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _pack(vectors: list[list[int]]) -> bytes:
    """The vectors as one matrix; shorter ones are filled up with zeros."""
    size = max(map(len, vectors), default=0)
    full = np.zeros((len(vectors), size), dtype=np.int64)
    for row, vector in zip(full, vectors):
        row[: len(vector)] = vector
    small = not full.size or (full.min() >= -(2**31) and full.max() < 2**31)
    kind = np.int32 if small else np.int64
    return bytes([4 if small else 8, *[0] * 7]) + full.astype(kind).tobytes()


def _longs(values) -> bytes:
    return np.asarray(values, dtype=np.int64).tobytes()


def packed(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (group, id, row, label, vector[, scores]), sorted by group, as blocks of one group."""
    schema = pa.schema([(group, pa.int32()), *[(c, pa.binary()) for c in ("ids", "rows", "labels", "scores", "vectors")]])

    def run(batches):
        held: dict[str, list] = {}
        current = None

        def flush():
            ids = [NO_ID if i is None else i for i in held["id"]]
            order = np.argsort(np.asarray(ids, dtype=np.int64), kind="stable")
            scores = [held["scores"][i] or [] for i in order]
            columns = [
                [current], [_longs(np.asarray(ids)[order])], [_longs(np.asarray(held["row"])[order])],
                [_longs(np.asarray(held["label"])[order])], [_pack(scores)],
                [_pack([held["vector"][i] for i in order])],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            names = batch.schema.names
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = dict(zip(names, values))
                if held and (row[group] != current or len(held["id"]) >= most):
                    yield flush()
                    held = {}
                if not held:
                    current, held = row[group], {n: [] for n in names}
                for name in names:
                    held[name].append(row[name])
        if held:
            yield flush()

    return rows.mapInArrow(run, f"{group} int, {PACK}")


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers; what does not fit is moved to the nearest that does."""
    size = max(left.shape[1], right.shape[1])
    left, right = [np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (left, right)]
    if not size or not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    most = [max(int(m.max()), -int(m.min())) for m in (left, right)]
    if most[0] * most[1] * size < 2**53:  # exact in doubles
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, _LEAST + 1, _MOST).astype(np.int64)


def first_places(scores: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """(len(scores), k) columns of the best usable scores, of equal ones the leftmost; -1: none."""
    n = scores.shape[1]
    out = np.full((len(scores), k), -1, dtype=np.int64)
    if not scores.size:
        return out
    bound = max(abs(int(scores.max())), abs(int(scores.min()))) + 1
    places = np.arange(n, dtype=np.int64)
    take = min(k, n)
    if bound * n < 2**62:
        keys = np.where(usable, scores * n + (n - 1 - places), _LEAST)
        if take < n:
            at = np.argpartition(keys, n - take, axis=1)[:, n - take :]
        else:
            at = np.broadcast_to(places, scores.shape)
        order = np.argsort(-np.take_along_axis(keys, at, axis=1), axis=1, kind="stable")
        # the least key stays the least when it is negated, and so goes first; it is marked below
        at = np.take_along_axis(at, order, axis=1)
    else:
        rank = np.where(usable, ~scores, _MOST)
        at = np.argsort(rank, axis=1, kind="stable")[:, :take]
    out[:, :take] = np.where(np.take_along_axis(usable, at, axis=1), at, -1)
    return out


class _Best:
    """The k best (score, id, row) of each anchor over several blocks."""

    def __init__(self, anchors: int, k: int):
        self.k = k
        self.scores = np.zeros((anchors, k), dtype=np.int64)
        self.ids = np.full((anchors, k), NO_ID, dtype=np.int64)
        self.rows = np.full((anchors, k), -1, dtype=np.int64)

    def add(self, scores: np.ndarray, usable: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        at = first_places(scores, usable, self.k)
        found = at >= 0
        if not found.any():
            return
        at = np.where(found, at, 0)
        new = (np.take_along_axis(scores, at, axis=1), ids[at], np.where(found, rows[at], -1))
        score, own, row = [np.concatenate(both, axis=1) for both in zip((self.scores, self.ids, self.rows), new)]
        order = np.lexsort((row, own, ~score, row < 0), axis=1)[:, : self.k]
        self.scores, self.ids, self.rows = [np.take_along_axis(m, order, axis=1) for m in (score, own, row)]


def sort_keys(anchor_ids, anchor_rows, scores, ids) -> list[bytes]:
    """(anchor, descending score, id) as bytes that sort in this order."""
    columns = [np.asarray(c, dtype=np.int64) for c in (anchor_ids, anchor_rows, ~np.asarray(scores, dtype=np.int64), ids)]
    # the flipped sign bit makes signed numbers sort as bytes
    both = np.stack([c.view(np.uint64) ^ _SIGN for c in columns], axis=1).astype(">u8")
    data = both.tobytes()
    return [data[i : i + 32] for i in range(0, len(data), 32)]


def unpacked(keys: list[bytes]) -> np.ndarray:
    """(anchor id, anchor row, score, id) of sort keys."""
    raw = np.frombuffer(b"".join(keys), dtype=">u8").astype(np.uint64).reshape(-1, 4)
    out = (raw ^ _SIGN).view(np.int64).copy()
    out[:, 2] = ~out[:, 2]
    return out


# ---- the iterator ------------------------------------------------------------------------


class Windows:
    """What is open of one anchor while its rows come in descending score."""

    def __init__(self, positives: int, negatives: int, percent: int):
        self.left, self.negatives, self.percent = positives, negatives, percent
        self.open: list[list[int]] = []  # [positive id, its score, negatives so far]
        self.level, self.ties = None, []

    def take(self, score: int, row_id: int, positive: bool) -> Iterator[tuple[int, int, int, int, int]]:
        """(positive id, rank, negative id, positive score, negative score) that this row settles."""
        if score != self.level:
            self.level, self.ties = score, []
            # scores only fall: what this one does not reach is closed for good
            self.open = [w for w in self.open if self.percent * w[1] <= 100 * score]
        if not positive:
            if len(self.ties) < self.negatives:
                self.ties.append(row_id)
            for window in self.open:
                window[2] += 1
                yield window[0], window[2], row_id, window[1], score
            self.open = [w for w in self.open if w[2] < self.negatives]
        elif self.left:
            self.left -= 1
            if self.percent * score > 100 * score:
                return  # a window below a negative score is empty
            # negatives of the same score with smaller ids came before their positive
            for rank, tied in enumerate(self.ties, 1):
                yield row_id, rank, tied, score, score
            if len(self.ties) < self.negatives:
                self.open.append([row_id, score, len(self.ties)])


def emit(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Result rows of batches (sort key, whether positive) in the order of the keys."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
    anchor, windows = None, None
    missing = lambda i: None if i == NO_ID else i
    for batch in batches:
        out: list[tuple] = []
        keys = unpacked(batch.column(0).to_pylist())
        for (anchor_id, row, score, row_id), positive in zip(keys.tolist(), batch.column(1).to_pylist()):
            if (anchor_id, row) != anchor:
                anchor, windows = (anchor_id, row), Windows(positives, negatives, percent)
            for p_id, rank, n_id, p_score, n_score in windows.take(score, row_id, positive):
                out.append((missing(anchor_id), missing(p_id), rank, missing(n_id), p_score, n_score))
        columns = zip(*out) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


# ---- Spark -------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """(id, label, vector of doubles) of the rows with a label and a vector of finite numbers."""
    rows = pick(vectors, id_column, label_column, vector_column).toDF("id", "label", "vector")
    rows = rows.select("id", "label", F.col("vector").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _cells(rows: DataFrame, anchors: DataFrame, anchor_groups: int, row_groups: int) -> DataFrame:
    """Every block of rows beside every block of anchors, by (anchor group, row group)."""
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("a", deal(row_groups).alias("r"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "rows", "labels", "scores", "vectors")])
    right = rows.select(deal(anchor_groups).alias("a"), "r", "ids", "rows", "labels", "vectors")
    return left.join(right, ["a", "r"])


def _candidates(cells: DataFrame, k: int, percent: int | None) -> DataFrame:
    """(key, positive): per cell, the best rows of the anchors' labels, or, with ``percent``, the
    best rows of other labels in the window below each of the anchors' scores."""
    schema = pa.schema([("key", pa.binary()), ("positive", pa.bool_())])

    def flush(held):
        anchor_ids, anchor_rows, best = held
        score, ids, rows = [np.concatenate([getattr(b, n) for b in best], axis=1) for n in ("scores", "ids", "rows")]
        # windows overlap: each row of an anchor once
        order = np.argsort(rows, axis=1, kind="stable")
        score, ids, rows = [np.take_along_axis(m, order, axis=1) for m in (score, ids, rows)]
        new = rows >= 0
        new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        at = np.nonzero(new)
        keys = sort_keys(anchor_ids[at[0]], anchor_rows[at[0]], score[at], ids[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(np.full(len(keys), percent is None))], schema=schema
        )

    def run(batches):
        current, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                longs = {n: np.frombuffer(part[n], dtype=np.int64) for n in ("a_ids", "a_rows", "a_labels", "ids", "rows", "labels")}
                block = (part["a"], part["r"], part["a_rows"])
                limits = None if percent is None else _matrix(part["a_scores"], len(longs["a_ids"]))
                if block != current:
                    if held:
                        yield flush(held)
                    lists = 1 if percent is None else limits.shape[1]
                    best = [_Best(len(longs["a_ids"]), k) for _ in range(lists)]
                    current, held = block, (longs["a_ids"], longs["a_rows"], best)
                if not held[2]:
                    continue
                scores = inner_products(
                    _matrix(part["a_vectors"], len(longs["a_ids"])), _matrix(part["vectors"], len(longs["ids"]))
                )
                same = longs["a_labels"][:, None] == longs["labels"][None, :]
                if percent is None:
                    other = longs["a_rows"][:, None] != longs["rows"][None, :]
                    held[2][0].add(scores, same & other, longs["ids"], longs["rows"])
                    continue
                for column, best in enumerate(held[2]):
                    high = limits[:, column].astype(np.int64)
                    # scores are whole, so the window starts at the next whole number
                    low = np.array([-((-percent * int(p)) // 100) for p in high], dtype=object)
                    low = np.clip(low, _LEAST, _MOST).astype(np.int64)[:, None]
                    within = ~same & (scores <= high[:, None]) & (scores >= low)
                    best.add(scores, within, longs["ids"], longs["rows"])
        if held and held[2]:
            yield flush(held)

    return cells.mapInArrow(run, "key binary, positive boolean")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Hard negatives of the anchors among all rows of (id long, label long, vector array<long>).

    A row's score is its inner product with the anchor; higher ones come first, of equal ones the
    smaller id. The anchor's first ``positives`` other rows of its label are its positives. For each,
    the first ``negatives`` rows of other labels with ``percent * positive_score <= 100 *
    negative_score <= 100 * positive_score`` are returned, ranked from 1. ``is_anchor`` is a
    condition on id, label and vector.

    No row may have a null label, vector or component. Missing ids go last among equal scores
    (2^63-1 stands for them and is not to be used); a repeated row is a row, also as an anchor. Vectors
    of different lengths are compared as if filled up with zeros. Scores beyond 64 bits count as the
    nearest that fits. Anchors without positives, and windows without negatives, give no rows; so
    does an empty table.
    """
    numbered = vectors.select("id", "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialize(numbered.withColumn("row", F.monotonically_increasing_id()), "hard-negative-rows")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    row_groups = max(1, min(GROUPS, -(-n_rows // GROUP_ROWS)))
    anchor_groups = max(1, -(-n_anchors // GROUP_ANCHORS))
    # dealt by row number, so that equal ids do not meet in one group
    dealt = lambda df, name, n: (
        df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).repartition(name).sortWithinPartitions(name)
    )
    columns = ("id", "row", "label", "vector", "scores")
    none = F.lit(None).cast("array<long>").alias("scores")
    blocks = materialize(
        packed(dealt(rows.withColumn("scores", none), "r", row_groups).select("r", *columns), "r", BLOCK_ROWS),
        "hard-negative-blocks",
    )
    anchors = rows.where("anchor")
    asked = packed(dealt(anchors.withColumn("scores", none), "a", anchor_groups).select("a", *columns), "a", GROUP_ANCHORS)
    keys = _candidates(_cells(blocks, asked, anchor_groups, row_groups), positives, None)
    # an anchor is the first sixteen bytes of a key
    per_anchor = keys.groupBy(F.substring("key", 1, 16).alias("anchor_key"))
    best = materialize(
        per_anchor.agg(F.slice(F.sort_array(F.collect_list("key")), 1, positives).alias("keys")), "hard-negative-positives"
    )
    # the third number of a key is the score, upside down
    number = lambda at: F.conv(F.hex(at), 16, -10).cast("long")
    flipped = lambda at: number(at).bitwiseXOR(F.lit(_LEAST))
    scored = best.select(
        flipped(F.expr("substring(anchor_key, 9, 8)")).alias("row"),
        F.transform("keys", lambda k: F.bitwise_not(flipped(k.substr(17, 8)))).alias("scores"),
    )
    limits = anchors.join(scored, "row")
    again = packed(dealt(limits, "a", anchor_groups).select("a", *columns), "a", GROUP_ANCHORS)
    found = _candidates(_cells(blocks, again, anchor_groups, row_groups), negatives, percent)
    opening = best.select(F.explode("keys").alias("key"), F.lit(True).alias("positive"))
    ordered = (
        opening.unionByName(found)
        .withColumn("anchor_key", F.substring("key", 1, 16))
        .repartition("anchor_key")
        .sortWithinPartitions("key")
        .select("key", "positive")
    )
    return ordered.mapInArrow(lambda batches: emit(batches, positives, negatives, percent), RESULT)


SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
