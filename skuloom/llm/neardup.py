"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Documents become sets of word shingles; equal sets form one class. A class is sketched by
``SLOTS`` minwise tokens. In each of ``TREES`` independent trees a class enters those children
of a node whose token it holds and whose coin, a hash of node and token, falls below
1 / (similarity * SLOTS): classes at the threshold share one child per level on average, others
fewer. Small nodes are compared exhaustively on the sketches; large ones are branched again.
Sketches that come near the threshold put classes into one family.

Families are confirmed on the full sets, exhaustively, in tasks of bounded size. A large family
is first tried against hubs, one pair for each member; what these links join needs no further
comparison among itself, and blocks of the family are compared only across such components. So
copies of one text cost one comparison each, and no pair that could join two components is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, flat, lower_words, pick, position_of, positions, sieved, without
from skuloom.session import materialize

SLOTS = 128
TREES = 16
# members of a node that are compared exhaustively; larger nodes are branched
SMALL_NODE = 4096
# levels of branching; nodes that are still large are compared in pairs of blocks
LEVELS = 5
# Members of a family compared on full sets in one task; larger families go by pairs of blocks,
# which costs a copy of each set per block. A member of many shingles counts as several.
FAMILY = 2048
MEMBER_SHINGLES = 2000
# shingles whose presence is held as a matrix at once
COLUMNS = 4096
# standard deviations that an estimate may lie below the threshold
MARGIN = 4.0
# members of a hub that are confirmed in one task
HUB_MEMBERS = 512
SET_PIECE = 2048

_RNG = np.random.default_rng(20)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_CACHE = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred, so that any part of the result is as good as random."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _WORD_CACHE:
                self.known.clear()
            found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = lower_words(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        hashes = np.array([self._hash(w) for w in words], dtype=np.uint64)
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : len(words) - width + 1 + k] * _PLACES[k]
        return np.unique(mixed(total))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of ``SLOTS`` hash functions over the set."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), SET_PIECE):
        part = shingles[None, start : start + SET_PIECE] * _MULTIPLIERS[:, None] + _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def chosen(nodes: np.ndarray, tokens: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of the tokens whose coin lets the row into a child.

    ``nodes`` (rows) and ``tokens`` (rows, slots) are 64-bit numbers.
    """
    slots = mixed(np.arange(1, tokens.shape[1] + 1, dtype=np.uint64))
    children = mixed(mixed(tokens ^ slots[None, :]) ^ nodes[:, None])
    row, slot = np.nonzero(mixed(children + np.uint64(1)) < np.uint64(min(1.0, chance) * float(2**64 - 2048)))
    return row, children[row, slot]


# ---- sketches ----------------------------------------------------------------------------

SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
    ]
)


def _sketcher(width: int, similarity: float):
    def make():
        shingler = Shingler(width)
        trees = mixed(np.arange(101, 101 + TREES, dtype=np.uint64))
        chance = 1 / (similarity * SLOTS)

        def one(text):
            shingles = shingler(text)
            if not len(shingles):
                return 0, None, None, None
            least = minwise(shingles)
            _, nodes = chosen(trees, np.broadcast_to(least, (TREES, SLOTS)), chance)
            key = xxhash.xxh3_128_digest(shingles.tobytes())
            sketch = (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()
            return len(shingles), key, sketch, np.unique(nodes).view(np.int64)

        def every(texts):
            return dict(zip(SKETCH.names, zip(*map(one, texts)))) if texts else {n: [] for n in SKETCH.names}

        return every

    return make


# ---- comparing inside nodes --------------------------------------------------------------


def least_matches(similarity: float) -> float:
    """Equal sketch bytes from which a pair is a candidate."""
    p = similarity + (1 - similarity) / 256
    return SLOTS * p - MARGIN * (SLOTS * p * (1 - p)) ** 0.5


def _matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty((len(left), len(right)), dtype=np.int32)
    for start in range(0, len(left), 16):
        out[start : start + 16] = (left[start : start + 16, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int32)
    return out


def _passing(matches: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that the sketches and the set sizes allow."""
    small = np.minimum(left[:, None], right[None, :])
    large = np.maximum(left[:, None], right[None, :])
    return (matches >= least_matches(similarity)) & (small >= similarity * large - 1e-9)


def _spread(passing: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(passing))
    while True:
        least = np.minimum(label, np.where(passing, label[None, :], len(label)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def joined(sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int, int]]:
    """Edges (member, hub, matches) that join the members of a node as all passing pairs do.

    A member's hub is the first member that it probably links with; failing that, its best.
    Edges that only keep a component together have no matches.
    """
    matches = _matches(sketches, sketches)
    passing = _passing(matches, sizes, sizes, similarity)
    np.fill_diagonal(passing, False)
    inside = np.flatnonzero(passing.any(axis=1))
    if not len(inside):
        return []
    strong = passing & (matches >= similarity * SLOTS)
    hub = np.where(strong.any(axis=1), strong.argmax(axis=1), np.where(passing, matches, -1).argmax(axis=1))
    edges = [(int(i), int(hub[i]), int(matches[i, hub[i]])) for i in inside]
    drawn = np.zeros_like(passing)
    drawn[inside, hub[inside]] = drawn[hub[inside], inside] = True
    wanted, have = _spread(passing), _spread(drawn)
    edges += [(int(i), int(wanted[i]), 0) for i in inside if have[i] == i and wanted[i] != i]
    return edges


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first columns, from batches sorted by it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        first = table.column(0).to_numpy()
        start = int(np.flatnonzero(first == first[-1])[0])
        if start:
            yield table.slice(0, start)
        rest = table.slice(start)
    if rest is not None:
        yield rest


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("matches", pa.int32())])
EDGE_DDL = "a binary, b binary, matches int"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], names=schema.names)


def _together(members: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys next to each other in one partition."""
    return members.repartition(*keys).sortWithinPartitions(*keys, "key")


def node_edges(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a: member, b: hub, matches) of members (node, key, n, sketch) of small nodes."""

    def run(batches):
        for table in _runs(batches):
            node = table.column(0).to_numpy()
            keys, sizes, sketch = table.column(1).to_pylist(), table.column(2).to_numpy(), _matrix(table.column(3))
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            ends = np.append(starts[1:], len(node))
            out = []
            two = starts[ends - starts == 2]
            if len(two):
                same = (sketch[two] == sketch[two + 1]).sum(axis=1)
                small, large = np.minimum(sizes[two], sizes[two + 1]), np.maximum(sizes[two], sizes[two + 1])
                good = (same >= least_matches(similarity)) & (small >= similarity * large - 1e-9)
                out += [(keys[i + 1], keys[i], int(m)) for i, m in zip(two[good], same[good])]
            for start, end in zip(starts, ends):
                if end - start > 2:
                    edges = joined(sketch[start:end], sizes[start:end], similarity)
                    out += [(keys[start + i], keys[start + h], m) for i, h, m in edges]
            yield _batch(EDGE, out)

    return _together(members.select("node", "key", "n", "sketch"), "node").mapInArrow(run, EDGE_DDL)


# ---- confirming on full sets -------------------------------------------------------------


def full_sets(documents: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of classes (key, id), from documents (id, text): one document each.

    Rows are brought together by document id, so that the copies of a hot text spread out.
    """
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def make():
        shingler = Shingler(width)

        def every(texts):
            sets = [shingler(t).tobytes() for t in texts]
            return {"key": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets}

        return every

    wanted = classes.select(F.col("id").alias("w_id"), F.col("digest").alias("w_digest"))
    rows = documents.select("id", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    rows = sieved(rows, "digest", wanted.select("w_digest"), "may_match").where("may_match")
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")), "left_semi")
    rows = rows.dropDuplicates(["id", "digest"])
    return flat(append_result(rows, ["text"], make, schema, "found").select("found"), "found")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a: member, b: hub): intersection and union of the full sets.

    Members of a hub are dealt to as many tasks as they need; each gets the hub's set once.
    """
    degree = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / HUB_MEMBERS) + 1).cast("int").alias("parts"))
    members = pairs.join(degree, "b").join(sets, pairs["a"] == sets["key"]).select(
        "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a", "shingles"
    )
    heads = degree.join(sets, degree["b"] == sets["key"]).select(
        "b",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("binary").alias("a"),
        "shingles",
    )

    def run(batches):
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())])
        hub, own = None, None
        for batch in batches:
            out = []
            for b, a, raw in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                shingles = np.frombuffer(raw, dtype=np.uint64)
                if a is None:
                    hub, own = b, shingles
                elif b == hub:
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    out.append((a, b, 100 * both >= percent * (len(own) + len(shingles) - both)))
            yield _batch(schema, out)

    together = heads.unionByName(members).repartition("b", "part")
    ordered = together.sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return ordered.mapInArrow(run, "a binary, b binary, linked boolean").distinct()


# ---- components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(key, label) of the keys in links (a, b): the least key of each connected component.

    Each round every key takes its least neighbour (or itself) as parent, parents are followed
    once more, and the links are drawn between the parents. Every key that still has links
    meets a smaller one or is met, so the number of keys at least halves; links to one hub
    take one round. Parents are found with partial sums, so a hub is no burden.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    steps = []
    while True:
        edges = materialize(edges.distinct(), "links")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        parent = least.select(F.col("a").alias("key"), F.least("a", "least").alias("label"))
        up = parent.select(F.col("key").alias("label"), F.col("label").alias("next"))
        parent = parent.join(up, "label").select("key", F.col("next").alias("label"))
        steps.append(materialize(parent, "parents"))
        drawn = edges
        for end in ("a", "b"):
            named = steps[-1].select(F.col("key").alias(end), F.col("label").alias("to"))
            drawn = drawn.join(named, end).drop(end).withColumnRenamed("to", end)
        edges = drawn.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not steps:
        return edges.select(F.col("a").alias("key"), F.col("b").alias("label"))
    labels = steps[0]
    for step in steps[1:]:
        up = step.select(F.col("key").alias("label"), F.col("label").alias("next"))
        labels = labels.join(up, "label", "left").select("key", F.coalesce("next", "label").alias("label"))
    return materialize(labels, "labels") if len(steps) > 1 else labels


# ---- the join ----------------------------------------------------------------------------


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("key").alias("l_key"), "label")
    return rows.join(found, rows["key"] == F.col("l_key"), "left").drop("l_key").withColumn("label", F.coalesce("label", "key"))


def _branched(members: DataFrame, similarity: float) -> DataFrame:
    """The children of members (node, key, n, sketch), with the same columns."""
    names = ["node", "key", "n", "sketch"]
    chance = 1 / (similarity * SLOTS)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(start, 1024)])
                nodes = part.column(0).to_numpy().view(np.uint64)
                row, child = chosen(mixed(nodes), _matrix(part.column(3)).astype(np.uint64), chance)
                taken = part.take(pa.array(row))
                taken = taken.set_column(0, "node", pa.array(child.view(np.int64)))
                yield from taken.to_batches()

    return members.select(*names).mapInArrow(run, members.select(*names).schema)


def _node_blocks(members: DataFrame) -> DataFrame:
    """Members of large nodes dealt to all pairs of blocks, as small nodes."""
    half = SMALL_NODE // 2
    sizes = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks"))
    placed = members.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return paired.select(pair.alias("node"), "key", "n", "sketch")


def _tried(large: DataFrame, similarity: float) -> DataFrame:
    """Members (node, key, n, sketch) of large nodes but for each node's hub, with ``hub`` and
    ``matches`` (-1 where the pair does not pass)."""
    hub = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "key", "n", "sketch")).alias("h"))
    pairs = large.join(hub, "node").where(F.col("key") != F.col("h.key"))
    out = T.StructType([*large.select("node", "key", "n", "sketch").schema.fields, T.StructField("hub", T.BinaryType()), T.StructField("matches", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                same = (_matrix(part.column(3)) == _matrix(part.column(6))).sum(axis=1)
                mine, theirs = part.column(2).to_numpy(), part.column(5).to_numpy()
                good = (same >= least_matches(similarity)) & (
                    np.minimum(mine, theirs) >= similarity * np.maximum(mine, theirs) - 1e-9
                )
                matches = pa.array(np.where(good, same, -1).astype(np.int32))
                columns = [*(part.column(i) for i in range(5)), matches]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    plain = pairs.select("node", "key", "n", "sketch", "h.key", "h.n", "h.sketch")
    return plain.toDF("node", "key", "n", "sketch", "hub", "h_n", "h_sketch").mapInArrow(run, out)


def _large_nodes(large: DataFrame, similarity: float) -> list[DataFrame]:
    """Edges of members (node, key, n, sketch) of large nodes.

    All members are compared with a hub. Those that pass it are joined already; the others are
    compared with all members, in parts, if they are few, or the node is branched.
    """
    found, half, columns = [], SMALL_NODE // 2, ["node", "key", "n", "sketch"]
    for level in range(LEVELS):
        tried = materialize(_tried(large, similarity), "near-nodes")
        found.append(tried.where("matches >= 0").select(F.col("key").alias("a"), F.col("hub").alias("b"), "matches"))
        sizes = tried.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("matches") < 0).alias("others"))
        rest = tried.join(sizes.where("others > 0"), "node")
        parts = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("others")) / half)).cast("int")
        own = F.when(F.col("matches") < 0, F.sequence(F.lit(0), parts - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("key"), parts).cast("int"))
        )
        few = rest.where(F.col("others") <= half).withColumn("part", F.explode(own))
        few = few.select(F.xxhash64("node", "part").alias("node"), "key", "n", "sketch")
        children = materialize(_branched(rest.where(F.col("others") > half), similarity), "near-nodes")
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        children = children.join(sizes, "node")
        small = children.where(F.col("size") <= SMALL_NODE).select(*columns)
        found.append(materialize(node_edges(few.unionByName(small), similarity), "near-edges"))
        large = materialize(children.where(F.col("size") > SMALL_NODE).select(*columns), "near-nodes")
        if large.isEmpty():
            return found
    return [*found, materialize(node_edges(_node_blocks(large), similarity), "near-edges")]


def candidate_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b, matches) that join what the trees bring together."""
    entered = classes.select("key", F.explode("nodes").alias("node"))
    sizes = entered.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = entered.join(sizes, "node").join(classes.select("key", "n", "sketch"), "key")
    members = materialize(members.select("node", "key", "n", "sketch", "size"), "near-nodes")
    edges = materialize(node_edges(members.where(F.col("size") <= SMALL_NODE), similarity), "near-edges")
    large = members.where(F.col("size") > SMALL_NODE).drop("size")
    if not large.isEmpty():
        for more in _large_nodes(large, similarity):
            edges = edges.unionByName(more)
    return edges


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets.

    Shingles of one set only add nothing; the others are counted as products of presence.
    """
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, member = every[order], member[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    member, first = member[shared], first[shared]
    number = np.cumsum(first) - 1
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    edges = np.searchsorted(number, np.arange(0, number[-1] + 1 + COLUMNS, COLUMNS)) if len(number) else [0]
    for k, (start, end) in enumerate(zip(edges[:-1], edges[1:])):
        present = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        present[member[start:end], number[start:end] - k * COLUMNS] = 1
        out += present @ present.T
    return out.astype(np.int64)


def family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members (task, key, label, shingles): for every task, enough of them to
    join what its linked pairs of different labels join."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for table in _runs(batches):
            task = table.column(0).to_numpy()
            keys, labels, raw = (table.column(i).to_pylist() for i in (1, 2, 3))
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            for start, end in zip(starts, np.append(starts[1:], len(task))):
                at = range(start, end)
                sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in at]
                sizes = np.array([len(s) for s in sets])
                both = common(sets)
                linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
                number = {x: i for i, x in enumerate(dict.fromkeys(labels[i] for i in at))}
                label = np.array([number[labels[i]] for i in at])
                linked &= label[:, None] != label[None, :]
                yield _batch(schema, _forest(linked, label, [keys[i] for i in at]))

    ordered = members.select("task", "key", "label", "shingles").repartition("task").sortWithinPartitions("task", "key")
    return ordered.mapInArrow(run, "a binary, b binary")


def _forest(linked: np.ndarray, label: np.ndarray, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Pairs that join the labels as all linked pairs do."""
    parent = list(range(int(label.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        for j in np.flatnonzero(linked[i, : i]):
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                parent[a] = b
                out.append((keys[i], keys[j]))
    return out


def _family_blocks(members: DataFrame) -> DataFrame:
    """Members (family, key, label, weight) of large families dealt to tasks that compare two blocks.

    A component that fills blocks of its own is not compared with itself; all others share
    blocks. Every pair of different labels meets in one task.
    """
    half = FAMILY // 2
    sized = members.groupBy("family", "label").agg(F.sum("weight").alias("n"))
    sized = sized.withColumn("core", F.when(F.col("n") >= half, F.col("label")))
    parts = sized.groupBy("family", "core").agg(F.ceil(F.sum("n") / half).cast("int").alias("parts"))
    named = sized.join(
        parts.select(F.col("family").alias("p_family"), F.col("core").alias("p_core"), "parts"),
        (F.col("family") == F.col("p_family")) & F.col("core").eqNullSafe(F.col("p_core")),
    ).select(F.col("family").alias("f"), F.col("label").alias("l"), "core", "parts")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    block = F.xxhash64("family", F.coalesce("core", F.lit(b"")), part)
    placed = members.join(named, (F.col("family") == F.col("f")) & (F.col("label") == F.col("l"))).select(
        "family", "key", "label", "core", block.alias("block")
    )
    numbers = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = parts.select("family", "core", numbers.alias("part")).select(
        "family", "core", F.xxhash64("family", F.coalesce("core", F.lit(b"")), "part").alias("block")
    )
    other = blocks.select(F.col("family").alias("o_family"), F.col("core").alias("o_core"), F.col("block").alias("o_block"))
    own = F.col("core").isNotNull() & F.col("core").eqNullSafe(F.col("o_core"))
    paired = placed.join(other, (F.col("family") == F.col("o_family")) & ~own)
    task = F.xxhash64("family", F.least("block", "o_block"), F.greatest("block", "o_block"))
    return paired.select(task.alias("task"), "key", "label")


def link(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels) of documents (id, text): rows (id, digest, n_shingles, key) and the
    component (key, label) of every key that is linked with another."""
    similarity = percent / 100
    rows = documents.select("id", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    sketched = append_result(rows, ["text"], _sketcher(width, similarity), SKETCH, "found").drop("text")
    rows = materialize(flat(sketched, "found"), "near-rows")
    # equal sets: one class, known by one of its documents
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("id", "digest")).alias("one"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"),
        F.first("nodes").alias("nodes"),
    ).select("key", "one.id", "one.digest", "n", "sketch", "nodes")
    classes = materialize(classes, "near-classes")
    edges = candidate_edges(classes, similarity)
    families = components(edges).select("key", F.col("label").alias("family"))
    weight = F.expr(f"1 + n div {MEMBER_SHINGLES}").alias("weight")
    families = families.join(classes.select("key", "n"), "key").select("key", "family", weight)
    sizes = families.groupBy("family").agg(F.sum("weight").alias("size"))
    families = materialize(families.join(sizes, "family"), "near-families")
    wanted = classes.join(families.select("key"), "key", "left_semi").select("id", "digest")
    sets = materialize(full_sets(documents, wanted, width), "near-sets")
    with_sets = lambda tasks: tasks.join(sets, "key")
    few = families.where(F.col("size") <= FAMILY).select(
        F.xxhash64("family").alias("task"), "key", F.col("key").alias("label")
    )
    links = materialize(family_links(with_sets(few), percent), "near-links")
    many = families.where(F.col("size") > FAMILY).select("family", "key", "weight")
    if not many.isEmpty():
        links = links.unionByName(_large_families(many, edges, sets, similarity, percent))
    return rows, components(links)


def _large_families(many: DataFrame, edges: DataFrame, sets: DataFrame, similarity: float, percent: int) -> DataFrame:
    """Links (a, b) that join the members (family, key, weight) of large families."""
    # one hub for each member: the first that it probably links with, or its best
    candidates = edges.where("matches > 0").join(many.select(F.col("key").alias("a")), "a", "left_semi")
    weak = F.col("matches") < similarity * SLOTS
    order = F.struct(weak.alias("weak"), F.when(weak, -F.col("matches")).otherwise(0).alias("worse"), "b")
    first = candidates.groupBy("a").agg(F.min(order).alias("o")).select("a", "o.b")
    tested = materialize(confirm(first, sets, percent).where("linked").select("a", "b"), "near-tested")
    placed = _labelled(many, components(tested))
    several = placed.groupBy("family").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed")
    placed = materialize(placed.join(several.select("family"), "family", "left_semi"), "near-placed")
    tasks = _family_blocks(placed)
    return tested.unionByName(materialize(family_links(tasks.join(sets, "key"), percent), "near-links"))


def groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked when 100 * common shingles >= ``percent`` * all shingles of both; a
    component is what links reach, named by its least id, and the documents with that id are
    kept. Texts of fewer than ``width`` words are one shingle.

    Null, empty and blank texts have no shingles and are linked with nothing. Null ids are
    larger than all others; documents linked only with null ids have a null component and are
    kept. Repeated rows are copies with the same id: all are kept if one is. Long texts are
    hashed in pieces. An empty table gives no rows. Further columns are ignored.
    """
    rows, labels = link(pick(documents, id_column, text_column).toDF("id", "text"), width, percent)
    named = _named(rows, labels)
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return named.select(
        F.col("id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with ``component``: the least id of all rows in the row's component."""
    keys = _labelled(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least")), labels)
    least = keys.groupBy("label").agg(F.min("least").alias("component"))
    names = keys.join(least, "label").select(F.col("key").alias("n_key"), "component")
    return rows.join(names, rows["key"] == F.col("n_key"), "left")


def drop_copies(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``documents`` (all columns) with one document of each group of near-copies.

    The one with the least id stays (of equal ids the one with the least text digest, of equal
    rows one). Documents without words stay.
    """
    names, plain = documents.columns, positions(documents)
    at_id, at_text = (f"c{position_of(documents, n)}" for n in (id_column, text_column))
    rows, labels = link(plain.select(F.col(at_id).alias("id"), F.col(at_text).alias("text")), width, percent)
    keys = _labelled(rows.where("key IS NOT NULL"), labels).select("label", "id", "digest")
    best = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    counted = keys.groupBy("label", "id", "digest").agg(F.count(F.lit(1)).alias("times"))
    stay = counted.groupBy("label").agg(F.min(best).alias("s")).select("label", F.col("s.id").alias("id"), F.col("s.digest").alias("digest"))
    same = (F.col("x.id").eqNullSafe(F.col("s.id"))) & (F.col("x.digest") == F.col("s.digest"))
    marked = counted.alias("x").join(stay.alias("s"), (F.col("x.label") == F.col("s.label")) & same, "left")
    decided = marked.select(
        F.col("x.id").alias("d_id"), F.col("x.digest").alias("r_digest"), F.col("s.label").isNotNull().alias("stays"), "times"
    )
    decided = materialize(decided.where(~F.col("stays") | (F.col("times") > 1)), "near-decided")
    keyed = plain.withColumn("digest", F.md5(F.col(at_text).cast("binary")))
    match = F.col(at_id).eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("r_digest"))
    rest = without(keyed, "digest", decided, match)
    repeated = decided.where("stays")
    if not repeated.isEmpty():
        once = keyed.join(repeated, match, "left_semi").dropDuplicates([at_id, "digest"])
        rest = rest.unionByName(once)
    return rest.select(*plain.columns).toDF(*names)
