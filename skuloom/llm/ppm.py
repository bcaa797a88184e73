"""Language-model scores by prediction by partial matching over bytes.

A text is a chain of bytes: its words in lower case, a space after each, and one more space for its
end (the empty word). Every byte is predicted from the ``ORDER`` bytes before it, across words, and,
if the trie of training contexts has not seen it there, from shorter contexts in turn:

- escape estimation: of each symbol's count in a context, ``DISCOUNT`` is kept back; what is kept
  back is the chance to escape to the next shorter context;
- symbol exclusion: a context that is escaped to does not predict the symbols of the longer one;
- update exclusion: the longest contexts count all occurrences, a shorter one counts a symbol
  once for each longer context that has it, since only those lead to it;
- after the empty context, all bytes that training never had are equally likely.

Two modes: pretrained (``score``), with the trie of all training texts, and adaptive
(``adaptive_scores``), where each document's trie starts empty and learns byte by byte.

The trie is a table of (context and symbol, count) in Spark. A byte's probability depends on its
context and itself only, so each distinct pair is scored once, by joins with the tables of one order
after the other, and documents sum over their pairs. Pairs that make up a fixed share of all
symbols are summed where the text is read; the others are joined.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import SLICE_ROWS, append_result, crc_remainder, free_name, lower_words, pick, position_of, positions
from skuloom.session import materialize

# bytes of context, at most 6: with the symbol they fit a 64-bit code
ORDER = 5
# kept back from each count for the escape
DISCOUNT = 0.25
# Words, and pairs of context and symbol, that are at least this share of all are looked up where
# the text is read: at most 1 / HOT_WORDS words and 1 / HOT_PAIRS numbers are broadcast, whatever
# the corpus. The others are joined. The results do not depend on it.
HOT_WORDS = 2.0**-19
HOT_PAIRS = 2.0**-22
# distinct words, and symbols, counted in a task before they are handed on
FLUSH_WORDS = 500_000
FLUSH_SYMBOLS = 8_000_000


# ---- codes -------------------------------------------------------------------------------


def chain(words: list[bytes], order: int) -> bytes:
    """The text as bytes, after ``order`` spaces that stand for what was before."""
    return b" " * order + b" ".join(words) + (b"  " if words else b" ")


def pair_codes(text: bytes, order: int) -> np.ndarray:
    """For each byte of a chain, the bytes of its context and itself as one number."""
    data = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
    n = len(data) - order
    codes = np.zeros(n, dtype=np.int64)
    for k in range(order + 1):
        codes = (codes << 8) | data[k : k + n]
    return codes


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def keys_of(codes: np.ndarray, order: int) -> pa.Array:
    """Codes as binary keys: a space and the bytes, so that no word is among them."""
    raw = np.empty((len(codes), order + 2), dtype=np.uint8)
    raw[:, 0] = 32
    raw[:, 1:] = codes.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 7 - order :]
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * (order + 2)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


# ---- adaptive mode -----------------------------------------------------------------------


def adaptive_code_length(text: str | None, order: int = ORDER) -> float:
    """Log10 probability of one text under a trie that starts empty and learns byte by byte.

    Linear in the text's bytes, in plain Python.
    """
    seen: dict[bytes, dict[int, int]] = {}
    data = chain(lower_words(text), order)
    total = 0.0
    for i in range(order, len(data)):
        symbol, hidden, p, found = data[i], set(), 1.0, -1
        for k in range(order, -1, -1):
            table = seen.get(data[i - k : i])
            left = {s: n for s, n in table.items() if s not in hidden} if table else None
            if not left:
                continue
            size = sum(left.values())
            if symbol in left:
                p *= (left[symbol] - DISCOUNT) / size
                found = k
                break
            p *= DISCOUNT * len(left) / size
            hidden |= set(left)
        else:
            p /= 256 - len(hidden)
        total += math.log10(p)
        # the context that knew the symbol learns it, and the longer ones; not the shorter ones
        for k in range(max(found, 0), order + 1):
            table = seen.setdefault(data[i - k : i], {})
            table[symbol] = table.get(symbol, 0) + 1
    return total


def adaptive_scores(documents: DataFrame, text_column: str = "text", result: str = "adaptive_score", order: int = ORDER) -> DataFrame:
    """``documents`` with the adaptive log10 probability of each text. Null texts count as empty;
    repeated rows each get theirs; an empty table stays empty; other columns stay, whatever their names."""
    schema = T.StructType([T.StructField("p", T.DoubleType())])
    plain = positions(documents)
    make = lambda: lambda texts: {"p": [adaptive_code_length(t, order) for t in texts]}
    found = append_result(plain, [f"c{position_of(documents, text_column)}"], make, schema, "_adaptive_")
    return found.select(*plain.columns, "_adaptive_.p").toDF(*documents.columns, free_name(documents, result))


# ---- counts ------------------------------------------------------------------------------

COUNTS = "word binary, code long, train long, seen long"


def counts(rows: DataFrame, order: int) -> DataFrame:
    """(word or code, train, seen) of rows (text, held_out): how often each word, and each pair of
    context and symbol, occurs in training texts and in all."""
    schema = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("train", pa.int64()), ("seen", pa.int64())])

    def run(batches):
        words = (Counter(), Counter())
        pairs: list[list[np.ndarray]] = [[], []]
        waiting = 0
        # distinct pairs so far with their counts in training and in all
        known = (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))

        def batch_of(word, code, numbers):
            n = len(numbers)
            word = pa.nulls(n, pa.binary()) if word is None else pa.array(word, pa.binary())
            code = pa.nulls(n, pa.int64()) if code is None else pa.array(code)
            return pa.RecordBatch.from_arrays([word, code, pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], schema=schema)

        def flush_words():
            keys = list({**words[0], **words[1]})
            numbers = np.array([(words[0][w], words[0][w] + words[1][w]) for w in keys], dtype=np.int64).reshape(-1, 2)
            words[0].clear()
            words[1].clear()
            return batch_of(keys, None, numbers)

        def gather(known):
            codes, numbers = [known[0]], [known[1]]
            for held, parts in enumerate(pairs):
                if parts:
                    code, n = np.unique(np.concatenate(parts), return_counts=True)
                    codes.append(code)
                    numbers.append(np.stack([n * (not held), n], axis=1))
                    parts.clear()
            code, both = np.concatenate(codes), np.concatenate(numbers)
            return summed(code, both)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for text, held in zip(*[c.to_pylist() for c in part.columns]):
                    tokens = lower_words(text)
                    words[held].update(tokens)
                    words[held][b""] += 1
                    codes = pair_codes(chain(tokens, order), order)
                    pairs[held].append(codes)
                    waiting += len(codes)
                if len(words[0]) + len(words[1]) > FLUSH_WORDS:
                    yield flush_words()
                if waiting > FLUSH_SYMBOLS:
                    known, waiting = gather(known), 0
                    if len(known[0]) > FLUSH_SYMBOLS:
                        yield batch_of(None, *known)
                        known = (known[0][:0], known[1][:0])
        yield flush_words()
        yield batch_of(None, *gather(known))

    found = rows.select("text", F.col("held_out").cast("int")).mapInArrow(run, COUNTS)
    return found.groupBy("word", "code").agg(F.sum("train").alias("train"), F.sum("seen").alias("seen"))


# ---- the trie ----------------------------------------------------------------------------


def _low(code, size: int):
    """The last ``size`` bytes of a code."""
    return code.bitwiseAND(F.lit((1 << (8 * size)) - 1)) if size < 8 else code


class Trie:
    """The tables of all orders, from the counts (code, n) of the longest contexts.

    ``entries[k]``: (code, n) of contexts of k bytes with their symbol. ``contexts[k]``: (context,
    total, distinct) and, of the next shorter context without this one's symbols, (rest, novel).
    """

    def __init__(self, pairs: DataFrame, order: int):
        self.order = order
        self.entries: dict[int, DataFrame] = {order: pairs}
        self.contexts: dict[int, DataFrame] = {}
        for k in range(order - 1, -1, -1):
            shorter = self.entries[k + 1].groupBy(_low(F.col("code"), k + 1).alias("code")).agg(F.count("*").alias("n"))
            self.entries[k] = materialize(shorter, "ppm-entries")
        for k in range(order + 1):
            owner = F.shiftright("code", 8).alias("context")
            own = self.entries[k].groupBy(owner).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
            if k == 0:
                none = F.lit(None).cast("long")
                self.contexts[k] = materialize(own.withColumns({"rest": none, "novel": none}), "ppm-contexts")
                continue
            below = self.entries[k - 1].select(F.col("code").alias("low"), F.col("n").alias("low_n"))
            hidden = (
                self.entries[k].withColumn("low", _low(F.col("code"), k)).join(below, "low")
                .groupBy(owner).agg(F.sum("low_n").alias("hidden"))
            )
            parent = self.contexts[k - 1].select(
                F.col("context").alias("parent"), F.col("total").alias("p_total"), F.col("distinct").alias("p_distinct")
            )
            joined = own.join(hidden, "context").withColumn("parent", _low(F.col("context"), k - 1)).join(parent, "parent")
            self.contexts[k] = materialize(
                joined.select(
                    "context", "total", "distinct",
                    (F.col("p_total") - F.col("hidden")).alias("rest"), (F.col("p_distinct") - F.col("distinct")).alias("novel"),
                ),
                "ppm-contexts",
            )

    def score(self, pairs: DataFrame) -> DataFrame:
        """(code, logp) of distinct codes that are not among the longest entries, by escapes."""
        nothing = F.lit(None).cast("long")
        open_ = pairs.select("code", F.lit(0.0).alias("logp"), nothing.alias("rest"), nothing.alias("novel"))
        done = []
        for k in range(self.order, -1, -1):
            here = self.contexts[k].select(
                "context", F.col("total"), F.col("distinct"), F.col("rest").alias("next_rest"), F.col("novel").alias("next_novel")
            )
            known = self.entries[k].select(F.col("code").alias("entry"), "n")
            placed = open_.withColumns(
                {"context": _low(F.shiftright("code", 8), k), "entry": _low(F.col("code"), k + 1)}
            ).join(here, "context", "left").join(known, "entry", "left")
            # from a longer context that was seen, only what it has not predicted is left
            left, new = F.coalesce("rest", "total"), F.coalesce("novel", "distinct")
            escape = F.when(F.col("total").isNotNull() & (new > 0), F.log10(F.lit(DISCOUNT) * new / left)).otherwise(0.0)
            hit = F.log10((F.col("n") - F.lit(DISCOUNT)) / left)
            tried = materialize(
                placed.select(
                    "code", "n", (F.col("logp") + F.when(F.col("n").isNotNull(), hit).otherwise(escape)).alias("logp"),
                    F.when(F.col("total").isNotNull(), F.col("next_rest")).alias("rest"),
                    F.when(F.col("total").isNotNull(), F.col("next_novel")).alias("novel"),
                ),
                "ppm-escapes",
            )
            done.append(tried.where("n is not null").select("code", "logp"))
            open_ = tried.where("n is null").drop("n")
        used = self.entries[0].count()  # one row per byte value at most
        rest = open_.select("code", (F.col("logp") - math.log10(256 - used) if used < 256 else F.col("logp")).alias("logp"))
        for part in done:
            rest = rest.unionByName(part)
        return rest


def pair_scores(pairs: DataFrame, order: int) -> DataFrame:
    """(code, seen, logp) of pairs (code, train, seen): the trie's log10 probability of each."""
    trained = pairs.where("train > 0").select("code", F.col("train").alias("n"))
    trie = Trie(trained, order)
    totals = trie.contexts[order].select("context", "total")
    known = pairs.where("train > 0").withColumn("context", F.shiftright("code", 8)).join(totals, "context").select(
        "code", "seen", F.log10((F.col("train") - F.lit(DISCOUNT)) / F.col("total")).alias("logp")
    )
    others = pairs.where("train = 0").select("code", "seen")
    escaped = others.join(trie.score(others), "code").select("code", "seen", "logp")
    return known.unionByName(escaped)


# ---- documents ---------------------------------------------------------------------------


def _lines(rows: DataFrame, hot_words: dict, hot_pairs: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    """For each row of (row, text, id, held_out): one line with its tokens and what its frequent
    words and pairs give, and one (word, n) for each other word or pair."""
    shared = rows.sparkSession.sparkContext.broadcast((hot_words, *hot_pairs))
    out_schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("word", T.BinaryType()),
            *[T.StructField(c, T.LongType()) for c in ("n", "n_tokens", "n_known")],
            *[T.StructField(c, T.DoubleType()) for c in ("base", "logp")],
        ]
    )
    names = out_schema.names

    def run(batches):
        known, codes, scores = shared.value

        def rare(row, words, n):
            """Lines of words or pairs that are looked up by a join."""
            size = len(row)
            null = [pa.nulls(size, kind) for kind in (id_type, pa.bool_())]
            zero = [pa.array(np.zeros(size, np.int64))] * 2 + [pa.array(np.zeros(size))] * 2
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *null, words, pa.array(n, pa.int64()), *zero], names=names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                own, word_rows, words, word_counts = [], [], [], []
                pair_rows, pairs, pair_counts = [], [], []
                for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = lower_words(text)
                    base, n_known = 0.0, 0
                    counted = Counter(tokens)
                    counted[b""] += 1
                    for word, n in counted.items():
                        entry = known.get(word)
                        if entry is None:
                            word_rows.append(row)
                            words.append(word)
                            word_counts.append(n)
                        else:
                            base += n * entry[1]
                            n_known += n * entry[0]
                    code, n = np.unique(pair_codes(chain(tokens, order), order), return_counts=True)
                    at = np.searchsorted(codes, code)
                    at[at == len(codes)] = 0
                    hot = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                    logp = float((n[hot] * scores[at[hot]]).sum())
                    pairs.append(code[~hot])
                    pair_counts.append(n[~hot])
                    pair_rows.append(np.full(len(pairs[-1]), row))
                    # a line break is in no word and no pair; it spreads the lines
                    own.append((b"\n%d" % row, 0, len(tokens) + 1, n_known, base, logp))
                columns = [pa.array(c, type=k) for c, k in zip(zip(*own), (pa.binary(), *[pa.int64()] * 3, *[pa.float64()] * 2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *columns], names=names)
                yield rare(word_rows, pa.array(words, pa.binary()), word_counts)
                yield rare(np.concatenate(pair_rows), keys_of(np.concatenate(pairs), order), np.concatenate(pair_counts))

    return rows.select("row", "text", "id", "held_out").mapInArrow(run, out_schema)


def score(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    held_out_modulus: int = 10,
    order: int = ORDER,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The trie and the base counts learn from all documents that are not held out (crc32 of the
    id as text, modulo ``held_out_modulus``, is 0), whole. ``score`` is the trie's log10 probability
    of the text's bytes, its end included.

    Null texts count as empty: one token, the end. Null ids count as empty text in the crc.
    Repeated rows each give a row and count each. Without training rows every byte is
    equally likely. An empty table gives no rows. Further columns are ignored.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    rows = pick(documents, id_column, text_column).toDF("id", "text")
    rows = rows.withColumn("held_out", crc_remainder(F.col("id"), held_out_modulus) == 0)
    counted = materialize(counts(rows, order), "ppm-counts")
    words = counted.where("word is not null")
    tokens, distinct, seen = words.agg(
        F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.coalesce(F.sum("seen"), F.lit(0))
    ).first()
    smooth = F.log10((F.col("train") + F.lit(0.1)) / F.lit(tokens + 0.1 * (distinct + 1)))
    word_scores = words.select("word", (F.col("train") > 0).alias("known"), smooth.alias("base"), "seen")
    scored = materialize(pair_scores(counted.where("code is not null").select("code", "train", "seen"), order), "ppm-scores")
    symbols = scored.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    # both are bounded by their share of all occurrences
    hot = word_scores.where(F.col("seen") >= HOT_WORDS * seen).select("word", "known", "base").toArrow()
    hot_words = {w: (k, b) for w, k, b in zip(*[c.to_pylist() for c in hot.columns])}
    frequent = scored.where(F.col("seen") >= HOT_PAIRS * symbols).select("code", "logp").toArrow()
    codes, logs = frequent.column("code").to_numpy(), frequent.column("logp").to_numpy()
    by_code = np.argsort(codes)
    lines = _lines(rows.withColumn("row", F.monotonically_increasing_id()), hot_words, (codes[by_code], logs[by_code]), order)

    def run(batches):
        for batch in batches:
            keys = keys_of(batch.column(0).to_numpy(), order)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.zeros(n, bool)), pa.array(np.zeros(n)), batch.column(1)], names=["word", "c", "w_base", "w_logp"]
            )

    rare = scored.where(F.col("seen") < HOT_PAIRS * symbols).select("code", "logp")
    found = word_scores.where(F.col("seen") < HOT_WORDS * seen).select(
        "word", F.col("known").alias("c"), F.col("base").alias("w_base"), F.lit(0.0).alias("w_logp")
    ).unionByName(rare.mapInArrow(run, "word binary, c boolean, w_base double, w_logp double"))
    joined = lines.join(found.hint("shuffle_hash"), "word", "left")
    count = F.col("n")
    sums = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c"), count).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(count * F.col("w_base"), F.lit(0.0))).alias("base_score"),
        F.sum(F.col("logp") + F.coalesce(count * F.col("w_logp"), F.lit(0.0))).alias("score"),
    )
    return sums.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
