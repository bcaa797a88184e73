"""Quality scores from hashed word n-grams by logistic regression, trained with
follow-the-regularised-leader updates; a score is a sparse dot product."""

from __future__ import annotations

import dataclasses
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, crc_remainder, flat, pick

BUCKETS = 1 << 18
# Labelled documents that train the model: those with the smallest hash of the id.
TRAIN_ROWS = 16_384
# words hashed at once; long texts are summed in pieces
PIECE_WORDS = 200_000
CACHE_WORDS = 200_000
EMPTY_FEATURE = 0

_PART = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff]+")
_RUN = re.compile(rb"(.)\1+")


def _shape(word: bytes) -> bytes:
    """Case, digits and signs of a word: X upper, x lower, Xx capitalised, 9 digits, signs as they are."""
    out = []
    for part in _PART.findall(word):
        if part[:1].isdigit():
            out.append(b"9")
        elif part[:1].isalpha() or part[0] >= 128:
            letters = part.decode("utf-8", "replace")
            if letters.islower():
                out.append(b"x")
            elif letters.isupper() and len(letters) > 1:
                out.append(b"X")
            else:
                out.append(b"Xx")
        else:
            out.append(_RUN.sub(rb"\1+", part[:8]))
    return b"".join(out)


class Hasher:
    """Hashed uni- and bigrams of the words and of their shapes; a word that repeats the one
    before counts as a gram of its own."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known: dict[bytes, tuple[int, int]] = {}

    def _codes(self, word: bytes) -> tuple[int, int]:
        codes = self.known.get(word)
        if codes is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            codes = self.known[word] = (zlib.crc32(word.lower()), zlib.crc32(b"\x00" + _shape(word)))
        return codes

    def grams(self, words: list[bytes], before: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of a piece of text; ``before`` is the last word of the piece before it."""
        carried = [] if before is None else [before]
        codes = np.array([self._codes(w) for w in [*carried, *words]], dtype=np.uint64)
        lower, shape = codes[:, 0], codes[:, 1]
        own = len(carried)
        kinds = [np.full(1, k, dtype=np.uint64) for k in range(6)]
        mix = lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        same = np.flatnonzero(lower[1:] == lower[:-1])
        found = [
            mix(lower[own:], kinds[1]),
            mix(shape[own:], kinds[2]),
            mix(mix(lower[:-1], lower[1:]), kinds[3]),
            mix(mix(shape[:-1], shape[1:]), kinds[4]),
            mix(np.zeros(len(same), dtype=np.uint64), kinds[5]),
        ]
        index = (np.concatenate(found) >> np.uint64(29)) % np.uint64(self.buckets - 1) + np.uint64(1)
        return np.unique(index.astype(np.int64), return_counts=True)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values (square roots of counts, scaled to length 1) of a text."""
        words = [] if text is None else text.encode("utf-8").split()
        if not words:
            return np.array([EMPTY_FEATURE]), np.ones(1)
        if len(words) <= PIECE_WORDS:
            index, count = self.grams(words)
        else:
            sums = np.zeros(self.buckets)
            for start in range(0, len(words), PIECE_WORDS):
                at, n = self.grams(words[start : start + PIECE_WORDS], words[start - 1] if start else None)
                sums[at] += n
            index = np.flatnonzero(sums)
            count = sums[index]
        value = np.sqrt(count)
        return index, value / np.sqrt((value * value).sum())


@dataclasses.dataclass
class Leader:
    """Per-coordinate follow-the-regularised-leader state."""

    buckets: int = BUCKETS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5

    def __post_init__(self):
        self.z = np.zeros(self.buckets + 1)  # the last is the intercept
        self.n = np.zeros(self.buckets + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        free = np.abs(z) > self.l1
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(free, w, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        index = np.append(index, self.buckets)
        value = np.append(value, 1.0)
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip((w * value).sum(), -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g


def fit(texts: list[str | None], labels: list[float], buckets: int = BUCKETS, epochs: int = 4) -> np.ndarray:
    """Weights (float32; the intercept last) learnt from the texts in their order."""
    hasher, leader = Hasher(buckets), Leader(buckets)
    rows = [(*hasher.features(t), y) for t, y in zip(texts, labels)]
    for _ in range(epochs):
        for index, value, label in rows:
            leader.learn(index, value, label)
    return leader.weights(np.arange(buckets + 1)).astype(np.float32)


def train(
    documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS, epochs: int = 4
) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents (id, text) with labels (id, label).

    Labels of one id are averaged and rounded; null labels and ids are left out, and of
    documents that share an id the greatest text is used. The fit runs in one task, over a
    bounded number of rows; the weights have a fixed size.
    """
    wanted = (
        labels.where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id")
        .agg(F.round(F.avg("label")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    found = documents.join(F.broadcast(wanted), "id").groupBy("id", "label").agg(F.max("text").alias("text"))

    def run(batches):
        texts, values, keys = [], [], []
        for batch in batches:
            for key, label, text in zip(*[c.to_pylist() for c in batch.columns]):
                keys.append(zlib.crc32(b"order" + str(key).encode()))
                values.append(float(label))
                texts.append(text)
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] or ""))
        weights = fit([texts[i] for i in order], [values[i] for i in order], buckets, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], type=pa.binary())], names=["weights"])

    one = found.select("id", "label", "text").coalesce(1).mapInArrow(run, "weights binary").first()
    return np.zeros(buckets + 1, dtype=np.float32) if one is None else np.frombuffer(one[0], dtype=np.float32)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_id_column: str = "doc_id",
    label_column: str = "quality",
    held_out_modulus: int = 4,
    held_out_remainder: int = 2,
    threshold: float = 0.7,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (score >= threshold).

    Labels of held-out documents (crc32 of the id as text has that remainder) are never read.
    Only the text enters a score. Null and empty texts have one feature of their own. Null ids
    are scored but teach nothing; repeated rows are each scored. Without labels every score is
    0.5. Texts of any length are hashed in pieces. Further columns are ignored.
    """
    rows = pick(documents, id_column, text_column).toDF("id", "text")
    known = pick(labels, label_id_column, label_column).toDF("id", "label")
    known = known.where(crc_remainder(F.col("id"), held_out_modulus) != held_out_remainder)
    weights = train(rows, known, train_rows)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def make():
        own, hasher = shared.value, Hasher(len(shared.value) - 1)

        def one(text):
            index, value = hasher.features(text)
            z = float((own[index] * value).sum() + own[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            return float(p), int(p >= threshold)

        names = SCORED.names
        return lambda texts: dict(zip(names, zip(*map(one, texts)))) if texts else {n: [] for n in names}

    held = crc_remainder(F.col("id"), held_out_modulus) == held_out_remainder
    found = append_result(rows.withColumn("held_out", held), ["text"], make, SCORED, "result").drop("text")
    return flat(found, "result").withColumnRenamed("id", id_column)
