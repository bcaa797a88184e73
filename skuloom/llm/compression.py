"""Quality rules from zstandard ratios of whole documents and fixed chunks."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, flat, pick


@dataclasses.dataclass(frozen=True)
class Band:
    """Texts of at least ``from_bytes`` bytes (up to the next band) pass with a ratio of
    plain to compressed size in [least, most]."""

    from_bytes: int
    least: float
    most: float


# Short texts compress badly whatever they say, long ones better, so limits follow length.
# Natural prose lies near 0.9 (under 128 bytes), 1.7 (500), 2.1 (3 KB), 2.5 (over 16 KB).
WHOLE_BANDS = (
    Band(0, 0.0, float("inf")),
    Band(128, 0.8, 2.8),
    Band(512, 1.15, 3.2),
    Band(2048, 1.3, 3.6),
    Band(16384, 1.4, 4.2),
)
CHUNK_BYTES = 2048
CHUNK_BAND = Band(CHUNK_BYTES // 2, 1.3, 5.0)
# share of chunks outside the band from which a document fails
CHUNK_SHARE = 0.25
LEVEL = 3

SCHEMA = T.StructType(
    [
        *[
            T.StructField(n, T.LongType())
            for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("zstd_ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
        T.StructField("verdict", T.StringType()),
    ]
)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` (a power of two) words that occur twice or more.

    Windows get exact numbers by doubling: a window of 2k words is a pair of windows of k.
    """
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    distinct, step = len(known), 1
    while step < width:
        codes = ids[:-step] * distinct + ids[step:]
        values, ids = np.unique(codes, return_inverse=True)
        distinct, step = len(values), step * 2
        if distinct == len(ids):
            return 0
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                found += 1
            else:
                seen.add(line)
    return found


def band_verdict(size: int, ratio: float, bands: tuple[Band, ...]) -> str | None:
    """What is wrong with the ratio of a text of ``size`` bytes: repetitive, incompressible or None."""
    band = [b for b in bands if size >= b.from_bytes][-1]
    if ratio > band.most:
        return "repetitive"
    return "incompressible" if ratio < band.least else None


def _judge(whole_bands: tuple[Band, ...], chunk_bytes: int, chunk_band: Band, chunk_share: float, level: int):
    def make():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)

        def one(text: str | None) -> tuple:
            text = text or ""
            raw = text.encode("utf-8")
            words = raw.split()
            chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
            symbols = sum(text.count(c) for c in "#*$%&|<>")
            repeat = repeated_words(words)
            failed = len(words) < 20 or 100 * repeat > 30 * len(words)
            ratio = len(raw) / len(compressor.compress(raw)) if raw else None
            why = band_verdict(len(raw), ratio, whole_bands) if raw else "empty"
            chunks = bad = 0
            for at in range(0, len(raw), chunk_bytes):
                piece = raw[at : at + chunk_bytes]
                if len(piece) >= chunk_band.from_bytes:
                    chunks += 1
                    bad += band_verdict(len(piece), len(piece) / len(compressor.compress(piece)), (chunk_band,)) is not None
            if why is None and chunks and bad >= chunk_share * chunks:
                why = "chunks"
            why = "base" if failed else why
            return (len(words), chars, symbols, duplicate_lines(text), repeat, failed, why is None, ratio, chunks, bad, why)

        names = SCHEMA.names
        return lambda texts: dict(zip(names, zip(*map(one, texts)))) if texts else {n: [] for n in names}

    return make


def rate(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    whole_bands: tuple[Band, ...] = WHOLE_BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_band: Band = CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
    level: int = LEVEL,
) -> DataFrame:
    """One row per document: plain counts and the verdict of the compression bands.

    A document is kept when it passes the base rule (20 words at least, at most 30 percent of
    them in repeated 8-word windows), its whole ratio lies in the band of its length, and less
    than ``chunk_share`` of its chunks (of at least half a chunk) lie outside ``chunk_band``.
    ``verdict`` says why not: base, repetitive, incompressible, chunks.

    Null and empty texts have no words and fail the base rule; ratios are null. Null ids and
    repeated rows each give their own row. Any length works: lines and windows are counted in
    memory linear in the text. Other columns are ignored.
    """
    rows = pick(documents, id_column, text_column).withColumnRenamed(text_column, "_text_")
    judged = append_result(
        rows, ["_text_"], _judge(whole_bands, chunk_bytes, chunk_band, chunk_share, level), SCHEMA, "_result_"
    )
    return flat(judged.drop("_text_"), "_result_")


def reject(documents: DataFrame, **options) -> DataFrame:
    """``rate`` reduced to the documents that fail."""
    return rate(documents, **options).where(~F.col("kept"))
