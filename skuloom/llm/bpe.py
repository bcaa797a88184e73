"""Byte-level byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece (a match of the split pattern) exactly one token can be the last one
of the prefix's encoding. The encoding of a piece is the list of these *last tokens*, one per
byte: position i takes the token t that ends there and is compatible with the last token of the
prefix before t. Two neighbours are compatible if no merge across their border comes before the
merges that made them. Tokens are read off from the end.

Last tokens depend on earlier bytes only, so text can be appended without encoding again what
stands before, and after an edit the old values hold again as soon as as many of them in a row
as the longest token has bytes are what they were.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skuloom.llm.common import SLICE_ROWS, free_name, pick, position_of, positions

# split pattern that goes with the vocabulary files (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Deciding a match looks at most one character behind its end and two behind its start.
PAST_END, PAST_START = 1, 3
# pieces a process remembers, and how long they may be; both bound memory only
KNOWN_PIECES, KNOWN_LENGTH = 300_000, 48
KNOWN_PAIRS = 1_000_000
# a token and its number of bytes in one number
_SIZE_BITS = 12
_SIZES = (1 << _SIZE_BITS) - 1


@functools.lru_cache(maxsize=1)
def newer_characters() -> str:
    """Letters and numbers to the pattern engine used here that tiktoken's engine, of another
    Unicode version, does not count as such: ranges for a character class.

    They are asked for with a vocabulary that joins "a" or "1" and the next byte: it shows
    whether a character is in the piece of the letter or digit before it.
    """
    import regex
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for before in b"a1":
        for b in range(256):
            ranks[bytes([before, b])] = len(ranks)
    asked = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    found = []
    for before, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        for c in regex.findall(kind, every):
            # what an older Unicode has is in both
            if unicodedata.category(c) == "Cn" and asked.encode_ordinary(before + c)[0] < 256:
                found.append(ord(c))
    ranges: list[list[int]] = []
    for c in sorted(found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def narrow_pattern() -> re.Pattern:
    """The split pattern for characters up to U+00FF, its classes written out."""
    import regex

    pattern = PATTERN.replace(r"\S", r"[^\s]").replace(r"|\s+", r"|[\s]+")
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        members = "".join(rf"\x{c:02x}" for c in range(256) if regex.match(kind, chr(c)))
        bare = rf"(?<!\[\^){re.escape(kind)}\+"  # outside of a class
        pattern = re.sub(bare, lambda _, m=members: f"[{m}]+", pattern) if kind != r"\s" else pattern
        pattern = pattern.replace(kind, members)
    return re.compile(pattern)


class Vocabulary:
    """Tokens (bytes) with their ranks, and how each is merged from two others.

    A merge of lower rank comes first, of equal ones the leftmost. All 256 bytes must be tokens.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        if self.longest > _SIZES:
            raise ValueError(f"tokens may have {_SIZES} bytes at most")
        newer = newer_characters()
        older = PATTERN.replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]")
        self.exact = regex.compile(older if newer else PATTERN, regex.V1)
        # the same for texts without newer characters, and without any beyond U+00FF
        self.plain, self.newer = regex.compile(PATTERN), re.compile(f"[{newer}]" if newer else "(?!)")
        self.narrow, self.wide = narrow_pattern(), re.compile("[^\x00-\xff]")
        # by token: when it was made (bytes: before everything) and from what
        self.made = {rank: -1 if size == 1 else rank for rank, size in self.sizes.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.pairs: dict[int, bool] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) > 1:
                parts = self._parts_of(token, rank)
                if parts is None:  # no merges lead to it: it only stands for a whole piece
                    continue
                self.parts[rank] = parts
                self.merged[parts] = rank
            self.ends.add_word(token.decode("latin-1"), rank << _SIZE_BITS | len(token))
        self.ends.make_automaton()
        self.known: dict[str, array] = {}
        self.older: dict[str, array] = {}

    def _parts_of(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens of lower rank that merges leave of ``token`` before the last one."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is None or right is None or self.made[left] >= rank or self.made[right] >= rank:
                continue
            whole = all(self.sizes[t] == 1 or t in self.parts for t in (left, right))
            if whole and self._border_holds(left, right):
                return left, right
        return None

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the merges along the border, the last one first, and look at each pair that met
        there: had it a merge that was due earlier, the border would not be there."""
        merged, made, parts = self.merged, self.made, self.parts
        merge = merged.get((left, right))
        if merge is not None:
            return False
        made_left, made_right = made[left], made[right]
        while True:
            if made_left > made_right:
                due = left  # on a tie, the pair further left went first
                left = parts[left][1]
                made_left = made[left]
            elif made_right >= 0:
                due = right + 1  # on a tie, the pair across the border would have gone first
                right = parts[right][0]
                made_right = made[right]
            else:
                return True
            merge = merged.get((left, right))
            if merge is not None and merge < due:
                return False

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = self._border_holds(left, right)
        return found

    def splitter(self, text: str):
        """The fastest compiled pattern that is right for a text."""
        if self.wide.search(text) is None:
            return self.narrow
        return self.exact if self.newer.search(text) else self.plain

    def last_tokens(self, data: bytes) -> array:
        """Last token of every prefix of the piece ``data``."""
        # the loop that most of the time goes to: no calls where a pair is known
        last, done, pairs = [], 0, self.pairs
        for at, found in self.ends.iter(data.decode("latin-1")):
            if at < done:
                continue
            token, before = found >> _SIZE_BITS, at - (found & _SIZES)
            fits = True
            if before >= 0:
                fits = pairs.get(last[before] << 32 | token)
                if fits is None:
                    fits = self.compatible(last[before], token)
            if fits:
                last.append(token)
                done += 1
        return array("i", last)

    def extend(self, last: array, data: bytes) -> Iterator[int]:
        """Append the last tokens that are missing, yielding each position as it is done."""
        base = max(0, len(last) - self.longest + 1)
        compatible = self.compatible
        for at, found in self.ends.iter(data[base:].decode("latin-1")):
            at += base
            if at < len(last):
                continue
            token, before = found >> _SIZE_BITS, at + 1 - (found & _SIZES)
            if before == 0 or compatible(last[before - 1], token):
                last.append(token)
                yield at

    def read_off(self, data: bytes, last: array) -> array:
        """The tokens of a piece from its last tokens."""
        if data in self.ranks:
            return array("i", (self.ranks[data],))
        out, at = array("i"), len(last)
        while at:
            out.append(last[at - 1])
            at -= self.sizes[last[at - 1]]
        out.reverse()
        return out

    def piece(self, piece: str) -> array:
        """The tokens of a piece that is not among the latest ones."""
        tokens = self.older.get(piece)
        if tokens is None:
            data = piece.encode("utf-8")
            tokens = self.read_off(data, self.last_tokens(data))
        if len(piece) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_PIECES:
                # two generations: what is still used moves to the new one
                self.older = dict(self.known)
                self.known.clear()
            self.known[piece] = tokens
        return tokens

    def encode(self, text: str) -> array:
        out, known = array("i"), self.known
        for piece in self.splitter(text).findall(text):
            out += known.get(piece) or self.piece(piece)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    @functools.cached_property
    def by_rank(self) -> pa.Array:
        return pa.array([self.tokens.get(r) for r in range(max(self.tokens) + 1)], pa.binary())

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        try:
            found = self.by_rank.take(lists.flatten())
        except pa.ArrowIndexError as error:
            raise KeyError("an id is not in the vocabulary") from error
        if found.null_count:
            raise KeyError("an id is null or not in the vocabulary")
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int32)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), found), b"")
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file (lines of base64 token and rank), loaded once in a process.

    The path must lead to the same file on every executor.
    """
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


# ---- texts that change -------------------------------------------------------------------


def prefixes(words: Vocabulary, text: str) -> tuple[array, list[int]]:
    """(last token of every byte's prefix within its piece, byte offsets where pieces end)."""
    last, ends = array("i"), []
    for piece in words.splitter(text).findall(text):
        last += words.last_tokens(piece.encode("utf-8"))
        ends.append(len(last))
    return last, ends


def tokens_of(words: Vocabulary, text: str, last: array, ends: list[int]) -> array:
    data, out, start = text.encode("utf-8"), array("i"), 0
    for end in ends:
        out += words.read_off(data[start:end], last[start:end])
        start = end
    return out


def replace(
    words: Vocabulary, text: str, last: array, ends: list[int], start: int, end: int, new: str
) -> tuple[str, array, list[int], int]:
    """``text`` with the code points from ``start`` to ``end`` replaced by ``new``: the text, its
    last tokens and piece ends as ``prefixes`` gives them, and the number of last tokens that had
    to be computed. Bounds outside the text are moved to its ends; an empty range inserts.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    result = text[:start] + new + text[end:]
    old = text.encode("utf-8")
    edit = len(text[:start].encode("utf-8"))
    old_resume = edit + len(text[start:end].encode("utf-8"))
    resume = edit + len(new.encode("utf-8"))  # from here on the new bytes are old ones
    shift = resume - old_resume
    starts = [0, *ends[:-1]] if ends else []
    # pieces whose match cannot have seen the edit; a character has four bytes at most
    kept = 0
    while kept < len(ends) and max(ends[kept] + 4 * PAST_END, starts[kept] + 4 * PAST_START) <= edit:
        kept += 1
    at = ends[kept - 1] if kept else 0
    out, out_ends, computed = last[:at], list(ends[:kept]), 0
    old_starts = {s: i for i, s in enumerate(starts)}
    for match in words.exact.finditer(result, len(old[:at].decode("utf-8"))):
        if at >= resume and at - shift in old_starts:
            # from the same place on, the same text has the same pieces
            out += last[at - shift :]
            out_ends += [e + shift for e in ends[old_starts[at - shift] :]]
            break
        data = match[0].encode("utf-8")
        same = 0
        if at in old_starts:
            same = min(edit, at + len(data), ends[old_starts[at]]) - at
        own = array("i", last[at : at + max(same, 0)])
        steady = 0
        for i in words.extend(own, data):
            computed += 1
            was = at + i - shift
            held = at + i >= resume and 0 <= was < len(last) and last[was] == own[i]
            steady = steady + 1 if held else 0
            if steady >= words.longest and i + 1 < len(data):
                piece = int(np.searchsorted(ends, was, side="right"))
                if starts[piece] <= was + 1 - steady and ends[piece] + shift == at + len(data):
                    own += last[was + 1 : ends[piece]]
                    break
        out += own
        at += len(data)
        out_ends.append(at)
    return result, out, out_ends, computed


# ---- Spark -------------------------------------------------------------------------------

STATE = T.StructType(
    [
        T.StructField("last_tokens", T.ArrayType(T.IntegerType())),
        T.StructField("piece_ends", T.ArrayType(T.IntegerType())),
    ]
)


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    """Lists of integers as one array, without an object per number."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate([np.asarray(v, dtype=np.int32) for v in values] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind.value_type))


def _with_column(df: DataFrame, given: str, result: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with the column ``result``: ``make()`` gives a function from the values of ``given``
    (a slice of rows) to an Arrow array. The other columns do not go through Python's objects."""
    plain = positions(df)
    at = position_of(df, given)
    out = T.StructType([*plain.schema.fields, T.StructField("result", kind)])
    names = [*plain.columns, "result"]

    def run(batches):
        function = make()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, function(part.column(at))], names=names
                )

    return plain.mapInArrow(run, out).toDF(*df.columns, free_name(df, result))


def encode(documents: DataFrame, path: str, text_column: str = "text", result: str = "tokens") -> DataFrame:
    """``documents`` with the token ids of the whole text as the array ``result`` (with underscores
    after the name if there is such a column).

    Special tokens are ordinary text. A null or empty text has no tokens (an empty array);
    repeated rows each get theirs; other columns stay, also with names that differ in case
    only. An empty table stays empty.
    """
    kind = pa.list_(pa.int32())

    def make():
        words = vocabulary(path)
        return lambda column: _lists([words.encode(t) if t else () for t in column.to_pylist()], kind)

    return _with_column(documents, text_column, result, T.ArrayType(T.IntegerType(), False), make)


def decode(encoded: DataFrame, path: str, ids_column: str = "tokens", result: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its token ids as ``result`` (null ids: null). Ids that the
    vocabulary lacks, and null elements, end the job with a KeyError."""

    def make():
        return vocabulary(path).decode_lists

    return _with_column(encoded, ids_column, result, T.BinaryType(), make)


def digests(tokens: Column, decoded: Column) -> list[Column]:
    """n_tokens and the hashes of the decimal ids and of the decoded bytes."""
    joined = F.array_join(tokens.cast("array<string>"), " ")
    return [
        F.size(tokens).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]


def encode_prefixes(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, last_tokens, piece_ends): a store of encodings that ``replace_in`` can change.

    Four bytes per byte of text, and as much for each piece. Null texts count as empty;
    repeated rows and null ids stay rows of their own; further columns are left out.
    """
    rows = pick(documents, id_column, text_column).toDF("id", "text")
    out = T.StructType([*rows.schema.fields, *STATE.fields])
    schema = to_arrow_schema(out)

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                last, ends = zip(*[prefixes(words, t) for t in texts])
                state = [_lists(list(v), pa.list_(pa.int32())) for v in (last, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts), *state], names=schema.names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_column)


def replace_in(store: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The store after edits (same id column, ``start``, ``end`` in code points, ``replacement``).

    An addition at the end is an edit that starts and ends at or beyond the text's length; null
    bounds mean the end, a null replacement deletes. One edit per id: several of one id are an
    error of the caller, and give one row each. Rows without an edit are not sent to Python;
    edits without a row do nothing. A null id has no edits.
    """
    key = store.columns[0]
    far = F.lit(2**31 - 1)
    asked = pick(edits, key, "start", "end", "replacement").toDF(
        "edit_id", "edit_start", "edit_end", "edit_new"
    ).withColumns(
        {
            "edit_start": F.coalesce(F.col("edit_start").cast("int"), far),
            "edit_end": F.coalesce(F.col("edit_end").cast("int"), far),
            "edit_new": F.coalesce("edit_new", F.lit("")),
        }
    )
    joined = store.join(asked, F.col(key) == F.col("edit_id"), "left")
    columns = [key, "text", "last_tokens", "piece_ends"]
    schema = to_arrow_schema(store.select(*columns).schema)

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                given = [c.to_pylist() for c in part.columns[1:]]
                made = [
                    replace(words, text, array("i", last), ends, start, end, new)
                    for text, last, ends, start, end, new in zip(*given)
                ]
                state = [_lists([m[i] for m in made], pa.list_(pa.int32())) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([m[0] for m in made]), *state], names=schema.names
                )

    edited = joined.where("edit_id is not null").select(*columns, "edit_start", "edit_end", "edit_new")
    changed = edited.mapInArrow(run, store.select(*columns).schema)
    return joined.where("edit_id is null").select(*columns).unionByName(changed)


def tokens_from(store: DataFrame, path: str, result: str = "tokens") -> DataFrame:
    """(id, text, tokens) of a store: the tokens are read off from the last tokens."""
    kept = store.select(store.columns[0], "text", "last_tokens", "piece_ends")
    out = T.StructType([*kept.schema.fields[:2], T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                given = zip(*[c.to_pylist() for c in part.columns[1:]])
                found = [tokens_of(words, text, array("i", last), ends) for text, last, ends in given]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], _lists(found, pa.list_(pa.int32()))], names=out.names
                )

    return kept.mapInArrow(run, out).withColumnRenamed("tokens", result)
