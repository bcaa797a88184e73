"""Token totals by source, language and tokenizer version, kept by signed deltas.

A change carries +1 (a document's count appears) or -1 (it goes); a revision is the old count
with -1 and the new one with +1. A batch is summed to one delta per key. Totals are maintained: a
folder holds the sums of all batches up to some point, a small record tells which deltas are in it,
and a read adds the few that came, or were replaced, since. The record is replaced atomically, so a
batch counts as a whole or not at all, also when it is committed again.
"""

from __future__ import annotations

import base64
import copy
import functools
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, free_name, pick, position_of, positions
from skuloom.sources import versions

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
# deltas outside of the totals before they are folded in, and how long replaced folders are kept
FOLD_AFTER = 16
KEEP_SECONDS = 24 * 3600
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# split pattern that goes with the vocabulary file (a fixed value)
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def bpe(path: str):
    """The byte-level BPE encoding of a rank file, loaded once in a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(path, pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, text_column: str, result: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """``documents`` with the token count of the text as the column ``result`` (null: 0), which gets
    underscores after its name if there is such a column. Rows are counted whole and each for itself;
    an empty table stays empty."""

    def make():
        encoding = bpe(path)

        return lambda texts: {"n": [len(encoding.encode_ordinary(t or "")) for t in texts]}

    schema = T.StructType([T.StructField("n", T.LongType())])
    plain = positions(documents)
    counted = append_result(plain, [f"c{position_of(documents, text_column)}"], make, schema, "_count_")
    return counted.select(*plain.columns, "_count_.n").toDF(*documents.columns, free_name(documents, result))


def changes(rows: DataFrame, sign: int, tokenizer: Column, n_tokens: Column) -> DataFrame:
    """Change records of rows (source, lang) with one sign."""
    return rows.select("source", "lang", tokenizer.alias("tokenizer"), F.lit(sign).alias("sign"), n_tokens.alias("n_tokens"))


# -- the record --------------------------------------------------------------------------
#
# {"deltas": {batch id: folder}, "totals": folder or null,
#  "included": {batch id: the delta folder that the totals hold}, "gone": [[folder, when], ..]}
# Some sixty bytes for each batch.


def _versions(root: str) -> str:
    return f"{root}/_versions"


def _record(spark: SparkSession, root: str) -> dict:
    return versions.latest(spark, _versions(root))[1] or {"deltas": {}, "totals": None, "included": {}, "gone": []}


def _read(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(*[f"{root}/{f}" for f in folders])


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")
    )


def commit(spark: SparkSession, root: str, batch_id: int, batch: DataFrame) -> None:
    """Take the changes (source, lang, tokenizer, sign, n_tokens) of a batch into the totals.

    Counts are summed before the shuffle, so a source with most of the rows is no burden. Committing
    an id again replaces its earlier changes in one step; what an interrupted commit wrote is never
    read, and what was committed before stays until the new delta is complete.

    Null keys are keys of their own; null signs and null counts are taken as 0. An empty batch
    commits nothing but its id. Repeated rows count each; further columns are ignored.
    """
    rows = pick(batch, "source", "lang", "tokenizer", "sign", "n_tokens")
    sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
    each = rows.select(*KEYS, sign.alias("n_docs"), (sign * F.coalesce(F.col("n_tokens"), F.lit(0))).cast("long").alias("n_tokens"))
    folder = f"deltas/{int(batch_id)}-{uuid.uuid4().hex}"
    _summed(each).write.parquet(f"{root}/{folder}")

    def change(record: dict | None) -> dict:
        new = copy.deepcopy(record or _record(spark, root))
        old = new["deltas"].get(str(int(batch_id)))
        if old is not None and old != new["included"].get(str(int(batch_id))):
            new["gone"].append([old, time.time()])
        new["deltas"][str(int(batch_id))] = folder
        return new

    record = versions.update(spark, _versions(root), change)
    if len(_open(record)[0]) > FOLD_AFTER:
        fold(spark, root)


def _open(record: dict) -> tuple[list[str], list[str]]:
    """Delta folders that the totals lack, and those in them that were replaced since."""
    included, deltas = record["included"], record["deltas"]
    added = [folder for i, folder in deltas.items() if included.get(i) != folder]
    return added, [folder for i, folder in included.items() if deltas[i] != folder]


def _current(spark: SparkSession, root: str, record: dict) -> DataFrame:
    added, removed = _open(record)
    base = _read(spark, root, [record["totals"]] if record["totals"] else [])
    minus = _read(spark, root, removed).select(*KEYS, *[(-F.col(c)).alias(c) for c in ("n_docs", "n_tokens")])
    rows = base.unionByName(_read(spark, root, added)).unionByName(minus)
    return _summed(rows).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def fold(spark: SparkSession, root: str) -> bool:
    """Write new totals with all committed deltas in them; True unless another one was faster."""
    seen = _record(spark, root)
    folder = f"totals/{uuid.uuid4().hex}"
    _current(spark, root, seen).write.parquet(f"{root}/{folder}")
    limit, done, old = time.time() - KEEP_SECONDS, [], []

    def change(record: dict | None) -> dict | None:
        done[:], old[:] = [], []
        if record is None or (record["totals"], record["included"]) != (seen["totals"], seen["included"]):
            return None
        new = copy.deepcopy(record)
        replaced = [f for i, f in record["included"].items() if seen["deltas"][i] != f]
        new["gone"] += [[f, time.time()] for f in [*replaced, *([seen["totals"]] if seen["totals"] else [])]]
        old[:] = [f for f, when in new["gone"] if when < limit]
        new["gone"] = [g for g in new["gone"] if g[1] >= limit]
        new["totals"], new["included"] = folder, dict(seen["deltas"])
        done.append(True)
        return new

    versions.update(spark, _versions(root), change)
    for path in old if done else [folder]:
        versions.delete(spark, f"{root}/{path}")
    return bool(done)


def deltas(spark: SparkSession, root: str) -> DataFrame:
    """All committed deltas, one row per key and batch; none if nothing was committed."""
    return _read(spark, root, list(_record(spark, root)["deltas"].values()))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; keys without
    documents are left out. Reads the maintained totals and the deltas that are not in them yet.
    Without a committed batch there are no rows."""
    return _current(spark, root, _record(spark, root))
