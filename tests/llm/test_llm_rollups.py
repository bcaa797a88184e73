import random
import re

import llm_samples as samples
import pytest
from pyspark.sql import functions as F
from skuloom.llm import queries, token_rollups
from skuloom.session import scratch_path

CHANGE = "source string, lang string, tokenizer string, sign int, n_tokens long, extra string"


def totals(spark, root):
    return {tuple(r)[:3]: tuple(r)[3:] for r in token_rollups.totals(spark, root).collect()}


@pytest.mark.parametrize("fold_after", [16, 1, 0])
def test_batches_add_up_and_replays_change_nothing(spark, monkeypatch, fold_after):
    monkeypatch.setattr(token_rollups, "FOLD_AFTER", fold_after)
    rng = random.Random(1)
    root = scratch_path(spark, "rollup-test")
    assert totals(spark, root) == {}
    live, want, log = {}, {}, []
    for batch_id in range(6):
        records = []

        def add(key, sign, n):
            records.append((*key, sign, n, "x"))
            docs, tokens = want.get(key, (0, 0))
            want[key] = (docs + sign, tokens + sign * n)

        for i in range(60):
            doc = rng.randrange(100)
            key = (rng.choice(["a", "b", None]), rng.choice(["en", None]), "t1")
            if doc in live:
                add(*[(k, -1, n) for k, n in [live.pop(doc)]][0])
            if rng.random() < 0.7:
                live[doc] = (key, rng.randrange(1000))
                add(live[doc][0], 1, live[doc][1])
        log.append(records)
        token_rollups.commit(spark, root, batch_id, spark.createDataFrame(records, CHANGE))
        if batch_id % 2:
            again = rng.randrange(batch_id + 1)
            token_rollups.commit(spark, root, again, spark.createDataFrame(log[again], CHANGE))
        assert totals(spark, root) == {k: v for k, v in want.items() if v != (0, 0)}


def test_unfinished_batches_are_not_read(spark):
    root = scratch_path(spark, "rollup-test")
    token_rollups.commit(spark, root, 1, spark.createDataFrame([("a", "en", "t", 1, 5, "")], CHANGE))
    before = totals(spark, root)
    spark.createDataFrame([("a", "en", "t", 1, 7)], "source string, lang string, tokenizer string, n_docs long, n_tokens long") \
        .write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/batch_id=2")
    assert totals(spark, root) == before
    token_rollups.commit(spark, root, 3, spark.createDataFrame([], CHANGE))
    token_rollups.commit(spark, root, 4, spark.createDataFrame([(None, None, None, None, None, "")], CHANGE))
    assert totals(spark, root) == before


def test_token_counts(spark):
    counted = token_rollups.count_tokens(samples.hostile(spark), "text", "n")
    encoding = token_rollups.bpe(token_rollups.TOKENIZER_FILE)
    for text, n in [(r[1], r[-1]) for r in counted.collect()]:
        assert n == len(encoding.encode_ordinary(text or ""))
        assert encoding.decode(encoding.encode_ordinary(text or "")) == (text or "")
    assert token_rollups.count_tokens(samples.empty(spark), "text", "n").collect() == []


def test_query_equals_a_recount(spark, sf_dir):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op9(spark, sf_dir).collect()}
    encoding = token_rollups.bpe(token_rollups.TOKENIZER_FILE)
    want = {}
    docs = queries.table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    for r in docs.collect():
        text = r["text"] or ""
        if r["doc_id"] % 2 == 0:
            text = re.sub(r"^[ \t-\r]*[^ \t-\r]+", "", text)
        for name, n in (("bpe-50k/1", len(encoding.encode_ordinary(text))), ("words/1", len(text.encode().split()))):
            docs_, tokens = want.get((r["source"], r["lang"], name), (0, 0))
            want[(r["source"], r["lang"], name)] = (docs_ + 1, tokens + n)
    assert got == want


def one(spark, *rows):
    return spark.createDataFrame([(*r, "") for r in rows], CHANGE)


def test_a_batch_may_change_when_it_is_committed_again(spark, monkeypatch):
    """Before and after its delta is in the totals."""
    root = scratch_path(spark, "rollup-test")
    for n in (5, 8):
        token_rollups.commit(spark, root, 1, one(spark, ("a", "en", "t", 1, n)))
        assert totals(spark, root) == {("a", "en", "t"): (1, n)}
    token_rollups.commit(spark, root, 2, one(spark, ("a", "en", "t", 1, 100)))
    assert token_rollups.fold(spark, root) and totals(spark, root) == {("a", "en", "t"): (2, 108)}
    token_rollups.commit(spark, root, 1, one(spark, ("b", "en", "t", 1, 1)))
    assert totals(spark, root) == {("a", "en", "t"): (1, 100), ("b", "en", "t"): (1, 1)}
    assert token_rollups.fold(spark, root) and token_rollups._open(token_rollups._record(spark, root)) == ([], [])
    assert totals(spark, root) == {("a", "en", "t"): (1, 100), ("b", "en", "t"): (1, 1)}
    assert token_rollups.deltas(spark, root).count() == 2


def test_a_commit_that_is_cut_short_counts_nothing(spark, monkeypatch):
    root = scratch_path(spark, "rollup-test")
    token_rollups.commit(spark, root, 1, one(spark, ("a", "en", "t", 1, 5)))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(token_rollups.versions, "create", stop)
        for batch_id in (1, 2):
            with pytest.raises(KeyboardInterrupt):
                token_rollups.commit(spark, root, batch_id, one(spark, ("a", "en", "t", 1, 9)))
    assert totals(spark, root) == {("a", "en", "t"): (1, 5)}


def test_a_read_opens_the_totals_and_a_short_tail(spark, monkeypatch):
    monkeypatch.setattr(token_rollups, "FOLD_AFTER", 3)
    root = scratch_path(spark, "rollup-test")
    for n in range(12):
        token_rollups.commit(spark, root, n, one(spark, ("a", "en", "t", 1, 1)))
        assert len(token_rollups._open(token_rollups._record(spark, root))[0]) <= 3
    assert totals(spark, root) == {("a", "en", "t"): (12, 12)}
    # two at a time: one gives way
    monkeypatch.setattr(token_rollups, "_current", lambda *a, plain=token_rollups._current: (monkeypatch.undo(), token_rollups.fold(spark, root), plain(*a))[2])
    token_rollups.commit(spark, root, 99, one(spark, ("a", "en", "t", 1, 1)))
    assert not token_rollups.fold(spark, root)
    assert totals(spark, root) == {("a", "en", "t"): (13, 13)}
