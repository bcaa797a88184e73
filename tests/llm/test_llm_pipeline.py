"""The stages on their own inputs against plain versions, and the whole run."""

import llm_samples as samples
import test_llm_decontaminate as leaks
import test_llm_mixing as mixes
import test_llm_neardup as near
from skuloom.llm import langid

import corpus_pipeline


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_every_stage_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    # rows to be rejected, linked and masked besides those in the table
    extra = [
        (900001, "Привет как дела сегодня друзья мои хорошие и добрые люди", "en", "src0", 57),
        (900002, "", "en", "src0", 0),
        (900003, "mail someone@site.com and call +1 (555) 010-9999 about it today please", "en", "src1", 70),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    columns = set(docs.columns)
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    ids = {r["doc_id"] for r in langid.identify(docs).where("kept").collect()}
    assert set(kept.columns) == columns and {r[0] for r in rows_of(kept)} == ids
    assert 900001 not in ids and 900002 not in ids and 900003 in ids

    before = rows_of(kept)
    unique = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    component = near.brute([r[:2] for r in before], 5, 80)
    assert set(unique.columns) == columns
    assert sorted(r[0] for r in rows_of(unique)) == sorted(i for i, c in component.items() if i == c)

    before = rows_of(unique)
    clean = corpus_pipeline.benchmark_decontamination(spark, unique, sf_dir)
    windows = {}
    for _, text in benchmark:
        words = leaks.lower_words(text)
        width = min(10, len(words))
        for i in range(len(words) - width + 1) if words else []:
            windows.setdefault(width, set()).add(tuple(words[i : i + width]))

    def leaked(text):
        words = leaks.lower_words(text)
        return any(tuple(words[i : i + k]) in w for k, w in windows.items() for i in range(len(words) - k + 1))

    assert set(clean.columns) == columns
    assert sorted(r[0] for r in rows_of(clean)) == sorted(r[0] for r in before if not leaked(r[1]))

    before = rows_of(clean)
    safe = corpus_pipeline.personal_data(spark, clean, sf_dir)
    after = {r["doc_id"]: r for r in safe.collect()}
    assert set(safe.columns) == columns and len(after) == len(before)
    from test_llm_pii import naive

    for doc_id, text, *_ in before:
        assert naive(after[doc_id]["text"]) == []
        assert after[doc_id]["n_chars"] == len(after[doc_id]["text"])
        if not naive(text):
            assert after[doc_id]["text"] == text
    assert after[900003]["text"] == "mail [EMAIL] and call [PHONE] about it today please"

    mixed = corpus_pipeline.mix_sources(spark, safe, sf_dir)
    want = {w[0]: w[4] // w[1] for w in mixes.naive(rows_of(safe)) if w[4]}
    assert {r["doc_id"]: r["copies"] for r in mixed.collect()} == want


def test_run_is_the_stages_in_order(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "benchmark_decontamination", "personal_data", "mix_sources"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["text"], r["copies"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_hostile_and_empty(spark, sf_dir):
    for df in (samples.hostile(spark), samples.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
        assert df.columns == [*samples.DOCUMENTS.names, "copies_"]
        df.collect()
