"""Quality model and language ID."""

import random
import zlib

import llm_samples as samples
import numpy as np
from pyspark.sql import functions as F
from skuloom.llm import langid, quality_model

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels)
    assert got.count() == docs.count()
    pairs = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r["score"] for r in pairs if r["quality"] == 1]
    bad = [r["score"] for r in pairs if r["quality"] == 0]
    auc = np.mean([g > b for g in good for b in bad])
    assert auc > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in pairs]) > 0.93
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) for r in pairs)


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    run = lambda known: sorted(map(tuple, quality_model.score(docs, known).collect()))
    assert run(labels) == run(turned.repartition(3))


def test_quality_scores_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(quality_model, "PIECE_WORDS", 100)
    words = [f"w{i % 37}".encode() for i in range(1000)]
    index, value = quality_model.Hasher().features(b" ".join(words).decode())
    assert abs((value**2).sum() - 1) < 1e-9 and len(index) == len(set(index.tolist()))


def test_leader_learns_sparse_weights():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(300):
        y = rng.random() < 0.5
        texts.append(" ".join(rng.choices(["good", "fine"] if y else ["spam", "junk"], k=3) + rng.choices("abcdefgh", k=20)))
        labels.append(float(y))
    w = quality_model.fit(texts, labels, buckets=1 << 14)
    assert 0 < np.count_nonzero(w) < 4000
    hasher = quality_model.Hasher(1 << 14)
    right = 0
    for t, y in zip(texts, labels):
        index, value = hasher.features(t)
        right += ((w[index] * value).sum() + w[-1] > 0) == (y == 1)
    assert right > 290


def test_quality_hostile_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (3, 0, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    got = quality_model.score(samples.hostile(spark), labels).collect()
    assert len(got) == len(samples.TEXTS)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert {r["score"] for r in quality_model.score(samples.hostile(spark), none).collect()} == {0.5}
    assert quality_model.score(samples.empty(spark), labels).collect() == []


def test_language_equals_declaration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.99
    assert all(r["kept"] for r in got)


def test_text_corrects_wrong_declarations(spark):
    """A tenth of the declarations is wrong; long texts keep their language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300")
    wrong = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 3
    noisy = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(wrong, F.lit("en")).otherwise(F.col("lang")))
    got = langid.identify(noisy).join(noisy.select("doc_id", "truth", "lang"), "doc_id").collect()
    assert np.mean([r["language"] == r["truth"] for r in got]) > 0.99


def test_pages_use_markup_address_and_host(spark):
    """Short texts lean on the other evidence; unknown scripts are rejected."""
    words = {"en": "the of and that with this", "fr": "les des est dans pour avec"}
    rows = []
    for i in range(400):
        lang = "en" if i % 2 else "fr"
        rng = random.Random(i)
        text = " ".join(rng.choice(words[lang].split()) for _ in range(30))
        rows.append((i, text, f'<html class=x lang="{lang}-XX"><p>', f"https://h{i % 2}.site{i % 4}.example/{lang}/1"))
    rows += [(1000, "42 x", '<html lang=fr>', "https://h0.site0.example/fr/2"), (1001, "42 x", "<html>", "https://h1.site1.example/en/2")]
    rows += [(1002, "Привет как дела сегодня друзья мои хорошие и добрые люди", "<p>", None)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string, url string")
    df = df.withColumn("declared", langid.markup_language("html"))
    df = df.withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    got = {r["page_id"]: r for r in langid.identify(df, "page_id", "text", "declared", "host", "url").collect()}
    assert all(got[i]["language"] == ("en" if i % 2 else "fr") for i in range(400))
    assert got[1000]["language"] == "fr" and got[1001]["language"] == "en"
    assert got[1002]["language"] == "und" and not got[1002]["kept"]


def test_suffix_and_domain(spark):
    df = spark.createDataFrame([("https://www.a.co.fr:80/de/x",), ("http://b.org",), ("odd",), (None,)], "u string")
    got = [tuple(r) for r in df.select(langid.suffix_of(F.coalesce("u", F.lit(""))), langid.domain_of(F.coalesce("u", F.lit("")))).collect()]
    assert got[0][0] == "fr/de" and got[1][0] == "org/" and got[2][0] == "/"


def test_language_hostile_and_empty(spark):
    got = langid.identify(samples.hostile(spark)).collect()
    assert len(got) == len(samples.TEXTS)
    assert all(r["language"] == "und" and not r["kept"] for r in got if r["n_trigrams"] == 0)
    assert langid.identify(samples.empty(spark)).collect() == []
    left = langid.keep_known(samples.hostile(spark))
    assert left.columns == samples.DOCUMENTS.names
    assert left.count() == sum(r["kept"] for r in got)
    assert langid.keep_known(samples.empty(spark)).collect() == []
    unlabelled = samples.hostile(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_crc_is_zlibs(spark):
    from skuloom.llm.common import crc_remainder

    df = spark.createDataFrame([(i,) for i in [0, 7, -3, None, 10**12]], "i long")
    got = {r[0]: r[1] for r in df.select("i", crc_remainder(F.col("i"), 10)).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i in got}


def _in(words, rows, length, lang, seed, first=0):
    rng = random.Random(seed)
    return [(first + i, " ".join(rng.choice(words.split()) for _ in range(length)), lang, f"src{i % 3}") for i in range(rows)]


RARE = {
    "en": "the of and that with this from have which their would there about other",
    "sw": "kwa ni ya katika hii watu mtoto nyumba shule kitabu mwalimu habari sana leo",
    "fi": "ja on ei se kun niin mutta ovat talossa kirja opettaja koulu hyvin paljon",
}


def test_rare_languages_have_models_too(spark):
    """A language of 0.4 percent of the rows is named by its text, also where it is not declared;
    one with too little text for a model keeps its declaration."""
    rows = _in(RARE["en"], 5000, 8, "en", 1) + _in(RARE["sw"], 20, 100, "sw", 2, 10_000)
    rows += _in(RARE["fi"], 3, 20, "fi", 3, 20_000) + _in(RARE["sw"], 1, 100, None, 4, 30_000)
    rows += [(30_001, rows[0][1], "und", "src0")]
    docs = samples.documents(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(got[i]["language"] == lang and got[i]["kept"] for i, _, lang, _ in rows if lang not in (None, "und"))
    assert got[30_000]["language"] == "sw" and got[30_000]["kept"]
    assert got[30_001]["language"] == "en"
    assert all(0.9 < got[i]["posterior"] <= 1 for i in range(20_000, 20_003))
    assert langid.keep_known(docs).count() == len(rows)


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    rows = [r for i, (lang, words) in enumerate(sorted(RARE.items())) for r in _in(words, 40, 80, lang, i, 100 * i)]
    docs = samples.documents(spark, random.Random(5).sample(rows, len(rows))).coalesce(1)
    run = lambda: sorted((r["doc_id"], r["language"], round(r["posterior"], 9)) for r in langid.identify(docs).collect())
    want = run()
    assert {x[1] for x in want} == set(RARE)
    monkeypatch.setattr(langid, "HELD", 1)
    assert run() == want


def test_registered_query_identifies_pages(spark, tmp_path):
    """Pages are rows of the query too; markup, address suffix and host decide short ones."""
    from skuloom.llm import queries

    docs = _in(RARE["en"], 30, 60, "en", 1) + _in(RARE["fi"], 30, 60, "fi", 2, 1000)
    pages = []
    for i, (_, text, lang, _) in enumerate(_in(RARE["en"], 50, 60, "en", 3) + _in(RARE["fi"], 50, 60, "fi", 4)):
        pages.append((i, f"https://www.h{i % 3}.{lang}/{lang}/{i}", f"<html lang='{lang}-XX'><body><p>{text}</p></body></html>"))
    pages += [(900, "https://new.example/a", "<html lang=fi><body><p>42 x</p>"), (901, "https://x.fi/fi/1", "<p>42 z"), (902, "https://x.en/en/1", "<p>42 z")]
    samples.documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op4_evidence_fusion_language"](spark, str(tmp_path)).collect()
    of = {(r["table"], r["doc_id"], r["page_id"]): r["language"] for r in got}
    assert len(got) == len(of) == len(docs) + len(pages)
    assert all(of["documents", i, None] == lang for i, _, lang, _ in docs)
    assert all(of["pages", None, i] == ("en" if i < 50 else "fi") for i in range(100))
    assert [of["pages", None, i] for i in (900, 901, 902)] == ["fi", "fi", "en"]


def test_no_address_is_no_evidence(spark):
    docs = samples.documents(spark, _in(RARE["en"], 60, 60, "en", 1) + _in(RARE["fi"], 60, 60, "fi", 2, 1000))
    run = lambda df, a: sorted(map(tuple, langid.identify(df, address_column=a).collect()))
    assert run(docs.withColumn("a", F.lit(None).cast("string")), "a") == run(docs, None)


def test_pieces_of_long_texts_lose_nothing(monkeypatch):
    """The same features in one piece and in many."""
    import numpy as np

    text = " ".join(f"w{i % 37} {'same same' if i % 5 == 0 else 'Other'}" for i in range(400))
    whole = quality_model.Hasher().features(text)
    for piece in (1, 2, 3, 100, 799, 800):
        monkeypatch.setattr(quality_model, "PIECE_WORDS", piece)
        parts = quality_model.Hasher().features(text)
        assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_addresses_with_user_data(spark):
    rows = spark.createDataFrame([("http://user:pw@site.de/fr/x",), ("https://site.co.uk:8080/a",)], "url string")
    assert [r[0] for r in rows.select(langid.suffix_of(rows.url)).collect()] == ["de/fr", "uk/"]
