import hashlib
import random
import re

import llm_samples as samples
from skuloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def naive(text, items, window=10):
    words, hit, found = lower_words(text), set(), set()
    for item_id, item in items:
        w = lower_words(item)
        width = min(len(w), window)
        for i in range(len(w) - width + 1) if w else []:
            for at in range(len(words) - width + 1):
                if words[at : at + width] == w[i : i + width]:
                    hit |= set(range(at, at + width))
                    found.add(str(item_id))
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def tables(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha Beta gamma É0 delta9 ñu x y z w".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 9, 10, 11, 14, 25, 40))]
    items += [(9, "!!"), (10, None), (11, items[7][1]), (100, items[6][1])]
    texts = []
    for _ in range(40):
        parts = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            w = rng.choice(items[:8])[1].split()
            start = rng.randrange(len(w))
            parts[len(parts) // 2 : len(parts) // 2] = w[start : start + rng.randint(1, 20)]
        texts.append("".join(p.upper() if rng.random() < 0.2 and p.isascii() else p + rng.choice([" ", ", ", "\n", "-"]) for p in parts))
    rows = list(enumerate([*texts, None, "", "..."]))
    return rows, items


def test_scan_equals_a_naive_version(spark):
    rows, items = tables(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for keep in (items, items[3:]):  # with and without short items
        bench = benchmark.where(benchmark["item_id"].isin([i for i, _ in keep]))
        got = decontaminate.scan(samples.documents(spark, rows), bench).collect()
        for r in got:
            text = dict(rows)[r["doc_id"]]
            have = (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
            assert have == naive(text, keep), text
        assert len(got) == len(rows)


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    rows, items = tables(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted(map(tuple, decontaminate.scan(samples.documents(spark, rows), benchmark).drop("spans").collect()), key=repr)
    first = run()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    assert run() == first
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert run() == first
    clean = lambda: sorted((r["doc_id"], r["text"] or "") for r in decontaminate.remove(samples.documents(spark, rows), benchmark, mode="spans").collect())
    second = clean()
    monkeypatch.undo()
    assert clean() == second


def test_no_words_of_documents_are_shuffled(spark, monkeypatch):
    """Beyond the broadcast: exchanges carry single windows, and none has rows without a key."""
    rows, items = tables(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "WINDOW", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = decontaminate.scan(samples.documents(spark, rows), benchmark)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sections = [s for s in text.split("\n\n") if re.match(r"\(\d+\) Exchange", s.strip())]
    assert sections
    for section in sections:
        inputs = re.search(r"Input \[\d+\]: \[(.*)\]", section)[1]
        assert not re.search(r"\bw#", inputs), section
    assert "CartesianProduct" not in text


def test_remove_documents_and_spans(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it: {item.upper()}! And after."), (2, "nothing here"), (3, None), (4, item), (5, f"-- {item}")]
    df = samples.documents(spark, rows)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.remove(df, bench).collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(df, bench, mode="spans").collect()}
    assert cut == {1: "Before it: And after.", 2: "nothing here", 3: None, 4: "", 5: "-- "}
    assert decontaminate.remove(df, bench).columns == df.columns


def test_plan_is_native(spark):
    rows, items = tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = samples.documents(spark, rows).repartition(2)
    plan = decontaminate.scan(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_hostile_and_empty(spark):
    bench = spark.createDataFrame([(None, "école straße ñandú"), (7, "a short note")], "item_id long, text string")
    got = decontaminate.scan(samples.hostile(spark), bench).collect()
    assert len(got) == len(samples.TEXTS)
    # an item without an id marks the words of document 7 and counts as no item
    assert sorted((r["n_hit"], r["n_items"]) for r in got if r["contaminated"]) == [(3, 0), (3, 1)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.scan(samples.hostile(spark), none).collect())
    assert decontaminate.scan(samples.empty(spark), bench).collect() == []
    assert decontaminate.remove(samples.hostile(spark), bench, mode="spans").columns == samples.DOCUMENTS.names
