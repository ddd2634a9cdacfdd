"""Line dedup, quality rules, decontamination and toxicity against brute force, with nulls, ties and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from grovespark.llm import decontaminate, line_dedup, quality_rules, toxicity
from pyspark.sql import functions as F


def test_lines_keep_the_earliest(spark):
    long = "this line has five words"
    rows = [
        (3, f"{long}\nshort\n  This LINE  has five\twords \nother line with five words"), (1, f"a b\n{long}"), (2, "short\n" + long + "\n" + long), (4, None), (5, ""),
        (6, "other line with five words"), (6, "other line with five words"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.op2(docs, least_words=5, least_run=0).collect()}
    assert line_dedup.op2(docs, least_words=5, least_run=0).count() == len(rows)
    assert out[1]["n_removed"] == 0 and out[1]["text"] == rows[1][1]
    assert out[2]["text"] == "short" and out[2]["removed"] == "6:30,31:55"
    assert out[3]["text"] == "short\nother line with five words" and out[3]["n_units"] == 4
    assert out[4]["text"] is None and out[5]["text"] == "" and out[4]["n_units"] == out[5]["n_units"] == 0
    assert out[6]["text"] == "" and out[6]["n_removed"] == 1
    assert line_dedup.op2(docs.where("doc_id > 99"), least_words=5, least_run=0).count() == 0


def test_lines_by_another_rank_and_paragraphs(spark):
    docs = spark.createDataFrame([(1, "one two three four five\n\nx", 9), (2, "one two\nthree four five\n \ny", 1)], "digest long, gone string, id int")
    got = {r["digest"]: r["text"] for r in line_dedup.dedup(docs, id_col="digest", text_col="gone", rank_col="id", unit="paragraph").collect()}
    assert got == {1: "x", 2: "one two\nthree four five\n \ny"}


def test_sentences_inside_lines(spark):
    passage = "The same words come here again. Another sentence of the passage follows."
    docs = spark.createDataFrame([(1, f"Own start of one. {passage} Own end of one."), (2, f"Something else before it! {passage}"), (3, f"X. {passage}\nend")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.op2(docs, least_words=5, least_run=0).collect()}
    assert got == {1: f"Own start of one. {passage} Own end of one.", 2: "Something else before it!", 3: "X. end"}


def test_only_passages_go(spark):
    verse = "\n\n".join(f"Line {'abcdefghij'[i]} of it. Yes" for i in range(6))
    rows = [(1, verse + "\nA phrase that writers share."), (2, "Own.\n" + verse + "\nOwn end."), (3, "A phrase that writers share. Own " + "words " * 30), (4, "x"), (4, "y")]
    rows += [(None, "Same words. " * 20), (5, "Same words.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("who", F.lit(2))
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.op2(docs).collect()}
    assert len(out) == len(rows) and rows[0] in out and rows[2] in out
    got = out[2, "Own.\n\n\n\n\n\nOwn end."]
    assert got["n_removed"] == 12 and got["n_units"] == 19
    assert out[None, "Same words. "]["n_removed"] == 19


def test_passages_of_short_units_go_whole(spark, tmp_path):
    import duckdb
    from grovespark.llm import queries

    verse = "\n".join(f"Short line {i}" for i in range(20))
    rows = [(1, verse), (2, "An introduction of more words.\n" + verse), (3, None), (4, "Yes. No. Yes.")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op2_every_unit_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["op2_every_unit_dedup"])
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall())
    assert [r[want.columns.index("text")] for r in rows] == [verse, "An introduction of more words.", None, "Yes. No."]


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(4)
    pick = lambda: " ".join(rng.choice(["a", "bé", "c*", "#d", "e\n", "\n", "\t", "é"]) for _ in range(rng.randrange(0, 120)))
    rows = [(i, pick()) for i in range(80)] + [(80, None), (81, ""), (82, "x " * 5000), (83, "one two three four five six seven eight " * 2), (82, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.statistics(docs).collect())
    assert got == sorted((i, *statistics(t)) for i, t in rows)


def test_rules_find_the_bad(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + rng.choice("abcdefgh") for _ in range(n))
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, words(60).replace(" ", "*** ") if bad and i % 2 else words(60).upper() if bad else words(60)))
        marks.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (300, None), (301, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (300, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules.op3(docs, labels).collect()}
    wrong = sum(out[i]["kept"] != bool(q) for i, q in marks)
    assert wrong <= 6 and out[300]["base_failed"] and not out[301]["kept"]
    none = quality_rules.op3(docs, labels.where("doc_id < 0")).where("kept").count()
    assert none == 300 - sum(r["base_failed"] for i, r in out.items() if i < 300)


def test_rules_use_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality_rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_hits(text, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(fold))
    words, hit, found = cut(text), set(), set()
    for item_id, t in items:
        w = cut(t)
        size = min(n, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


def test_hits_equal_brute_force(spark):
    rng = random.Random(6)
    pick = lambda n: " ".join(rng.choice(["a", "B", "c", "dé"]) for _ in range(n))
    items = [(i, pick(rng.choice([2, 5, 13, 20, 40]))) for i in range(12)] + [(20, None), (21, " ,"), (3, "other text with a known id")]
    rows = [(i, pick(rng.randrange(0, 90)) + " " + items[i % 12][1]) for i in range(40)] + [(50, None), (51, ""), (50, "a B c")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.op6(docs, bench).collect())
    want = []
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert got == sorted(want)
    once = spark.createDataFrame(rows[:40], "doc_id long, text string")
    parts = decontaminate.annotate(once, bench, block_bytes=100).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in parts) == sorted((i, n, h, tuple(f)) for i, (n, h, f) in ((i, brute_hits(t, items)) for i, t in rows[:40]))
    assert decontaminate.op6(docs, bench.where("item_id < 0")).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.op6(docs.where("doc_id < 0"), bench).count() == 0


def test_removal_keeps_columns_and_clean_texts(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"Start, {passage}. End", "x"), (2, "clean text", None), (3, None, "y")], "id long, text string, items string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and sorted(r["id"] for r in left.collect()) == [2, 3]
    cut = {r["id"]: r["text"] for r in decontaminate.remove(docs, bench, mode="spans").collect()}
    assert cut == {1: "Start, . End", 2: "clean text", 3: None}


def test_blocks_of_the_benchmark_are_judged_together(spark):
    """Hits of 3% from each of two blocks make 6%; repeated and missing ids keep their rows, and an item without an id counts."""
    items = [[f"{k}{i}" for i in range(3)] for k in "xy"]
    text = " ".join([*items[0], *(f"w{i}" for i in range(94)), *items[1]])
    docs = spark.createDataFrame([(1, text), (1, "clean"), (None, text), (None, "clean too")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(items[0])), (None, " ".join(items[1]))], "item_id long, text string")
    for size in (1, 1 << 20):
        got = decontaminate.annotate(docs, bench, block_bytes=size).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame(
            [(1, 100, 6, ["1", None], True), (1, 1, 0, [], False), (None, 100, 6, ["1", None], True), (None, 2, 0, [], False)],
            "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean").collect()))
        assert sorted(r["text"] for r in decontaminate.remove(docs, bench, block_bytes=size).collect()) == ["clean", "clean too"]
        spans = decontaminate.remove(docs, bench, mode="spans", block_bytes=size).where("doc_id = 1").collect()
        assert {r["text"].strip() for r in spans} == {"clean", " ".join(f"w{i}" for i in range(94))}


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(1)
    w = rng.normal(size=6)
    x = rng.normal(size=(4000, 6))
    noise = np.log(1 / rng.random(4000) - 1)
    y = np.digitize(x @ w + noise * 0.3, [-0.5, 1.0])
    rows = [(int(g), list(range(6)), v.tolist()) for g, v in zip(y, x, strict=True)]
    flat = [np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows]), *(np.concatenate([r[k] for r in rows]) for k in (1, 2))]
    got, cuts = toxicity.fit_ordinal(*flat, 6, 3, l2=0, steps=600)
    assert np.corrcoef(got, w)[0, 1] > 0.98 and cuts[0] < cuts[1]
    assert (np.digitize(x @ got, cuts) == y).mean() > 0.85


def test_toxicity_separates_held_out_rows(spark):
    rng = random.Random(8)
    base = lambda: [rng.choice(["the", "river", "stone", "walk", "green", "paper"]) for _ in range(40)]
    rows, marks = [], []
    for i in range(400):
        words, grade = base(), i % 4 == 0
        if grade:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["scum", "scumbag", "rotten"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 8 != 0), int(grade)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:200], (900, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.op7(docs, labels).collect()}
    assert sum(out[i]["rejected"] == (i % 4 == 0) for i in range(200, 400)) >= 197
    assert not out[900]["rejected"] and not out[901]["rejected"] and len(out) == 402
    assert out[204]["expected_severity"] > out[205]["expected_severity"]
    one = toxicity.op7(docs, labels.where("toxic = 0"))
    assert one.where("rejected or expected_severity <> 0").count() == 0
    kept = toxicity.reject(docs.withColumn("p", F.lit(1)), toxicity.fit(docs, toxicity.severity(labels)))
    assert kept.columns == ["doc_id", "text", "p"] and abs(kept.count() - 302) <= 3
