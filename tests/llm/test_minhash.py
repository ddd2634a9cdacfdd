import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from grovespark.llm import minhash as m


def grams(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1))))


def brute_classes(rows):
    """Union of all pairs of TF-IDF weighted Jaccard 0.8 and more, and of equal texts."""
    own = {i: grams(t) for i, t in rows}
    df = Counter(g for v in own.values() for g in v)
    w = {i: {g: n * math.log1p(min(len(rows) / df[g], m.SATURATE)) for g, n in v.items()} for i, v in own.items()}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(w)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            low = sum(min(v, w[j][g]) for g, v in w[i].items() if g in w[j])
            total = sum(w[i].values()) + sum(w[j].values()) - low
            if total and low / total >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def corpus(seed=3, sizes=(2, 3, 30, 200)):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)]
    rows, n = [], 0
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(120)]
        for c in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2]) if c else 0):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(60):
        rows.append((n, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 80])))))
        n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Two Words"), (n + 4, "two  words")]


def test_shingles_equal_brute_force():
    texts = [t for _, t in corpus()][::7] + [None, "", "a b c d e a b c d e a b c d e", "É é x"]
    doc, h, tf = m.shingles(texts)
    for k, text in enumerate(texts):
        assert sorted(tf[doc == k].tolist()) == sorted(grams(text).values())
    same = m.shingles(["a b c d e", "x a b c  d\te"])
    assert len(set(same[1][same[0] == 0]) & set(same[1][same[0] == 1])) == 1


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    wa, wb = rng.gamma(2, 1, 3000), None
    wb = np.where(rng.random(3000) < 0.7, wa, wa * rng.gamma(2, 0.7, 3000))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    sampler = m.Sampler(2000)
    sig = sampler.sample(np.repeat([0, 1], 3000), np.concatenate([h, h]), np.concatenate([wa, wb]), 2)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in m.op5(docs).collect()}
    assert got == brute_classes(rows)


def test_repeats_empty_tables_and_columns(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 2), (3, "A b c  d e f", 3), (9, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    out = sorted((r["doc_id"], r["class_id"]) for r in m.classes(docs).collect())
    assert out == [(3, 3), (7, 3), (7, 3), (9, 9)]
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["class_id"] for r in kept.collect()) == [3, 4]
    assert m.classes(docs.where("doc_id > 99")).count() == 0


def test_shuffled_counts_equal_broadcast_ones(spark):
    texts = spark.createDataFrame([(t,) for _, t in corpus()], "text string")
    a, b = m.weights(texts), m.weights(texts, most=0)
    assert (a.h == b.h).all() and (a.idf == b.idf).all() and len(a.h)


def test_pairs_inside_large_buckets_are_found(spark):
    """2,400 texts share a passage (similarity 0.74, so buckets hold over 1,000); 100 pairs of them are near copies."""
    rng = random.Random(5)
    passage, rows = " ".join("p%d" % i for i in range(400)), []
    for n in range(2400):
        own = ["o%d" % rng.randrange(10**9) for _ in range(16)]
        if n % 24 == 1:  # the second of a pair keeps the first half of its own words
            own[:8] = before[:8]
        before = own
        rows.append((n, passage + " " + " ".join(own)))
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string")
    model = m.weights(texts)
    doc, h, tf = m.shingles([t for _, t in rows])
    sig = m.Sampler().sample(doc, h, model.of(h, tf), len(rows))
    assert max(np.unique(m._keys(sig)[:, b], return_counts=True)[1].max() for b in range(m.BANDS)) > 1000
    v = [(h[doc == i], model.of(h, tf)[doc == i]) for i in range(4)]
    assert m.weighted_jaccard(*v[0], *v[1]) > 0.81 and m.weighted_jaccard(*v[0], *v[2]) < 0.78
    got = {r["doc_id"]: r["class_id"] for r in m.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n - (n % 24 == 1) for n in range(2400)}


def test_matrix_products_equal_pairs(spark):
    rows = corpus(sizes=(2, 9, 40))
    texts = [t for _, t in rows if t and t.strip()] + ["a b c d e " * 9, "a b c d e " * 7]
    model = m.weights(spark.createDataFrame([(t,) for t in texts], "text string"))
    doc, h, tf = m.shingles(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    n, f, w = m.features(pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(tf)), model)
    total, common = np.bincount(n, w), m.shared_weight(f, w, np.bincount(n))
    for i in range(0, len(texts), 5):
        for j in range(i):
            low = common[i, j]
            want = m.weighted_jaccard(h[doc == i], model.of(h, tf)[doc == i], h[doc == j], model.of(h, tf)[doc == j])
            assert abs(low / (total[i] + total[j] - low) - want) < 1e-9
