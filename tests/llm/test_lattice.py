import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from grovespark.llm import lattice_lm as q


def every_path(lattice, word):
    """Summed probability of all ways to cut the word, one by one."""
    def walk(at):
        if at == len(word):
            return math.exp(lattice.stop)
        return sum(math.exp(p) * walk(end) for end, p, _ in lattice.edges(word, at))

    return walk(0)


@pytest.fixture(scope="module")
def lattice():
    return q.Lattice.ranked(*q.piece_vocabulary())


def test_forward_sums_all_segmentations(lattice):
    words = ["a", "the", "these", "é", "xx1y", "日本", "thethe"]
    blocks = q.Blocks(lattice)
    for word, got in zip(words, blocks.scores(words), strict=True):
        assert math.isclose(math.exp(lattice.score(word)), every_path(lattice, word), rel_tol=1e-9)
        assert math.isclose(got, lattice.score(word), rel_tol=1e-9)


def test_blocks_equal_the_word_by_word_lattice(lattice):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshré\0") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    blocks, a, b = q.Blocks(lattice), {}, {}
    assert np.allclose(blocks.scores(words), [lattice.score(w) for w in words])
    times = np.arange(1, len(words) + 1)
    blocks.expect(words, times, a)
    for w, n in zip(words, times.tolist(), strict=True):
        lattice.expect(w, n, b)
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-9) for k in a)


def test_probabilities_stay_below_one(lattice):
    for x in (lattice, q.Lattice.counted(*q.piece_vocabulary(), {(0, "a"): 3.0, (1, ""): 1.0}, 5)):
        assert sum(map(math.exp, x.first.values())) + math.exp(x.other[0]) <= 1 + 1e-9
        assert sum(map(math.exp, x.rest.values())) + math.exp(x.other[1]) + math.exp(x.stop) <= 1 + 1e-9


def corpus():
    rng = random.Random(2)
    vocab = ["".join(rng.choice(["an", "the", "re", "ti", "on"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    return [*rows, (80, None), (81, ""), (82, "The x THE\ttHe\n É"), (83, "z" * 3000), (5, rows[5][1])]


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(q, "HEAD_SHARE", 1 / 50)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = q.op4(docs).collect()
    assert len(out) == len(rows)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: [*filter(None, __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(fold))), None]
    train, text = Counter(), dict(rows)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(cut(t))
    total, v = sum(train.values()), len(train)
    for r in out:
        tokens = cut(text[r["doc_id"]])
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    assert q.op4(docs.where("doc_id > 999")).count() == 0


def test_likely_words_score_higher(spark):
    rows = corpus()
    a, b = [i for i in range(900, 1000) if q.held_out(i)][:2]
    docs = spark.createDataFrame([*rows, (a, "thereonan antian"), (b, "xqzjvkqqw wvvqxz")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in q.score(docs).collect()}
    assert got[a] > got[b] + 2


def test_two_rounds_are_fitted(spark, monkeypatch):
    rounds, counted = [], q.Lattice.counted
    monkeypatch.setattr(q.Lattice, "counted", lambda *a: rounds.append(1) or counted(*a))
    counts = spark.createDataFrame([("token", 3, 2), ("tokens", 1, 1)], "word string, n long, c long")
    q.fit(counts)
    assert len(rounds) == 2


@pytest.mark.parametrize("head_share", [None, 2.0])
def test_scores_equal_brute_force(spark, head_share):
    """Expectation-maximisation and scores word by word; with head_share 2 every word takes the join."""
    rows = [*corpus(), (84, "unseen 日本 words")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, word int, row int")
    got = {r["doc_id"]: r for r in q.score(docs, head_share=head_share).collect()}
    train = Counter(w.decode() for i, t in rows if not q.held_out(i) for w in q.words_of(t))
    ends = sum(not q.held_out(i) for i, _ in rows)
    first, rest = q.piece_vocabulary()
    model = q.Lattice.ranked(first, rest)
    for _ in range(2):
        counts = {}
        for w, n in train.items():
            model.expect(w, n, counts)
        model = q.Lattice.counted(first, rest, counts, sum(train.values()))
    end = (ends + 0.5) / (sum(train.values()) + ends + 1)
    once, twice = (sum(n == k for n in [*train.values(), ends]) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    tokens = sum(train.values()) + ends
    for i, t in dict(rows).items():
        words = [w.decode() for w in q.words_of(t)]
        path = [model.score(w) + math.log1p(-end) for w in words]
        want = (sum(path) + math.log(end)) / math.log(10)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9), i
        held = math.log(discount * (len(train) + 1) / tokens)
        both = [np.logaddexp(math.log((train[w] - discount) / tokens), held + p) if train[w] else held + p for w, p in zip(words, path, strict=True)]
        assert math.isclose(got[i]["mixed_score"], (sum(both) + math.log(end)) / math.log(10), rel_tol=1e-9), i
