import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from grovespark.llm import suffix_dedup as s


def brute(rows):
    seen = defaultdict(list)
    raw = [(t or "").encode() for _, t in rows]
    for k, data in enumerate(raw):
        for i in range(len(data) - s.WIDTH + 1):
            seen[data[i : i + s.WIDTH]].append((k, i))
    gone = [bytearray(len(d)) for d in raw]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + s.WIDTH] = b"\1" * s.WIDTH
    out = []
    for (doc_id, _), data, g in zip(rows, raw, gone, strict=True):
        kept = bytes(b for b, x in zip(data, g, strict=True) if not x)
        out.append((doc_id, len(data), sum(g), len(bytes(g).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(70), text(75), text(120)]
    rows = []
    for i in range(60):
        t = text(rng.randrange(5, 200))
        if i % 3 == 0:
            p = rng.choice(passage)
            cut = rng.randrange(0, 60)
            t = t + p[cut : len(p) - rng.randrange(0, 60)] + text(40)
        if i % 10 == 1:
            t = rows[0][1][5:] + t
        rows.append((i, t))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "x" * 1000), (105, "ab" * 450), (106, "q" * 400), (107, "q" * 399)]
    rows += [(108, text(150) + passage[2] + text(3) + passage[2]), (109, rows[5][1][:300])]
    return rows


def test_merged_transforms_find_equal_windows():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 700, dtype=np.uint8)
    contexts, where = [], []
    for i in range(40):
        c = base[rng.integers(0, 100) :][: rng.integers(400, 601)].copy()
        if i % 2:
            c[rng.integers(0, len(c))] = 65
        contexts.append(c.tobytes())
        where.append(i << 32)
    contexts += [contexts[0][100:] + b"z" * 100, b"y" * 600, b"y" * 600]
    where += [100, 50 << 32, (50 << 32) + 1]  # a part of the first context itself, and one text at two places
    many = np.zeros(len(contexts), bool)
    many[7] = True
    got = s.repeated_windows(contexts, np.array(where), many)
    at = defaultdict(set)
    whole = set()
    for i, c in enumerate(contexts):
        for k in range(len(c) - 399):
            at[c[k : k + 400]].add(where[i] + k)
            if many[i]:
                whole.add(c[k : k + 400])
    for i, c in enumerate(contexts):
        want = [k for k in range(len(c) - 399) if len(at[c[k : k + 400]]) > 1 or c[k : k + 400] in whole]
        assert got[i].tolist() == want


def test_query_equals_brute_force(spark, monkeypatch):
    for seed, most in ((1, 512), (2, 3), (4, 1)):
        monkeypatch.setattr(s, "MOST_CONTEXTS", most)
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in s.op1(docs).collect()) == brute(rows)


def test_join_path_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(s, "MOST_IDS", 0)
    rows = [*corpus(3)[:30], (3, corpus(3)[3][1]), (3, "other text under the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in s.op1(docs).collect()) == brute(rows)
    assert s.op1(docs.where("doc_id > 999")).count() == 0
    wide = docs.selectExpr("doc_id as key", "text as body", "1 as id", "2 as th", "3 as text")
    assert s.dedup(wide, id_col="key", text_col="body").count() == len(rows)


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    for n, letters in ((400, 26), (401, 2), (5000, 4), (7321, 1)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        want = s.anchors(data)
        for size in (1, 399, 500, 1000):
            monkeypatch.setattr(s, "SEGMENT", size)
            assert all((a == b).all() for a, b in zip(s.anchors(data), want, strict=True))
        monkeypatch.undo()


def test_hot_passage_edges(spark, monkeypatch):
    """A passage that a third of the texts share, at different places and with near copies of its end."""
    monkeypatch.setattr(s, "MOST_CONTEXTS", 2)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, ends = text(900), [text(150) for _ in range(3)]
    rows = [(i, text(rng.randrange(0, 500)) + (passage[: rng.choice([700, 900])] + rng.choice([*ends, ""]) if i % 3 == 0 else "") + text(200)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in s.op1(docs).collect()) == brute(rows)


def test_merge_reads_what_contexts_share(monkeypatch):
    """Bytes around a repeat that no other text has need no sorting, nor do copies of what is left."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(500)
    rows = [(i, text(299) + chr(48 + i) + passage[: 450 + i % 2 * 50] + chr(48 + i) + text(299)) for i in range(40)]
    found = [s.anchors(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    contexts = defaultdict(set)
    for _, anchor, context, *_ in found:
        for a, c in zip(anchor.tolist(), context.tolist(), strict=True):
            contexts[a].add(c)
    names = ("anchor", "lo", "hi", "at", "many", "hot")
    open_ = [
        [dict(zip(names, (a - (a >> 63 << 64), lo, hi, p - lo, False, False), strict=True)) for p, a, _, lo, hi in zip(*map(np.ndarray.tolist, f), strict=True) if len(contexts[a]) > 1]
        for f in found
    ]
    ids = [i for i, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * 40, pa.int32()), pa.array([t for _, t in rows]), pa.array(open_)], names=["id", "th", "text", "open"])
    held = pa.Table.from_batches(s._contexts(iter([batch]))).sort_by("anchor").combine_chunks()
    merged, whole = [], s.repeated_windows
    monkeypatch.setattr(s, "repeated_windows", lambda c, *rest: merged.extend(c) or whole(c, *rest))
    gone = [bytearray(len(t)) for _, t in rows]
    for out in s._merge_partition(iter(held.to_batches())):
        for r in out.to_pylist():
            gone[r["id"]][r["a"] : r["b"]] = b"\1" * (r["b"] - r["a"])
    assert [sum(g) for g in gone] == [r[2] for r in brute(rows)]
    assert 0 < sum(map(len, merged)) < 0.1 * sum(o["hi"] - o["lo"] for some in open_ for o in some)


def test_orders_of_wide_and_close_values():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 50, 300), rng.integers(0, 4, 300) << 60):
        order, values = s._sorted(x)
        assert (order == np.argsort(x, kind="stable")).all() and (values == np.sort(x)).all()
    close = rng.integers(0, 4, 300).astype(np.uint64) + (rng.integers(0, 3, 300).astype(np.uint64) << np.uint64(62))
    for h in (close, rng.integers(0, 1 << 62, 40).astype(np.uint64)[rng.integers(0, 40, 300)]):
        number = s._numbered(h)
        assert ((number[:, None] == number) == (h[:, None] == h)).all()
