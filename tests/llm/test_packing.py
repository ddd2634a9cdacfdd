import zlib

import numpy as np
from grovespark.llm import packing


def test_encoder_equals_the_tokenizer():
    enc = packing.Encoder(packing.tokenizer_json())
    texts = [
        "Hello there. HELLO, world!! it's 12.5% x|y", "<|endoftext|> a. b", "İstanbul ΣΑΣ. déjà vu É é", "a'S'll", "x\x1cy\x85z　w",
        "日本語。テスト", "", " lead  trail ", "ﬁne ǅ ß STRASSE", "tab\tnew\r\nline", None,
    ]
    got = enc.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        want = enc.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes(), text


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 65, 500))[::-1].astype(float)
    needs = np.stack([size, np.ones(500), size**2], 1)
    for rule in ("norm", "dot"):
        for cap in ([64, 64, 4096], [64, 3, 4096], [64, 64, 2500]):
            cap = np.array(cap, float)
            mine = needs[(needs <= cap).all(1)]
            bins, offset = packing.best_fit(mine, cap, rule, np.array([1.0, 0.5, 0.2]))
            for b in range(bins.max() + 1):
                inside = np.flatnonzero(bins == b)
                assert (mine[inside].sum(0) <= cap + 1e-6).all()
                ends = np.cumsum(mine[inside, 0])
                assert offset[inside].tolist() == [0, *ends[:-1].astype(int)]
    bins, _ = packing.best_fit(needs, np.array([64.0, 64, 4096]), "norm", np.array([1.0, 0, 0]))
    first_fit = []
    for x in size:
        at = next((i for i, left in enumerate(first_fit) if left >= x), None)
        if at is None:
            first_fit.append(64 - x)
        else:
            first_fit[at] -= x
    assert bins.max() + 1 <= len(first_fit)


def test_query_packs_everything(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (5, "x. y. z.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.asDict() for r in packing.op10(docs).collect()]
    enc = packing.Encoder(packing.tokenizer_json())
    for doc_id, text in rows:
        ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            r = next(r for r in out if r["doc_id"] == doc_id and r["piece"] == k // 4096)
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(part.tobytes()))
    assert len(out) == 10
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) == 5  # four full pieces, and the rest in one
    assert packing.op10(docs.where("doc_id > 9")).count() == 0


def test_encoder_equals_the_tokenizer_after_every_letter():
    import sys
    import unicodedata

    enc = packing.Encoder(packing.tokenizer_json())
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]
    few = [c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]
    assert len(few) >= 60
    for group, tails in ((letters, "."), (few, packing._TAIL)):
        texts = [f"a{c}{t}" for t in tails for c in group]
        for at in range(0, len(texts), 20_000):
            part = texts[at : at + 20_000]
            want = enc.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            assert enc.encode(part) == [np.array(w.ids, "<u4").tobytes() for w in want]


def test_every_dimension_weighs_in():
    capacity = np.array([100.0, 4, 10_000])
    needs = np.array([[60, 1, 3600], [60, 1, 3600], [20, 1, 400], [20, 1, 400], [15, 1, 225]], float)
    tokens_only = packing.best_fit(needs, capacity, "norm", np.array([1.0, 0, 0]))[0]
    all_of_them = packing.best_fit(needs, capacity, "dot", np.array([0.0, 1, 0]))[0]
    assert tokens_only.tolist() == [0, 1, 0, 0, 1] and all_of_them.tolist() == [0, 1, 0, 1, 0]


def test_repeated_ids_are_dealt_apart_and_other_columns_stay(spark):
    rows = [(None if i % 2 else 7, 0, 300, "x", i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "id long, piece int, length long, block string, offset long").repartition(4)
    out = packing.pack(pieces, block=500)
    got = out.collect()
    assert len(got) == 3000 and len({r["sequence_id"] >> 32 for r in got}) == 1  # few tokens: one block
    assert {r["block"] for r in got} == {"x"} and len({r["sequence_id"] for r in got}) == -(-3000 // 13)
    assert packing.pack(pieces.where("length > 300")).count() == 0
