"""The stages against brute force on a small corpus."""

import os
import random

import corpus_pipeline
import pytest
from grovespark.llm import packing

from .test_filters import brute_hits
from .test_minhash import brute_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "the", "re", "ti", "on", "sh"]) for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(120):
        text = " ".join(word() for _ in range(80))
        toxic = i % 6 == 0
        if toxic:
            text += " you scum " * 3
        if i % 10 == 3:
            text += " mail jo@mail.example.com"
        if i % 15 == 7:
            text += " " + passage
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
        if i % 20 == 4:
            rows.append((500 + i, text + " tail", "en", "s", len(text) + 5))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, passage


def test_stages_equal_brute_force(spark, folder, tmp_path):
    path, rows, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if "scum" not in (t or "")}
        elif name == "minhash_near_dedup":
            found = brute_classes(list(kept.items()))
            kept = {i: t for i, t in kept.items() if found[i] == i}
        elif name == "benchmark_decontamination":
            hits = {i: brute_hits(t, [(1, passage)]) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
        elif name == "pii":
            kept = {i: t and t.replace("jo@mail.example.com", "[EMAIL]") for i, t in kept.items()}
        if k < 4:
            got = {r["doc_id"]: r for r in docs.collect()}
            assert {i: r["text"] for i, r in got.items()} == kept, name
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    enc = packing.Encoder(packing.tokenizer_json())
    total = sum(len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept.values())
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == kept.keys() and sum(r["length"] for r in pieces) == total
    assert len({r["sequence_id"] for r in pieces}) == -(-total // 4096)


def test_run_equals_the_stages(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 50
    assert len(corpus_pipeline.STAGES) == 5 and os.path.exists(f"{path}/documents.parquet")
