"""Rows without an id, in every operator that joins by it."""

from grovespark.llm import lattice_lm, line_dedup, minhash, packing, suffix_dedup


def test_rows_without_an_id(spark):
    text = "one two three four five six seven eight nine ten " * 12
    docs = spark.createDataFrame([(1, text), (None, text), (2, text), (None, None)], "doc_id long, text string")
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    want = ["1", "2", "None", "None"]
    out = suffix_dedup.op1(docs)
    assert ids(out) == want and ids(out.where("n_removed > 0")) == ["1", "2", "None"]
    out = line_dedup.op2(docs, least_words=5, least_run=0)
    assert ids(out) == want and ids(out.where("n_removed > 0")) == ["2"]
    out = minhash.op5(docs)
    assert ids(out) == want and ids(out.where("kept")) == ["1", "None", "None"]
    assert ids(minhash.keep_one(docs)) == ["1", "None", "None"]
    out = lattice_lm.op4(docs)
    assert ids(out) == want and out.where("doc_id is null and held_out").count() == 0
    assert ids(packing.op10(docs)) == want
