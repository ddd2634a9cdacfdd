"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against document token windows.

The benchmark is read in blocks of a bounded number of bytes. One block is broadcast to the tasks that scan the
documents; a benchmark beyond the bound takes one scan per block, and a row carries its hits from scan to scan.
Windows are looked up by a rolling hash of word numbers and every hit is verified against the words themselves."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import bounded, in_slices

#: Words are runs of ASCII letters and digits and of all code points from U+0080, whose UTF-8 bytes are all >= 0x80.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Bytes of benchmark text that one broadcast may hold.
BLOCK_BYTES = 32 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each n consecutive ids."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _B + ids[k : k + len(out)]
    return out


class GramSet:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, list[str]]] = {}
        grams: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], np.int64)
            size = min(n, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                grams[size][ids[k : k + size].tobytes()].add(item_id)
        self.grams = {size: {k: list(v) for k, v in g.items()} for size, g in grams.items()}
        self.hashes = {
            size: np.sort(_rolling(np.frombuffer(b"".join(g), np.int64).astype(np.uint64), size)[::size])
            for size, g in self.grams.items()
        }

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Positions of hit words, ascending, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        mask, found = np.zeros(len(ids) + 1, np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            if len(starts) * 4 > len(ids):
                got = _rolling(ids.astype(np.uint64), size)[starts]
            else:
                got = np.zeros(len(starts), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(size):
                        got = got * _B + ids[starts + k].astype(np.uint64)
            at = np.searchsorted(hashes, got)
            for s in starts[hashes[np.minimum(at, len(hashes) - 1)] == got].tolist():
                if owners := self.grams[size].get(ids[s : s + size].tobytes()):
                    found.update(owners)
                    mask[s] += 1
                    mask[s + size] -= 1
        return np.flatnonzero(np.cumsum(mask[:-1]) > 0), found


def _scan(gram_set, last: bool):
    """Adds a block's hits to rows (id, text, hit_words, items); the last block's scan has n_words in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = gram_set.value
        for batch in in_slices(batches):
            n_words, pos, items = [], [], []
            before = zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True) if batch.num_columns > 2 else repeat(((), ()))
            for text, (were, had) in zip(batch.column(1).to_pylist(), before):  # noqa: B905
                words = words_of(text)
                at, found = grams.hits(words)
                n_words.append(len(words))
                pos.append(np.union1d(np.array(were, np.int64), at) if were else at)
                items.append(sorted(found.union(had), key=lambda x: (x is None, x or "")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()) if last else batch.column(1),
                    pa.array(pos, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["id", "n_words" if last else "text", "hit_words", "items"],
            )

    return run


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size, some = [], 0, False
    for row in bench.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") * 4
        if size >= block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def annotate(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = 13, share: float = 0.05, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row: id, n_words, hit_words (0-based word positions), items, n_hit, n_items, contaminated.

    A document is contaminated if it has a hit and hit words are at least `share` of its words. Items of fewer than n
    words are one window each; items and documents without words never match. Null texts have no words. A null among
    the items, at their end, stands for those without an id. Repeated documents get a row each. Empty tables give no
    rows, or documents without hits."""
    spark = bounded(docs).sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = [spark.sparkContext.broadcast(GramSet(block, n)) for block in _blocks(bench, item_col, item_text_col, block_bytes)]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for grams in shared:
        last = grams is shared[-1]
        out = out.mapInArrow(_scan(grams, last), f"id {kind}, {'n_words long' if last else 'text string'}, hit_words array<int>, items array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", "hit_words", "items",
        F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))


def _mark(gram_set, text_index: int):
    """Rows whose last column, the hit words of earlier blocks, has this block's too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = gram_set.value
        for batch in in_slices(batches):
            pos = []
            for text, were in zip(batch.column(text_index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                at, _ = grams.hits(words_of(text))
                pos.append(np.union1d(np.array(were, np.int64), at) if were else at)
            columns = [*batch.columns[:-1], pa.array(pos, batch.schema.field(batch.num_columns - 1).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _strip(text_index: int, share: float, mode: str):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            keep, texts = [], []
            for text, at in zip(batch.column(text_index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                bad = len(at) > 0 and len(at) >= share * len(words_of(text))
                keep.append(not bad if mode == "documents" else True)
                if mode == "spans" and bad:
                    spans, cut = [m.span() for m in word.finditer(text)], []
                    for run_ in np.split(np.array(at), np.flatnonzero(np.diff(at) > 1) + 1):
                        cut.append((spans[run_[0]][0], spans[run_[-1]][1]))
                    for a, b in reversed(cut):
                        text = text[:a] + text[b:]
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[text_index] = pa.array(texts, batch.schema.field(text_index).type)
            schema = pa.schema(list(batch.schema)[:-1])
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def remove(
    docs: DataFrame, bench: DataFrame, *, mode: str = "documents", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = 13, share: float = 0.05, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents without the contaminated ones (mode "documents"), or with their hit passages cut out ("spans").

    All columns stay as they are, whatever their names. Each benchmark block is one more pass; the hits of all of
    them together are judged."""
    assert mode in ("documents", "spans")
    spark, at = bounded(docs).sparkSession, docs.columns.index(text_col)
    marked = StructType([*docs.schema.fields, StructField("__hit_words", ArrayType(IntegerType()))])
    out = docs.select("*", F.array().cast("array<int>").alias("__hit_words"))
    for block in _blocks(bench, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(GramSet(block, n))
        out = out.mapInArrow(_mark(shared, at), marked)
    return out.mapInArrow(_strip(at, share, mode), docs.schema)


def op6(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's row for each document; see annotate()."""
    out = annotate(docs, bench)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM g),
h AS (
  SELECT d.doc_id, x.i, s.n, g.item_id
  FROM d, sizes s, LATERAL (SELECT unnest(generate_series(1, len(d.w) - s.n + 1)) AS i) x
  JOIN g ON g.n = s.n AND g.gram = array_to_string(d.w[x.i:x.i + s.n - 1], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM h, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
