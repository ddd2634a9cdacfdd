"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector serves all grades; ordered thresholds part them: P(grade > k) = sigmoid(w.x - t_k). The features are
words and their prefixes, as log counts. They are selected over a bounded sample of labelled rows by Spark
aggregation, so the driver only sees the sample's rows over the selected features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, in_slices

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Labelled rows that take part in fitting: those of the lowest id hash.
SAMPLE = 20_000
#: Features kept: those that tell the grades apart best.
KEPT = 8_000
#: Word forms whose features a Python worker remembers; beyond it, it starts afresh.
MEMO = 100_000


def keys_of(word: str) -> list[str]:
    """The features of one word: itself, and its prefixes with a mark."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights by feature, thresholds by grade. Features that aren't kept have no weight: more of them (KEPT) fit rarer
    words, fewer smooth; which are kept is settled by counts over the sample."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def features(self, text: str | None) -> dict[int, float]:
        total: dict[int, int] = {}
        memo, index = self.memo, self.index
        if len(memo) > MEMO:
            memo.clear()
        for word, n in words_of(text).items():
            got = memo.get(word)
            if got is None:
                got = memo[word] = tuple(index[k] for k in keys_of(word) if k in index)
            for k in got:
                total[k] = total.get(k, 0) + n
        return total

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        total = self.features(text)
        score = float(np.log1p(np.fromiter(total.values(), float)) @ self.weights[list(total)]) if total else 0.0
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))


def fit_ordinal(
    y: np.ndarray, size: np.ndarray, col: np.ndarray, val: np.ndarray, n_features: int, n_grades: int, *, l2: float = 1e-4, steps: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest penalised likelihood, by Adam over all rows at once: row i has grade
    y[i] and the next size[i] of the features col with their values.

    Thresholds are the first one and the logs of the gaps, so they stay ordered. Grades without rows leave their
    thresholds near where they start."""
    at, n = np.repeat(np.arange(len(y)), size), len(y)
    theta = np.zeros(n_features + n_grades - 1)
    theta[n_features] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cut = np.concatenate(([-np.inf], theta[n_features] + np.concatenate(([0], np.cumsum(gaps))), [np.inf]))
        s = np.bincount(at, val * w[col], n)
        above, below = cut[y] - s, cut[y + 1] - s  # grade y lies between these
        fa, fb = (1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (above, below))
        fa, fb = np.where(np.isneginf(above), 0, fa), np.where(np.isposinf(below), 1, fb)
        p = np.maximum(fb - fa, 1e-12)
        da, db = fa * (1 - fa) / p, fb * (1 - fb) / p
        per_cut = np.bincount(y, da, n_grades + 1)[: n_grades + 1] - np.bincount(y + 1, db, n_grades + 1)
        inner = per_cut[1:n_grades] / n
        grad = np.concatenate(
            [
                np.bincount(col, val * (db - da)[at], n_features) / n + l2 * w,
                [inner.sum()],
                [inner[k + 1 :].sum() * gaps[k] for k in range(n_grades - 2)],
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0], np.cumsum(np.exp(theta[n_features + 1 :]))))


def _document_counts(text_col: str, grade_col: str, n_grades: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.list_(pa.int64()))], names=["key", "n"]
            )

        for batch in in_slices(batches):
            for text, grade in zip(batch.column(text_col).to_pylist(), batch.column(grade_col).to_pylist(), strict=True):
                for key in {k for w in words_of(text) for k in keys_of(w)}:
                    counts.setdefault(key, [0] * n_grades)[grade] += 1
            if len(counts) > 200_000:
                yield batch_of()
                counts.clear()
        if counts:
            yield batch_of()

    return run


def _rows(text_col: str, grade_col: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [model.value.features(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(grade_col),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([np.log1p(list(f.values())).astype(np.float32) for f in found], pa.list_(pa.float32())),
                ],
                names=["grade", "col", "val"],
            )

    return run


def fit(
    docs: DataFrame, grades: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    sample: int = SAMPLE, kept: int = KEPT,
) -> Model | None:
    """A model from the documents of at most `sample` labelled ids, the ones of lowest hash; grades are 0, 1, ... and null
    counts as unlabelled, as does a null id. Of an id's several labels the highest counts; rows that share a labelled id
    all take part. None if fewer than two grades occur, as in empty tables. Texts of any length take part whole."""
    spark = bounded(docs).sparkSession
    labels = grades.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
    labels = labels.groupBy(id_col).agg(F.max(F.col(grade_col)).cast("int").alias("grade"))  # of repeated labels the worst
    with Scratch() as scratch:
        labels = scratch.saved(labels.orderBy(F.xxhash64(id_col), id_col).limit(sample), "sample")
        rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(labels), id_col).select("text", "grade")
        rows = scratch.saved(rows, "labelled")
        per = dict(rows.groupBy("grade").count().collect())
        if len(per) < 2:
            return None
        n_grades = max(per) + 1
        clean, other = per.get(0, 0) or 1, sum(n for g, n in per.items() if g)
        n_of = [F.sum(F.get("n", F.lit(g))) for g in range(n_grades)]
        counts = rows.mapInArrow(_document_counts("text", "grade", n_grades), "key string, n array<long>")
        counts = counts.groupBy("key").agg(n_of[0].alias("zero"), sum(n_of[1:], F.lit(0)).alias("more")).where("zero + more >= 3")
        # how far the shares of clean and graded rows that have it lie apart, in standard errors
        a, b = F.col("zero") / clean, F.col("more") / other
        pooled = (F.col("zero") + F.col("more")) / (clean + other)
        z = F.abs(b - a) / F.sqrt(pooled * (1 - pooled) * (1 / clean + 1 / other) + 1e-12)
        best = counts.orderBy(z.desc(), "key").limit(kept).select("key").collect()
        model = Model({r[0]: i for i, r in enumerate(best)}, np.zeros(len(best)), np.zeros(n_grades - 1))
        shared = spark.sparkContext.broadcast(model)
        sparse = rows.mapInArrow(_rows("text", "grade", shared), "grade int, col array<int>, val array<float>").toArrow().combine_chunks()
    col, val = (sparse.column(c).combine_chunks() for c in ("col", "val"))
    size = np.diff(col.offsets.to_numpy())
    parts = [x.flatten().to_numpy() for x in (col, val)]
    model.weights, model.thresholds = fit_ordinal(sparse.column("grade").to_numpy(), size, *parts, len(best), n_grades)
    return model


def _score(model, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            p = [model.value.chances(t).tolist() for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(p, pa.list_(pa.float64()))], names=["id", "p"])

    return run


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, expected_severity, grade, rejected) of every document row.

    expected_severity is the sum of P(grade > k); grade is the likeliest count of thresholds passed at even odds;
    rejected: grade 1 or more is likelier than not. A null or empty text has no features. No model: all are 0."""
    if model is None:
        return docs.select(id_col, F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("rejected"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = bounded(docs).sparkSession.sparkContext.broadcast(model)
    out = docs.select(id_col, text_col).mapInArrow(_score(shared, id_col, text_col), f"id {kind}, p array<double>")
    return out.select(
        F.col("id").alias(id_col), F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("expected_severity"),
        F.size(F.filter("p", lambda x: x >= 0.5)).alias("grade"), (F.get("p", F.lit(0)) >= 0.5).alias("rejected"),
    )


def _keep(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield batch.filter(pa.array([model.value.chances(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def reject(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, without those of which grade 1 or more is likelier than not."""
    if model is None:
        return docs
    shared = bounded(docs).sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col)), docs.schema)


def severity(labels: DataFrame) -> DataFrame:
    """Grades from the label table, which has no severity of its own: 0 not toxic, 1 toxic, 2 toxic and of bad quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_severity, grade, rejected) of every document; see fit(), score() and severity()."""
    return score(docs, fit(docs, severity(labels)))
