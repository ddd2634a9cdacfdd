"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Weights are term frequency times ln(1 + min(N / df, C)), df over all documents. Only shingles in at least a C-th of the
documents weigh less than the rest, so only those need a count: every one of them is that frequent in some chunk of
documents, the chunks name candidates, and a second pass counts those exactly.

Samples of two texts agree with the probability of their weighted Jaccard similarity. Bands of samples make buckets,
and the members of a bucket meet in chunks of bounded size: their samples tell which texts are in a pair worth
verifying, only those bring their weight vectors, and a matrix product verifies all pairs of a chunk exactly, so no
pair is ever a row. A bucket of several chunks has two more steps: its most linked text meets every chunk, and then
chunks meet each other for what is still in different classes. Exact copies share one representative throughout.

Limits of the method: two texts of similarity 0.8 share no bucket with probability 3e-5, and agree on under WORTH of
their samples with probability 1e-5. The frequency ratio in the weights saturates (SATURATE), so that the weight of a
word that occurs once doesn't grow with the corpus and large groups of near copies keep the similarity that they have
in words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M3, Scratch, bounded, in_slices, mix64, release, rows_of, saved

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Frequency ratio at which inverse document frequency saturates (C above).
SATURATE = 64
#: Members of a bucket that are compared with each other at once.
CHUNK = 512
#: Shared samples, as a share, from which a pair is worth verifying: over four standard errors below SIMILAR.
WORTH = 0.6
#: Columns of the matrices that a chunk's products take at once.
WIDE = 4096
#: Frequent-shingle candidates that are broadcast as hashes (16 MB); beyond it all shingles are counted by a shuffle.
MOST_CANDIDATES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_power[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), b, np.uint64)
            steps[0] = 1
            _power[k] = np.cumprod(steps)
    return _power


def shingles(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, 64-bit hash, occurrences) of each distinct shingle, by document, then hash.

    Words are runs of non-blanks, A-Z in lower case. A text of fewer words than k, but not none, is one shingle."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    buffer = np.frombuffer(b"\n".join(map(b" ".join, words)) + b"\n", np.uint8)
    ends = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(words)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + first[doc]
    power, inverse = _powers(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)])))
    a, b = starts[at], ends[at + np.minimum(n, k)[doc] - 1]
    h = mix64((sums[b] - sums[a]) * inverse[a])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return doc[new], h[new], np.diff(np.concatenate((new, [len(h)])))


def _frequent_in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in a SATURATE-th of a chunk's documents; the last, short chunk is one with the chunk before it."""

    def found(held: list[np.ndarray], docs: int) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n * SATURATE >= docs].view(np.int64))], names=["h"])

    before, held, docs, size = ([], 0), [], 0, 0
    for batch in in_slices(batches):
        _, h, _ = shingles(batch.column(0).to_pylist())
        held.append(h)
        docs, size = docs + len(batch), size + len(h)
        if size > 1_000_000:
            if before[0]:
                yield found(*before)
            before, held, docs, size = (held, docs), [], 0, 0
    if before[0] or held:
        yield found(before[0] + held, before[1] + docs)


def _count(candidates: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if candidates is None else candidates.value
        total = None if known is None else np.zeros(len(known), np.int64)
        for batch in in_slices(batches):
            _, h, _ = shingles(batch.column(0).to_pylist())
            if known is None:
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
            elif len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        if total is not None:
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    return run


class Weights:
    """Inverse document frequencies of the frequent shingles, ascending by hash, and that of all others."""

    def __init__(self, rows: list[tuple[int, int]], docs: int):
        h, df = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], float)
        order = np.argsort(h)
        self.h, self.idf = h[order], np.log1p(docs / df[order])
        self.rare = math.log1p(SATURATE)

    def of(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.rare)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = self.h[at] == h
            idf[hit] = self.idf[at[hit]]
        return tf * idf


def weights(texts: DataFrame, most: int = MOST_CANDIDATES) -> Weights:
    """texts has one column. Shingles that reach the driver are in at least 1/SATURATE of the documents each, so there
    are at most SATURATE times as many as a document has on average."""
    docs = texts.count()
    shared = None
    with Scratch() as scratch:
        candidates = scratch.saved(texts.mapInArrow(_frequent_in_chunks, "h long").distinct(), "candidates")
        if candidates.limit(most + 1).count() <= most:
            found = np.sort(candidates.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
            shared = texts.sparkSession.sparkContext.broadcast(found)
    counts = texts.mapInArrow(_count(shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return Weights([tuple(r) for r in counts.where(F.col("n") * SATURATE > docs).collect()], docs)


class Sampler:
    """Improved consistent weighted sampling: for each of n samples, a shingle's gamma and uniform variables come from
    three disjoint parts of one product of its hash, each by a table of 65,536 draws."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
        self.r, self.log_c, self.beta, self.inverse = (x.astype(np.float32) for x in (r, np.log(c), beta, 1 / r))
        self.odd = rng.integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
        """A row of 32-bit samples for each document; documents without shingles have zeros."""
        out = np.zeros((n_docs, len(self.odd)), np.uint32)
        if not len(h):
            return out
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        sizes = np.diff(np.concatenate((first, [len(h)])))
        log_w, low = np.log(weight).astype(np.float32), np.uint64(0xFFFF)
        for j, odd in enumerate(self.odd):
            x = h * odd
            i = x >> np.uint64(48)
            r, beta = self.r.take(i, mode="clip"), self.beta.take((x >> np.uint64(32)) & low, mode="clip")
            t = np.floor(log_w * self.inverse.take(i, mode="clip") + beta)
            a = self.log_c.take((x >> np.uint64(16)) & low, mode="clip") - r * (t - beta + np.float32(1))
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
            least = least[np.concatenate(([True], doc[least[1:]] != doc[least[:-1]]))]  # ties: the smallest hash
            key = mix64(h[least] + M3 * (t[least].astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)))
            out[doc[least], j] = key >> np.uint64(32)
        return out


def _sketch(model: Broadcast):
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), model.value
        for batch in in_slices(batches):
            texts = batch.column("text").to_pylist()
            doc, h, tf = shingles(texts)
            sig = sampler.sample(doc, h, idf.of(h, tf), len(texts))
            keys = [blake2b(b" ".join(w), digest_size=16).digest() if (w := (t or "").encode("utf-8", "surrogatepass").lower().split()) else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "copy", "sig"]
            )

    return run


def _keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each row of samples in each band."""
    sig = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.zeros(sig.shape[:2], np.uint64)
    for j in range(ROWS):
        key = mix64(key * M3 + sig[:, :, j] + np.uint64(1))
    return mix64(key + np.arange(BANDS, dtype=np.uint64) * M3)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 4096):
        key = _keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(batch), -1))
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(key.reshape(-1).view(np.int64))], names=["id", "bucket"])


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, of input sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        n = len(batch)
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n else []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True) if n else ():
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _worth(bucket: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in different classes that are worth verifying, across the two sides if there are two. A pair that
    an earlier band holds too is left to that one."""
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(rows), -1)
    kind, side = rows.column("class").to_numpy(), rows.column("side").to_numpy()
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(p) or not len(q)
    if within:
        p = q = np.arange(len(rows))
    equal = np.zeros((len(p), len(q)), np.uint8)
    for column in sig.T:
        equal += column[p][:, None] == column[q][None, :]
    likely = (equal >= WORTH * sig.shape[1]) & (kind[p][:, None] != kind[q][None, :])
    i, j = np.nonzero(np.triu(likely, 1) if within else likely)
    i, j = p[i], q[j]
    if not len(i):
        return i, j
    keys = _keys(sig)
    band = int(np.argmax(keys[0] == np.int64(bucket).view(np.uint64)))
    first = np.ones(len(i), bool)
    for earlier in range(band):
        first &= keys[i, earlier] != keys[j, earlier]
    return i[first], j[first]


_ROW = {"id": "long", "bucket": "long", "chunk": "long", "class": "long", "side": "int"}


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk that are in a pair worth verifying."""
    for (bucket, _), rows in _groups(batches, "bucket", "chunk"):
        if len(rows) > 1:
            i, j = _worth(bucket, rows)
            if len(i):
                yield from rows.select(list(_ROW)).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()


def shared_weight(h: np.ndarray, w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Summed weight of the features that each two vectors have in common; the vectors lie one after another in h, each
    without repeats, and a feature weighs the same in all."""
    row = np.repeat(np.arange(len(size)), size)
    _, first, code, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    often = n > 1  # the others add to the diagonal only
    number, weight = np.cumsum(often) - 1, w[first[often]]
    keep = np.flatnonzero(often[code])
    keep = keep[np.argsort(code[keep], kind="stable")]
    col, row = number[code[keep]], row[keep]
    out = np.zeros((len(size), len(size)))
    for at in range(0, len(weight), WIDE):
        a, b = np.searchsorted(col, (at, at + WIDE))
        part = np.zeros((len(size), min(WIDE, len(weight) - at)))
        part[row[a:b], col[a:b] - at] = 1
        out += (part * weight[at : at + WIDE]) @ part.T
    return out


def _links_in_chunks(model: Broadcast):
    """Links (a, b) that join the rows of a chunk to classes, a row for each text but one of a class; every pair of the
    chunk is verified. The most linked text of the chunk comes as (a, null) with its number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (bucket, _), rows in _groups(batches, "bucket", "chunk"):
            ids, kind = rows.column("id").to_numpy(), rows.column("class").to_numpy()
            n, h, w = features(*(rows.column(c).combine_chunks() for c in ("h", "tf")), model.value)
            size = np.bincount(n, minlength=len(ids))
            total = np.bincount(n, w, len(ids))
            common = shared_weight(h, w, size)
            alike = common >= SIMILAR * (1 - 1e-12) * (total[:, None] + total[None, :] - common)
            degree = alike.sum(axis=1)
            alike |= kind[:, None] == kind[None, :]
            label = np.arange(len(ids))
            while True:  # the least number that links lead to
                low = np.minimum(np.where(alike, label[None, :], len(ids)).min(axis=1), label)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            out += [(bucket, int(ids[r]), int(ids[x]), 0) for x, r in enumerate(label.tolist()) if x != r and kind[x] != kind[r]]
            if degree.max():
                out.append((bucket, int(ids[degree.argmax()]), None, int(degree.max())))
            if len(out) > 10_000:
                yield _link_rows(out)
                out = []
        yield _link_rows(out)
        release()

    return run


_LINK = "bucket long, a long, b long, degree long"


def _link_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "a", "b", "degree"])


def features(h: pa.ListArray, tf: pa.ListArray, model: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number, feature, weight): a shingle that occurs n times is n features of its weight, so that the smaller of
    two frequencies is the number of features in common."""
    row = np.repeat(np.arange(len(h)), np.diff(h.offsets.to_numpy()))
    h, tf = h.flatten().to_numpy().view(np.uint64), tf.flatten().to_numpy()
    idf = model.of(h, np.ones(len(h)))
    if len(tf) and tf.max() > 1:
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        row, h, idf = (np.repeat(x, tf) for x in (row, h, idf))
        h = np.where(level > 0, mix64(h + M3 * level.astype(np.uint64)), h)
    return row, h, idf


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        doc, h, tf = shingles(batch.column("text").to_pylist())
        cut = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (h.view(np.int64), tf.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "h", "tf"])


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller over sum of larger weights of two vectors, each by distinct feature."""
    _, i, j = np.intersect1d(ha, hb, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum(dtype=float))
    total = float(wa.sum(dtype=float) + wb.sum(dtype=float)) - low
    return low / total if total else 0.0


def _verify(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sides = []
            for x in "ab":
                n, h, w = features(batch.column("h" + x), batch.column("tf" + x), model.value)
                cut = np.searchsorted(n, np.arange(len(batch) + 1))
                sides.append([(h[i:j], w[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)])
            ok = [weighted_jaccard(*a, *b) >= SIMILAR for a, b in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, class) of every end of a link (a, b): the smallest id that links lead to.

    Each round takes the least class among neighbours, then the class of that class; a round is a written table."""
    both = scratch.saved(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    state = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("class")).withColumn("class", F.least("id", "class"))
    state = scratch.saved(state, "classes")
    while True:
        seen = both.join(state.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("low"))
        low = scratch.saved(state.join(seen, "id").select("id", F.least("class", "low").alias("low"), F.col("class").alias("was")), "classes")
        jump = state.select(F.col("id").alias("low"), F.col("class").alias("far"))
        after = scratch.saved(low.join(jump, "low", "left").select("id", F.least("low", "far").alias("class"), "was"), "classes")
        scratch.drop(low, state)
        if not after.where("class <> was").limit(1).count():
            scratch.drop(both)
            return after
        state = after


def _meetings(rows: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, bucket, chunk, class, side, sig) that bring any two of a bucket's members of different classes into one
    task (chunk), of about CHUNK members on each side.

    Members of a bucket's largest class don't meet each other, so they are sent only to the parts of the others."""
    sizes = rows.groupBy("bucket", "class").count()
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("count", "class")).alias("top"), F.sum("count").alias("n")).where("n > top.count")
    tops = tops.select(
        "bucket", F.col("top.class").alias("top"), F.ceil(F.col("top.count") / CHUNK).alias("tops"),
        F.ceil((F.col("n") - F.col("top.count")) / CHUNK).alias("rest"),
    )
    is_top = F.col("class") == F.col("top")
    rows = rows.join(scratch.saved(tops, "tops"), "bucket").join(own, "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.when(is_top, F.col("tops")).otherwise(F.col("rest"))))

    def task(kind: int, i, j):
        return F.lit(kind << 60) + F.shiftleft(i, 30) + j

    part, others = F.col("part"), F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)
    top_parts = F.sequence(F.lit(0).cast("long"), F.col("tops") - 1)
    to = F.when(is_top, F.transform(others, lambda j: F.struct(task(1, part, j).alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(others, lambda j: F.struct(task(0, F.least(part, j), F.greatest(part, j)).alias("chunk"), (j < part).cast("int").alias("side"))),
            F.transform(top_parts, lambda t: F.struct(task(1, t, part).alias("chunk"), F.lit(1).alias("side"))),
        )
    )
    return rows.select("id", "bucket", "class", "sig", F.explode(to).alias("to")).select("id", "bucket", "to.chunk", "class", "to.side", "sig")


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "id")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id) of every document row; the class is named by its smallest id, which must be a long.

    Documents whose words are equal are one text. Texts of weighted Jaccard similarity 0.8 and more are linked, and
    classes are what links connect. Texts without words (null, empty, blank) are classes of their own. Rows that
    share an id count as one document. A null id has a null class. No documents give no rows. A text of any length is
    one vector; other columns of the documents, whatever their names, play no part.

    A bucket of over CHUNK texts sends rows that grow with the square of those outside its largest class."""
    spark = bounded(docs).sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    model = spark.sparkContext.broadcast(weights(texts.select("text")))
    with Scratch() as scratch:
        sketches = scratch.saved(texts.mapInArrow(_sketch(model), "id long, copy binary, sig binary"), "sketches")
        reps = sketches.where("copy is not null").groupBy("copy").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
        reps = scratch.saved(reps, "representatives")
        copies = scratch.saved(sketches.select("id", "copy"), "copies")
        scratch.drop(sketches)
        own = reps.select("id", "sig")
        links = _links(texts, own, model, scratch)
        found = components(links, scratch).select("id", "class") if links is not None else reps.select("id", F.col("id").alias("class"))
        rows = copies.join(reps.select("copy", F.col("id").alias("rep")), "copy", "left")
        rows = rows.select("id", F.coalesce("rep", "id").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
        rows = saved(rows.select(F.col("id").alias(id_col), F.coalesce("class", "rep").alias("class_id")), "classes")
    return rows.unionByName(docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long"), F.lit(None).cast("long").alias("class_id")))


def _links(texts: DataFrame, own: DataFrame, model: Broadcast, scratch: Scratch) -> DataFrame | None:
    """Verified links (a, b) between texts of different words, enough of them to connect what is alike; None if no two
    texts share a bucket."""
    buckets = own.mapInArrow(_bands, "id long, bucket long")
    shared = scratch.saved(buckets.groupBy("bucket").count().where("count > 1"), "buckets")
    parts = F.ceil(F.col("count") / CHUNK)
    members = buckets.join(shared, "bucket").select("id", "bucket", F.pmod(F.xxhash64("id"), parts).alias("chunk"), (parts > 1).alias("big"))
    members = scratch.saved(members, "members")
    alone = members.select("id", "bucket", "chunk", F.col("id").alias("class"), F.lit(0).alias("side"))
    schema = ", ".join(f"{k} {v}" for k, v in _ROW.items())
    involved = scratch.saved(_by_chunk(alone.join(own, "id")).mapInArrow(_involved, schema), "involved")
    if not involved.limit(1).count():
        return None

    def vectors_of(rows: DataFrame) -> DataFrame:
        some = rows_of(texts, rows.select("id").distinct(), ["id"])
        return scratch.saved(some.mapInArrow(_vectors, "id long, h array<long>, tf array<int>"), "vectors")

    def linked(rows: DataFrame, vectors: DataFrame) -> DataFrame:
        return scratch.saved(_by_chunk(rows.join(vectors, "id")).mapInArrow(_links_in_chunks(model), _LINK), "met")

    vectors = vectors_of(involved)
    met = linked(involved, vectors)
    links = met.where("b is not null").select("a", "b")
    large = members.where("big")
    if not large.limit(1).count():
        return links

    # buckets of several chunks: each text and the most linked text of most of its buckets, then what is still apart
    scratch.drop(vectors)
    large = scratch.saved(large, "large")
    pivots = met.where("b is null").groupBy("bucket").agg(F.max_by("a", F.struct("degree", "a")).alias("pivot"))
    to = large.join(pivots, "bucket").where("id <> pivot").groupBy("id", "pivot").count()
    to = to.groupBy("id").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    to = scratch.saved(to.select(F.col("pivot").alias("a"), F.col("id").alias("b")), "central")
    vectors = vectors_of(to.select(F.explode(F.array("a", "b")).alias("id")))
    a, b = (vectors.select(F.col("id").alias(x), F.col("h").alias("h" + x), F.col("tf").alias("tf" + x)) for x in "ab")
    central = to.join(a, "a").join(b, "b").select("a", "b", "ha", "tfa", "hb", "tfb").mapInArrow(_verify(model), "a long, b long")
    links = scratch.saved(links.union(central).distinct(), "verified")
    scratch.drop(vectors)
    found = components(links, scratch)
    labelled = large.join(found, "id", "left").select("id", "bucket", F.coalesce("class", "id").alias("class"))
    meetings = _meetings(scratch.saved(labelled, "labelled"), own, scratch)
    involved = scratch.saved(_by_chunk(meetings).mapInArrow(_involved, schema), "involved")
    more = linked(involved, vectors_of(involved)).where("b is not null").select("a", "b")
    return scratch.saved(links.union(more), "more")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept whatever their names, whose id is their class's smallest; rows that share that id
    all stay, and so do rows without an id."""
    found = classes(docs, id_col=id_col, text_col=text_col)
    gone = saved(found.where(F.col(id_col) != F.col("class_id")).select(id_col).distinct(), "gone")
    return rows_of(docs, gone, [id_col], how="left_anti").select(docs.columns)  # texts aren't shuffled for a few ids


def op5(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of every document; one document of each class is kept. See classes()."""
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
