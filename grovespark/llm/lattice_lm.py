"""Subword lattice likelihood: the probability of a text under a unigram piece vocabulary, summed over every way to cut
its words into pieces.

The pieces are those of an existing public vocabulary and their first scores follow its order; expectation-
maximisation over the training words, each with its number of tokens, refines the scores. A word's paths are summed by
forward recursion in log space. Beside that score stands another, which also has an edge over the whole word, weighted
by how often the training texts have it. Words are counted over all documents. The most frequent words, a bounded
number, are broadcast; the others meet their scores in a join on the word, in which no key is hot because the hot ones
are already served."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_slices, saved

#: A word with at least this share of all tokens is broadcast; there can't be more than its inverse of them.
HEAD_SHARE = 1 / 250_000
#: Word forms that a task counts before it hands them on.
FLUSH = 500_000
#: Stands for the end of a text: a token that no word can equal.
END = " "
_LOG10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def piece_vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Pieces that start a word and pieces that continue one, each in the vocabulary's order of preference."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i))]
    first = dict.fromkeys(p[1:] for p in pieces if p.startswith("▁") and len(p) > 1 and "▁" not in p[1:] and p[1:] == fold(p[1:]))
    rest = dict.fromkeys(p for p in pieces if "▁" not in p and p == fold(p))
    return list(first), list(rest)


def fold(s: str) -> str:
    return s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Lattice:
    """Log probabilities of pieces: `first` may start a word, `rest` continue it, `stop` ends it.

    Both sets also hold a fallback for any single code point: its probability spread over 2**20 of them, so every
    string has a path. With stop, each set's probabilities sum to at most one, and so do those of all words."""

    OTHER = -20 * math.log(2)

    def __init__(self, first: dict[str, float], rest: dict[str, float], other: tuple[float, float], stop: float):
        self.first, self.rest, self.other, self.stop = first, rest, other, stop
        self.longest = max(map(len, [*first, *rest, "x"]))

    @classmethod
    def ranked(cls, first: list[str], rest: list[str]) -> Lattice:
        """Scores that fall with the rank, as word frequencies do."""

        def scores(pieces: list[str], room: float) -> dict[str, float]:
            total = sum(1 / (k + 10) for k in range(len(pieces))) or 1
            return {p: math.log(room / ((k + 10) * total)) for k, p in enumerate(pieces)}

        return cls(scores(first, 0.99), scores(rest, 0.59), (math.log(0.01), math.log(0.01)), math.log(0.4))

    @classmethod
    def counted(cls, first: list[str], rest: list[str], counts: dict[tuple[int, str], float], words: float) -> Lattice:
        """Scores from expected counts, each piece having a tenth of a count besides; pieces are keyed (0 or 1, piece)
        and the fallback is piece ''."""

        def scores(kind: int, pieces: list[str], more: float) -> tuple[dict[str, float], float, float]:
            got = {p: counts.get((kind, p), 0.0) + 0.1 for p in ["", *pieces]}
            total = sum(got.values()) + more
            return {p: math.log(n / total) for p, n in got.items() if p}, math.log(got[""] / total), total

        a, other_a, _ = scores(0, first, 0.0)
        b, other_b, total = scores(1, rest, words + 0.1)
        return cls(a, b, (other_a, other_b), math.log((words + 0.1) / total))

    def edges(self, word: str, start: int) -> list[tuple[int, float, str]]:
        """(end, log probability, piece) of the pieces that lie at start."""
        table = self.rest if start else self.first
        out = [(start + 1, self.other[start > 0] + self.OTHER, "")]
        for end in range(start + 1, min(len(word), start + self.longest) + 1):
            if (p := table.get(word[start:end])) is not None:
                out.append((end, p, word[start:end]))
        return out

    def forward(self, word: str) -> list[float]:
        """Log of the summed probability of all paths to each position."""
        alpha = [0.0] + [-math.inf] * len(word)
        first, rest, longest, exp, log = self.first, self.rest, self.longest, math.exp, math.log
        n, fall = len(word), (self.other[0] + self.OTHER, self.other[1] + self.OTHER)
        for start in range(n):
            base, table = alpha[start], rest if start else first
            for end in range(start + 1, min(n, start + longest) + 1):
                p = table.get(word[start:end])
                if end == start + 1:
                    q = base + fall[start > 0]
                    p = q if p is None else (base + p) + log(1 + exp(q - base - p))
                elif p is None:
                    continue
                else:
                    p += base
                a = alpha[end]
                alpha[end] = p if a == -math.inf else (p + log(1 + exp(a - p)) if p > a else a + log(1 + exp(p - a)))
        return alpha

    def score(self, word: str) -> float:
        """Log probability of the word, over all its segmentations."""
        return self.forward(word)[-1] + self.stop

    def expect(self, word: str, n: float, counts: dict[tuple[int, str], float]) -> None:
        """Add n times the expected uses of each piece in the word."""
        alpha = self.forward(word)
        beta = [-math.inf] * len(word) + [0.0]
        for start in range(len(word) - 1, -1, -1):
            for end, p, piece in self.edges(word, start):
                q = p + beta[end]
                b = beta[start]
                beta[start] = q if b == -math.inf else (q + math.log1p(math.exp(b - q)) if q > b else b + math.log1p(math.exp(q - b)))
                key = (int(start > 0), piece)
                counts[key] = counts.get(key, 0.0) + n * math.exp(alpha[start] + q - alpha[-1])


class Blocks:
    """A lattice over many words at once: words of one length are rows of a matrix, and each cut point is one array
    operation over them. Longer words go one by one."""

    LONGEST, CELLS = 24, 2_000_000
    #: A table of 2**20 flags says for most strings that no piece has their hash, before the exact search.
    SIFT, SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(44)

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.tables = []
        for kind, pieces in enumerate((lattice.first, lattice.rest)):
            names = list(pieces)
            h = np.array([self.hash_of(p) for p in names], np.uint64)
            order = np.argsort(h)
            values = np.array([pieces[names[i]] for i in order.tolist()])
            sieve = np.zeros(1 << 20, bool)
            sieve[(h * self.SIFT) >> self.SHIFT] = True
            self.tables.append((h[order], values, [(kind, names[i]) for i in order.tolist()], sieve))

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Places of words in the list, with their code points as rows; None for a word of over LONGEST."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > self.LONGEST:
                for i in at:
                    yield at[at == i], None
                continue
            step = max(64, self.CELLS // (n * min(n, self.lattice.longest) + 1))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                text = "".join(map(words.__getitem__, part.tolist())).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(text, np.uint32).reshape(-1, n).astype(np.uint64)

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, rows that have a piece there, its log probability, its place in the table) for all cut points."""
        n = codes.shape[1]
        for start in range(n):
            known, values, _, sieve = self.tables[start > 0]
            h = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(n, start + self.lattice.longest) + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, end - 1] + np.uint64(1)
                rows = np.flatnonzero(sieve[(h * self.SIFT) >> self.SHIFT])
                at = np.searchsorted(known, h[rows]) if len(known) else rows[:0]
                at = np.minimum(at, len(known) - 1)
                same = known[at] == h[rows]
                at = at[same]
                yield start, end, rows[same], values[at], at

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        fall = [x + self.lattice.OTHER for x in self.lattice.other]
        alpha = np.full((codes.shape[1] + 1, len(codes)), -np.inf)
        alpha[0] = 0
        for start, end, rows, p, _ in edges:
            if end == start + 1:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + fall[start > 0])
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + p)
        return alpha

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at, codes in self.groups(words):
            out[at] = self.lattice.score(words[at[0]]) if codes is None else self.forward(codes, list(self.edges(codes)))[-1] + self.lattice.stop
        return out

    def expect(self, words: list[str], times: np.ndarray, counts: dict[tuple[int, str], float]) -> None:
        """Add the expected uses of each piece in the words, each of which occurs so many times."""
        totals = [np.zeros(len(t[0])) for t in self.tables]
        fall = [x + self.lattice.OTHER for x in self.lattice.other]
        for where, codes in self.groups(words):
            if codes is None:
                self.lattice.expect(words[where[0]], float(times[where[0]]), counts)
                continue
            edges, n = list(self.edges(codes)), times[where].astype(float)
            alpha, beta = self.forward(codes, edges), np.full((codes.shape[1] + 1, len(codes)), -np.inf)
            beta[-1] = 0
            for start, end, rows, p, at in reversed(edges):
                kind = int(start > 0)
                out = beta[end, rows] + p
                uses = n[rows] * np.exp(out + alpha[start, rows] - alpha[-1, rows])
                totals[kind] += np.bincount(at, uses, len(totals[kind]))
                if end == start + 1:
                    single = beta[end] + fall[kind]
                    uses = (n * np.exp(single + alpha[start] - alpha[-1])).sum()  # no product of vectors: BLAS threads spin
                    counts[kind, ""] = counts.get((kind, ""), 0.0) + float(uses)
                    beta[start] = np.logaddexp(beta[start], single)
                beta[start, rows] = np.logaddexp(beta[start, rows], out)
        for total, (_, _, names, _) in zip(totals, self.tables, strict=True):
            for i in np.flatnonzero(total).tolist():
                counts[names[i]] = counts.get(names[i], 0.0) + float(total[i])


def _count(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, train = Counter(), Counter()

        def batch_of() -> pa.RecordBatch:
            keys = list(seen)
            arrays = [
                pa.array([w.decode("utf-8", "surrogatepass") for w in keys], pa.string()),
                pa.array([seen[w] for w in keys], pa.int64()), pa.array([train[w] for w in keys], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n", "c"])

        for batch in in_slices(batches):
            for doc_id, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                words = words_of(text)
                seen.update(words)
                seen[END.encode()] += 1
                if not held_out(doc_id):
                    train.update(words)
                    train[END.encode()] += 1
            if len(seen) > FLUSH:
                yield batch_of()
                seen.clear()
                train.clear()
        if seen:
            yield batch_of()

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n, c): its tokens in all documents and in training ones, the end of a text as END."""
    parts = docs.select(id_col, text_col).mapInArrow(_count(id_col, text_col), "word string, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(counts: DataFrame, *, path: str | None = None, rounds: int = 2) -> Lattice:
    """Piece scores by expectation-maximisation over the training texts' words, weighted by their tokens; the expected
    counts that reach the driver are as many as the vocabulary has pieces."""
    spark, (first, rest) = counts.sparkSession, piece_vocabulary(path)
    lattice = Lattice.ranked(first, rest)
    train = counts.where((F.col("c") > 0) & (F.col("word") != END)).select("word", "c")
    words = int(train.agg(F.sum("c")).collect()[0][0] or 0)
    for _ in range(rounds if words else 0):
        shared = spark.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, str], float] = {}
            blocks = Blocks(shared.value)
            for batch in batches:
                blocks.expect(batch.column("word").to_pylist(), batch.column("c").to_numpy(), found)
            kinds, pieces = [k for k, _ in found], [p for _, p in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(pieces, pa.string()), pa.array(found.values(), pa.float64())], names=["kind", "piece", "n"]
            )

        got = train.mapInArrow(run, "kind int, piece string, n double").groupBy("kind", "piece").agg(F.sum("n")).collect()
        lattice = Lattice.counted(first, rest, {(r[0], r[1]): r[2] for r in got}, words)
    return lattice


class Model:
    """Per token, in log10: base from counts alone; score from the lattice; mixed from the lattice with the whole-word edge.

    A text's end competes with its words. The edge has the word's share of the training tokens after a discount from its
    count; the discounts of all words together are then the weight of the lattice."""

    def __init__(self, lattice: Lattice, total: int, distinct: int, once: int, twice: int, ends: int):
        self.lattice, self.total = lattice, total
        self.norm = math.log(total + 0.5 * (distinct + 1))
        self.discount = (once + 1) / (once + 2 * twice + 2)
        self.pieces = math.log(self.discount * distinct / total if total else 1.0)
        self.end = (ends + 0.5) / (total + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (np.log(c + 0.5) - self.norm) / _LOG10

    def score(self, blocks: Blocks, words: list[str], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and mixed score of each word; the end is END."""
        paths, more = blocks.scores(words), math.log1p(-self.end)
        edge = np.log(np.maximum(c - self.discount, 1e-300) / max(self.total, 1))
        mixed = np.where(c > 0, np.logaddexp(edge, self.pieces + more + paths), self.pieces + more + paths)
        ends = np.array([w == END for w in words], bool)
        return tuple(np.where(ends, math.log(self.end), x) / _LOG10 for x in (more + paths, mixed))


def _lexicon(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(model.value.lattice)
        for batch in in_slices(batches, 10_000):
            score, mixed = model.value.score(blocks, batch.column("word").to_pylist(), batch.column("c").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(score), pa.array(mixed)], names=["word", "c", "score", "mixed"])

    return run


def _emit(id_col: str, text_col: str, head):
    """A row of sums over frequent words for each document, and one for each other word of it."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = head.value, TaskContext.get().partitionId() << 40
        end = table[END.encode()]
        for batch in in_slices(batches):
            out: list[tuple] = []
            ids: list[int | None] = []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                words, row = words_of(text), row + 1
                known, base, score, mixed = int(end[0] > 0), *end[1:]
                for w, n in Counter(words).items():
                    got = table.get(w)
                    if got:
                        known, base, score, mixed = known + n * (got[0] > 0), base + n * got[1], score + n * got[2], mixed + n * got[3]
                    else:
                        out.append((row, w.decode("utf-8", "surrogatepass"), n, 0, 0.0, 0.0, 0.0))
                        ids.append(None)
                out.append((row, f" {row}", -1 - len(words), known, base, score, mixed))  # no word has a blank
                ids.append(k)
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            arrays = [batch.column(id_col).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "word", "n", "k0", "b0", "s0", "m0"])

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rounds: int = 2, head_share: float | None = None) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every document row: score is the
    lattice's log10 probability of the whole text, mixed_score that of the lattice with an edge over each known word.

    Words of head_share (HEAD_SHARE) of the tokens are broadcast. Rows that share an id are scored each; a text of any length is read
    whole; other columns, whatever their names, play no part; no documents give no rows. Training texts are those whose crc32(id as text) mod 5 is not 1, or that have no id. A null text is empty: one token, its end.
    Without training texts no word is known and the pieces keep their first scores."""
    spark = bounded(docs).sparkSession
    counts = saved(count_words(docs, id_col=id_col, text_col=text_col), "words")
    facts = counts.agg(
        F.sum("c"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)), F.sum((F.col("c") == 1).cast("long")),
        F.sum((F.col("c") == 2).cast("long")),
        F.sum(F.when(F.col("word") == END, F.col("c"))), F.sum("n"),
    ).collect()[0]
    total, distinct, once, twice, ends, tokens = (int(x or 0) for x in facts)
    model = Model(fit(counts, path=path, rounds=rounds), total, distinct, once, twice, ends)
    frequent = F.col("n") >= max(1, math.ceil(tokens * (head_share or HEAD_SHARE)))
    rows = [tuple(r) for r in counts.where(frequent | (F.col("word") == END)).select("word", "c").collect()] or [(END, 0)]
    words, c = [r[0] for r in rows], np.array([r[1] for r in rows])
    scores = (x.tolist() for x in (c, model.base(c), *model.score(Blocks(model.lattice), words, c)))
    head = dict(zip((w.encode("utf-8", "surrogatepass") for w in words), zip(*scores, strict=True), strict=True))
    shared, table = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(head)
    tail = counts.where(~frequent & (F.col("word") != END)).select("word", "c")
    lexicon = tail.mapInArrow(_lexicon(shared), "word string, c long, score double, mixed double")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, row long, word string, n long, k0 long, b0 double, s0 double, m0 double"
    rows = docs.select(id_col, text_col).mapInArrow(_emit(id_col, text_col, table), schema)
    word = F.col("n") > 0
    joined = rows.join(lexicon, "word", "left")

    def total_of(own, per_word):
        return F.sum(F.when(word, F.col("n") * per_word).otherwise(F.col(own)))

    out = joined.groupBy("row").agg(
        F.max(F.when(~word, F.col("id"))).alias(id_col), F.max(F.when(~word, -F.col("n"))).alias("n_tokens"),
        total_of("k0", (F.col("c") > 0).cast("long")).alias("n_known"),
        total_of("b0", (F.log(F.col("c") + 0.5) - model.norm) / _LOG10).alias("base_score"),
        total_of("s0", F.col("score")).alias("score"), total_of("m0", F.col("mixed")).alias("mixed_score"),
    )
    return out.select(id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "mixed_score")


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's row for each document; see score()."""
    out = score(docs, path=path)
    mark = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    return out.select("doc_id", mark.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")
