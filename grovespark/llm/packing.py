"""Best-fit packing of tokenised documents into sequences under several capacities at once.

Tokens, document count and attention cost (the sum of squared piece lengths) are the dimensions of a vector bin
packing, and all of them weigh in the choice of a sequence. Pieces are dealt to blocks by their place in the table, so
that repeated ids don't meet; a block has a bounded number of pieces, or of tokens where pieces are short, and is
packed by vector best fit in descending length. Blocks are independent: a block of hundreds of sequences leaves a few
of them part empty, a share that does not grow with the data."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded, in_slices, saved

#: Pieces that one task packs together, and full sequences that it makes of them at least.
BLOCK, LEAST_SEQUENCES = 16_384, 256
#: Weights of the free tokens, documents and attention cost of a sequence when one is chosen for a piece.
WEIGHTS = (1.0, 0.1, 0.1)
#: Word forms whose ids a Python worker keeps; beyond it, it keeps the quarter that it met first.
CACHED = 300_000
_kept: dict[int, tuple] = {}
_TAIL = ".,!?:;*%&$#|"


def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


_BYTE = _byte_letters()


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file's content; by default the public word-end BPE of 49,408 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer never joins across white space, so a text's ids are those of its blank-separated chunks, and a
    chunk that ends in ASCII punctuation after a letter is the chunk before it and that tail. Chunks recur, so their
    ids are kept."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.ids: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}

    @staticmethod
    def parts(chunk: str) -> tuple[str, str]:
        core = chunk.rstrip(_TAIL)
        if not core or not core[-1].isalpha() or not unicodedata.normalize("NFC", core).lower()[-1].isalpha():
            core = chunk  # a mark, which some letters are split into, joins the punctuation
        tail = chunk[len(core) :]
        return (core.lower() if core.isascii() and core.isalpha() else core), tail

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) > CACHED:
            self.ids, self.cores = (dict(islice(x.items(), CACHED // 4)) for x in (self.ids, self.cores))
            raise KeyError
        split = [(c, *self.parts(c)) for c in chunks]
        new = {x for _, core, tail in split for x in (core, tail) if x not in self.cores}
        for x in list(new):
            if x.isalpha() and unicodedata.is_normalized("NFC", x):
                seen = x.lower() if x.isascii() else "".join(c.lower() for c in x)
                if seen.isalpha():  # one word of letters: only the merges are left to do
                    if not seen.isascii():
                        seen = seen.encode().decode("latin-1").translate(_BYTE)
                    self.cores[x] = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
                    new.discard(x)
        new = list(new)
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cores[x] = np.array(e.ids, "<u4").tobytes()
        for c, core, tail in split:
            self.ids[c] = self.cores[core] + self.cores[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.ids)
        if new:
            try:
                self.learn(new)
            except KeyError:
                self.learn(set().union(*split).difference(self.ids))
        get = self.ids.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


def encoder(spec: str) -> Encoder:
    """This worker's encoder for a vocabulary."""
    key = zlib.crc32(spec.encode())
    if key not in _kept:
        _kept[key] = (Encoder(spec),)
    return _kept[key][0]


def _pieces(spec, id_col: str, text_col: str, end_id: int, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(spec.value), int(end_id).to_bytes(4, "little")
        for batch in in_slices(batches):
            rows: list[tuple] = []
            for row, ids in enumerate(enc.encode(batch.column(text_col).to_pylist())):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[a : a + 4 * most]
                    rows.append((row, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            row, k, start, length, crc, part = zip(*rows, strict=True)
            arrays = [
                batch.column(id_col).take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def tokenise(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1,
    most: int = 4096, with_ids: bool = False,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then end_id, cut after each
    `most`. A null or empty text is the single end id. Ids of documents may repeat; each row is cut on its own."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    spec = bounded(docs).sparkSession.sparkContext.broadcast(tokenizer_json(path))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(_pieces(spec, id_col, text_col, end_id, most, with_ids), schema)


def best_fit(needs: np.ndarray, capacity: np.ndarray, rule: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each piece, which come in descending length.

    Among open bins that can take the piece under every capacity, rule "norm" takes the one whose weighted residual
    after placing is smallest; "dot" the one whose residual has the largest weighted product with the need. The
    earliest bin wins ties. A piece that fits no bin opens one."""
    scaled, n = needs / capacity, len(needs)
    free = np.empty((n, needs.shape[1]))
    which, bins, used = np.empty(n, np.int64), np.empty(n, np.int64), 0
    offset, filled, count = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    least = scaled.min(axis=0) if n else scaled
    eps = 1e-12
    for i in range(n):
        need = scaled[i]
        open_, best = free[:used], -1
        fits = np.flatnonzero(open_[:, 0] >= need[0] - eps)
        if len(fits):
            left = open_[fits]
            fits, left = (x[(left >= need - eps).all(axis=1)] for x in (fits, left))
        if len(fits):
            score = (((left - need) ** 2) @ weights) if rule == "norm" else -(left * need) @ weights
            best = int(fits[np.argmin(score)])
        if best < 0:
            best, used = used, used + 1
            free[best], which[best] = 1.0, count
            count += 1
        free[best] -= need
        b = which[best]
        bins[i], offset[i] = b, filled[b]
        filled[b] += int(needs[i, 0])
        if (free[best] < least - eps).any():  # nothing fits any more
            free[best : used - 1] = free[best + 1 : used]
            which[best : used - 1] = which[best + 1 : used]
            used -= 1
    return bins, offset


def pack(
    pieces: DataFrame, *, max_tokens: int = 4096, max_docs: int | None = None, max_cost: float | None = None,
    rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, block: int = BLOCK,
) -> DataFrame:
    """The pieces with sequence_id and offset added; no sequence exceeds max_tokens tokens, max_docs pieces or max_cost
    attention cost (unset: what max_tokens pieces or one full piece need, which binds nothing).

    Needs columns id, piece and length, 1 <= length <= max_tokens; any others stay, but for sequence_id and offset, which
    are replaced. pieces is read twice; give it saved. No pieces give no rows. Ties in length go by id and piece, and
    repeated rows are packed each. The earliest sequence wins ties between sequences."""
    assert rule in ("norm", "dot")
    capacity = np.array([max_tokens, max_docs or max_tokens, max_cost or float(max_tokens) ** 2], float)
    shares = np.array(weights)
    pieces = pieces.drop("sequence_id", "offset")
    n, tokens = pieces.agg(F.count("*"), F.sum("length")).collect()[0]
    n_blocks = max(1, min(-(-n // block), (tokens or 0) // (max_tokens * LEAST_SEQUENCES)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["__block"]).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        size = table.column("length").to_numpy().astype(float)
        bins, offset = best_fit(np.stack([size, np.ones(len(size)), size**2], 1), capacity, rule, shares)
        return table.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins)).append_column("offset", pa.array(offset))

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("long"))
    return dealt.groupBy("__block").applyInArrow(run, schema)


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's row for each piece; see tokenise() and pack()."""
    return pack(saved(tokenise(docs, path=path), "pieces")).withColumnRenamed("id", "doc_id")
