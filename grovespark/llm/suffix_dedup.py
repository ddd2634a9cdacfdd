"""Suffix-array dedup: bytes that lie in a long string found twice, by merging shard Burrows-Wheeler transforms.

Which strings can recur at all is settled by hashes first. Every WIDTH-byte window selects an anchor, the GRAM-byte
string of least hash in it, and so do all equal windows, at the same place in them. Anchors found once rule out their
windows. An anchor's context holds all windows that select it; equal contexts are repeats throughout. What is left are
contexts of a shared anchor that differ somewhere, around the ends of repeats. Each is cut to the bytes that some
other one has on either side of the anchor, as no window beyond them can recur; equal cuts are repeats throughout too,
and one stands for all. Their suffixes are ordered in shards, and the shards' transforms are merged: the interleave of
the shards is refined by distributing the merged transform's symbols stably, which sorts by one symbol more each round,
and the block boundaries that appear in a round are the common prefixes of that length (no suffix is compared again).
Blocks after WIDTH bytes are the repeated intervals.

Anchors with many differing contexts, such as the edge of a passage that a third of all documents share, are never
gathered. Their contexts are sorted by what follows the anchor, and by what precedes it, read backwards. Common prefixes
with the neighbours in either order prove windows to be repeated and bound which others can be; only what lies between
the two is counted by hash."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import MOST_IDS, M3, Scratch, bounded, in_slices, mix64, release, rows_of, saved

WIDTH, GRAM = 400, 200
SIDE = WIDTH - GRAM
#: Bytes of one symbol of the transforms; divides WIDTH.
SYMBOL = 50
#: Differing contexts of an anchor that are merged in one task; those of other anchors are sorted across tasks.
MOST_CONTEXTS = 512
#: Context bytes merged at once, and shards they are split into.
BATCH_BYTES, SHARDS = 1 << 19, 8
#: Bytes of a text whose anchors are looked for at once, and of texts that a task holds between rows it hands on.
SEGMENT, HELD_BYTES = 1 << 19, 1 << 21
_BASE = 0xD1342543DE82EF95
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Hashes:
    """Hashes of any substrings of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_power[0]) < n:
            for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, 1 << 16), b, np.uint64)
                steps[0] = 1
                _power[k] = np.cumprod(steps)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + M3) * _power[0][: n - 1])))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * _power[1][a])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, anchor hash, context hash, context start, context end) of each anchor of one text of WIDTH bytes or
    more. Among equal hashes the first in a window is its anchor. The text is read in segments."""
    parts, last, n = [], -1, len(data)
    for s in range(0, n - WIDTH + 1, SEGMENT):
        base = max(0, s - SIDE)
        hashes = Hashes(data[base : s + SEGMENT + 2 * WIDTH])
        at = np.arange(s, min(s + SEGMENT, n - WIDTH + 1) + SIDE) - base
        h = hashes.of(at, at + GRAM)
        order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(at), dtype=np.uint64)
        found = np.unique(_sliding_min(order, SIDE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pos = at[found] + base
        pos, h = pos[pos > last], h[found][pos > last]
        if len(pos):
            lo, hi, last = np.maximum(pos - SIDE, 0), np.minimum(pos + WIDTH, n), pos[-1]
            context = mix64(hashes.of(lo - base, hi - base) + M3 * (pos - lo).astype(np.uint64) + (hi - pos).astype(np.uint64))
            parts.append((pos, h, context, lo, hi))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _slices(batch: pa.RecordBatch, column: str, most: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of a text column, a row at least."""
    if not len(batch):
        return
    edge = np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)[batch.column(column).offset :][: len(batch) + 1]
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + most)))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "th", "anchor", "context", "lo", "hi", "at"]
    for whole in batches:
        for batch in _slices(whole, "text", SEGMENT):
            rows, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = _raw(text)
                if len(raw) >= WIDTH:
                    found.append(anchors(np.frombuffer(raw, np.uint8)))
                    rows.append(np.full(len(found[-1][0]), row))
            if found:
                take = pa.array(np.concatenate(rows))
                pos, anchor, context, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
                columns = [anchor.view(np.int64), context.view(np.int64), *(x.astype(np.int32) for x in (lo, hi, pos - lo))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), *map(pa.array, columns)], names=names)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable sorting order of non-negative integers, and the integers in that order."""
    bits = len(x).bit_length()
    if len(x) and int(x.max()) >> (63 - bits):
        order = np.argsort(x, kind="stable")
        return order, x[order]
    key = (x << bits) | np.arange(len(x))  # sorting values is cheaper than sorting places
    key.sort()
    return key & ((1 << bits) - 1), key >> bits


def _steps(x: np.ndarray) -> np.ndarray:
    """For each of some sorted values the number of different ones before it."""
    return np.cumsum(np.concatenate(([0], x[1:] != x[:-1])))


def _numbered(h: np.ndarray) -> np.ndarray:
    """Equal numbers from 0 on for equal hashes."""
    order, top = _sorted((h >> np.uint64(len(h).bit_length() + 1)).astype(np.int64))
    number = _steps(h[order])
    if number[-1] != _steps(top)[-1]:  # hashes that differ in their last bits only can alternate here
        return np.unique(h, return_inverse=True)[1]
    out = np.empty(len(h), np.int64)
    out[order] = number
    return out


class Shard:
    """A run of strings of symbols whose suffixes are in order; `bwt` has the symbol before each, 0 at a string's start.

    Strings lie one after the other, each with the empty suffix at its end, whose code is 0; `k` counts the symbols
    before a suffix and `left` those in it."""

    def __init__(self, code: np.ndarray, k: np.ndarray, left: np.ndarray):
        rank, step = code, 1
        while step * SYMBOL < WIDTH:  # double the prefix that ranks compare
            more = np.flatnonzero(left >= step)
            ahead = np.zeros(len(rank), np.int64)
            ahead[more] = rank[more + step]
            self.order, ranked = _sorted(rank * (int(rank.max()) + 1) + ahead)
            rank = np.empty(len(code), np.int64)
            rank[self.order] = _steps(ranked)
            step *= 2
        self.bwt = np.where(k[self.order] > 0, code[self.order - 1], 0)
        self.ends = int((code == 0).sum())


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards in order, as numbers counted through them, and the block of each: suffixes whose first
    WIDTH bytes are equal share one."""
    sizes = [len(s.order) for s in shards]
    offset = np.cumsum([0, *sizes])
    bwt = np.concatenate([s.bwt for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.int8), sizes)  # which shard the next suffix comes from
    ends = np.repeat(np.arange(len(shards), dtype=np.int8), [s.ends for s in shards])
    block = np.zeros(len(z), np.int64)

    def woven(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(z), np.int64)
        for j in range(len(shards)):
            out[z == j] = values[offset[j] : offset[j + 1]]
        return out

    for _ in range(WIDTH // SYMBOL):
        symbol = woven(bwt)
        inside = np.flatnonzero(symbol)
        order, c = _sorted(symbol[inside])
        order = inside[order]
        b = block[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (b[1:] != b[:-1]))) if len(order) else np.zeros(0, bool)
        z = np.concatenate((ends, z[order]))
        block = np.concatenate((np.zeros(len(ends), np.int64), np.cumsum(new)))
    suffixes = np.concatenate([s.order + o for s, o in zip(shards, offset[:-1], strict=True)])
    return woven(suffixes), block


def repeated_windows(contexts: list[bytes], where: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Offsets in each context of windows that occur elsewhere.

    where: a number for each context's first byte, such that equal numbers plus offsets are the same place; a context
    marked `many` occurs elsewhere as a whole."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    first = np.cumsum(size) - size
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(contexts)
    # a context is SYMBOL strings of symbols, one from each of its first bytes on; those shorter than WIDTH hold no window
    strings = np.clip(size - WIDTH + 1, 0, SYMBOL)
    of = np.repeat(np.arange(len(contexts)), strings)
    skip = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    symbols = (size[of] - skip) // SYMBOL
    left = np.repeat(np.cumsum(symbols + 1) - 1, symbols + 1) - np.arange(len(of) + int(symbols.sum()))
    if not len(left):
        return out
    k = np.repeat(symbols, symbols + 1) - left
    owner, start = np.repeat(of, symbols + 1), np.repeat(skip, symbols + 1) + k * SYMBOL
    at = start + first[owner]
    inside = at[left > 0]
    code = np.zeros(len(left), np.int64)
    code[left > 0] = _numbered(Hashes(data).of(inside, inside + SYMBOL)) + 1
    edges = np.searchsorted(owner, np.linspace(0, len(contexts), min(SHARDS, len(contexts)) + 1).astype(int))
    suffixes, block = merge([Shard(code[a:b], k[a:b], left[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a])
    full = left[suffixes] * SYMBOL >= WIDTH
    suffixes, block = suffixes[full], block[full]
    runs = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    place = where[owner[suffixes]] + start[suffixes]
    twice = np.minimum.reduceat(place, runs) != np.maximum.reduceat(place, runs)
    twice |= np.logical_or.reduceat(many[owner[suffixes]], runs)
    hit = np.sort(at[suffixes[np.repeat(twice, np.diff(np.concatenate((runs, [len(block)]))))]])
    found = np.searchsorted(first, hit, "right") - 1
    ends = np.flatnonzero(np.diff(found, append=-1)) + 1
    for a, b, i in zip([0, *ends[:-1].tolist()], ends.tolist(), found[ends - 1].tolist(), strict=True) if len(hit) else ():
        out[i] = hit[a:b] - first[i]
    return out


def _spans(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Unions of windows at ascending offsets."""
    if len(offsets) and offsets[-1] - offsets[0] <= WIDTH:
        return [(int(offsets[0]), int(offsets[-1]) + WIDTH)]
    cut = np.flatnonzero(np.diff(offsets) > WIDTH) + 1
    return [(int(p[0]), int(p[-1]) + WIDTH) for p in np.split(offsets, cut)] if len(offsets) else []


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each open context of each document, with its bytes from the anchor on and, backwards, before it."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]

    def rows_of_some(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "th", "anchor", "lo", "many", "hot", "bytes", "left"])

    out: list[tuple] = []
    for whole in batches:
        for batch in _slices(whole, "text"):
            for doc, th, text, open_ in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "text", "open")), strict=True):
                raw = _raw(text)
                for o in open_:
                    pos = o["lo"] + o["at"]
                    out.append((doc, th, o["anchor"], o["lo"], o["many"], o["hot"], raw[pos : o["hi"]], raw[o["lo"] : pos][::-1]))
                    if len(out) * 3 * SIDE >= HELD_BYTES:
                        yield rows_of_some(out)
                        out = []
    if out:
        yield rows_of_some(out)


def _bytes(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each value, and the values' lengths."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), size


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def _shared(anchor: np.ndarray, values: list[bytes]) -> np.ndarray:
    """Length of the longest prefix of each value, of SIDE bytes at most, that another one of its anchor has; -1 if there
    is no other."""
    order = np.array(sorted(range(len(values)), key=lambda i: (anchor[i], values[i])), np.int64)
    common = _common(*_bytes([values[i] for i in order], SIDE))
    common = np.where(anchor[order[1:]] == anchor[order[:-1]], common, -1)
    out = np.empty(len(values), np.int64)
    out[order] = np.maximum(np.append(common, -1), np.append(-1, common))
    return out


def cut_contexts(anchor: np.ndarray, heads: list[bytes], tails: list[bytes]) -> tuple[list[tuple[bytes, list[int]]], np.ndarray]:
    """Contexts, given by the bytes before their anchors, backwards, and from the anchors on, cut to what another one of
    the anchor has on either side: each different cut with the contexts it comes from, and the bytes before the anchor
    that a context's cut has. All contexts of an anchor are here. Those without a window that can recur are left out."""
    left, right = _shared(anchor, heads), _shared(anchor, [x[GRAM:] for x in tails])
    cuts: dict[tuple[int, int, bytes], list[int]] = {}
    for i in np.flatnonzero(left + right >= SIDE).tolist():
        cut = heads[i][: left[i]][::-1] + tails[i][: GRAM + right[i]]
        cuts.setdefault((int(anchor[i]), int(left[i]), cut), []).append(i)
    return [(cut, members) for (_, _, cut), members in cuts.items()], left


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the contexts of each anchor; a partition comes in order of anchors."""
    held: list[pa.RecordBatch] = []
    size = 0

    def found(table: pa.Table) -> pa.RecordBatch:
        many, lo = table.column("many").to_numpy(), table.column("lo").to_numpy()
        heads = table.column("left").to_pylist()
        cuts, before = cut_contexts(table.column("anchor").to_numpy(), heads, table.column("bytes").to_pylist())
        doc = {k: i for i, k in enumerate(dict.fromkeys(zip(table.column("id").to_pylist(), table.column("th").to_pylist(), strict=True)))}
        number = np.array([doc[k] for k in zip(table.column("id").to_pylist(), table.column("th").to_pylist(), strict=True)], np.int64)
        start = lo + np.fromiter(map(len, heads), np.int64, len(heads)) - before
        firsts = [members[0] for _, members in cuts]
        twice = np.array([len(members) > 1 or many[members[0]] for _, members in cuts], bool)
        rows, spans = [], []
        offsets = repeated_windows([c for c, _ in cuts], (number[firsts] << 32) + start[firsts], twice) if cuts else []
        for (cut, members), whole, some in zip(cuts, twice, offsets, strict=True):
            for a, b in [(0, len(cut))] if whole else _spans(some):
                for i in members:
                    if not many[i]:
                        rows.append(i)
                        spans.append((int(start[i]) + a, int(start[i]) + b))
        take = pa.array(rows, pa.int64())
        a, b = zip(*spans, strict=True) if spans else ((), ())
        ids = table.select(["id", "th"]).take(take).combine_chunks()
        columns = [ids.column(k).combine_chunks() for k in ("id", "th")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "th", "a", "b"])

    for batch in batches:
        key = batch.column("anchor").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if size >= BATCH_BYTES and held[-1].column("anchor")[-1].as_py() != key[a]:
                yield found(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(part)
            size += sum(len(x) for c in ("bytes", "left") for x in part.column(c).to_pylist())
    if held:
        yield found(pa.Table.from_batches(held))
    release()


def _neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(right, left, low, high) of sorted contexts and the next one each: bytes after the anchor and before it that are
    equal, -1 if the anchors differ, and the windows, by bytes before the anchor, that both have."""
    anchor = batch.column("anchor").to_numpy()
    right, left = (_common(*_bytes(batch.column(c).to_pylist(), w)) for c, w in (("bytes", WIDTH), ("left", SIDE)))
    same = (anchor[1:] == anchor[:-1]) & (right >= GRAM)
    right, left = np.where(same, right - GRAM, -1), np.where(same, left, -1)
    return right, left, np.where(same, SIDE - right, 1), np.where(same, left, 0)


def _most(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The larger value with the next and with the one before; the bound at either end, where a neighbour isn't known."""
    if len(bound) < 2:
        return bound
    return np.minimum(np.concatenate((bound[:1], np.maximum(x[1:], x[:-1]), bound[-1:])), bound)


_EDGES = ["la", "ha", "lb", "hb"]
_HOT = "id long, th int, anchor long, lo int, many boolean, bytes binary, left binary"


def _by_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of what follows their anchors, with the longest that another shares, and proven windows."""
    for batch in in_slices(batches, 2048):
        size = np.fromiter(map(len, batch.column("bytes").to_pylist()), np.int64, len(batch))
        right, _, low, high = _neighbours(batch)
        edges = [np.append(low, 1), np.append(high, 0), np.append(1, low), np.append(0, high)]
        arrays = [pa.array(x.astype(np.int32)) for x in (_most(right, size - GRAM), *edges)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "r", *_EDGES])


def _by_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, id, th, a, b, h): spans of proven windows (0), windows that can be repeated without a proof (1), and
    hashes of proven ones, which others may be equal to (2)."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    for batch in in_slices(batches, 2048):
        size, before = (np.fromiter(map(len, batch.column(c).to_pylist()), np.int64, len(batch)) for c in ("bytes", "left"))
        _, left, low, high = _neighbours(batch)
        r, *known = (batch.column(c).to_numpy() for c in ("r", *_EDGES))
        known += [np.append(low, 1), np.append(high, 0), np.append(1, low), np.append(0, high)]
        start, stop = np.maximum(SIDE - r, WIDTH - size), np.minimum(_most(left, before), before)  # by bytes before the anchor
        out, told = [], []
        values = zip(*(batch.column(c).to_pylist() for c in ("id", "th", "lo", "many", "bytes", "left")), strict=True)
        for i, (doc, th, lo, many, tail, head) in enumerate(values):
            if start[i] > stop[i]:
                continue
            proven = np.zeros(stop[i] - start[i] + 1, bool)
            for a, b in zip(known[::2], known[1::2], strict=True):
                proven[max(0, a[i] - start[i]) : max(0, b[i] - start[i] + 1)] = True
            proven |= many
            raw, pos = head[::-1] + tail, len(head)
            first = pos - np.arange(start[i], stop[i] + 1)  # where the windows start in the context
            h = Hashes(np.frombuffer(raw, np.uint8)).of(first, first + WIDTH).view(np.int64)
            told.append(h[proven])
            if not many:
                out += [(1, doc, th, lo + int(a), 0, int(x)) for a, x in zip(first[~proven], h[~proven], strict=True)]
                out += [(0, doc, th, lo + a, lo + b, 0) for a, b in _spans(first[proven][::-1])]
        if told:
            out += [(2, 0, 0, 0, 0, x) for x in np.unique(np.concatenate(told)).tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "id", "th", "a", "b", "h"])


def _sorted_repeats(hot: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, th, a, b) of repeated windows among the contexts of each anchor, however many they are."""
    wide = _HOT + ", r int, la int, ha int, lb int, hb int"
    rows = hot.select([c.split(" ")[0] for c in _HOT.split(", ")])
    rows = rows.repartitionByRange("anchor", "bytes", "left").sortWithinPartitions("anchor", "bytes", "left").mapInArrow(_by_right, wide)
    rows = rows.repartitionByRange("anchor", "left", "bytes").sortWithinPartitions("anchor", "left", "bytes")
    found = scratch.saved(rows.mapInArrow(_by_left, "kind int, id long, th int, a int, b int, h long"), "sorted")
    asked, told = found.where("kind = 1"), found.where("kind = 2").select("h").distinct()
    places = asked.select("h", F.xxhash64("id", "th", "a").alias("place")).groupBy("h").agg(F.min("place").alias("x"), F.max("place").alias("y"))
    often = places.join(told.withColumn("told", F.lit(True)), "h", "left").where("told or x <> y").select("h")
    more = asked.join(scratch.saved(often, "windows"), "h").select("id", "th", "a", (F.col("a") + WIDTH).alias("b"))
    return found.where("kind = 0").select("id", "th", "a", "b").union(more)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(bytes_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                out = []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    raw, merged = _raw(text), []
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for s in merged for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    sha = sha256(kept).hexdigest()
                    out.append((len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in merged], sha, kept if bytes_kept else None))
                kinds, names = [pa.int64(), pa.int64(), _SPANS, pa.string(), pa.binary()], ["n_bytes", "n_removed", "removed", "kept_sha256", "kept"]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("own"), *arrays], names=["own", *names])

    return run


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, th, spans array<struct<a,b>>) of documents (id, th, text) with bytes in repeated windows."""
    names = "id long, th int, "
    found = scratch.saved(docs.mapInArrow(_anchors, names + "anchor long, context long, lo int, hi int, at int"), "anchors")
    firsts = [F.first(c).alias(c) for c in ("id", "th", "lo", "hi", "at")]
    contexts = scratch.saved(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), *firsts), "contexts")
    equal = contexts.where("n > 1").select("anchor", "context")
    whole = found.join(equal, ["anchor", "context"]).select("id", "th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    whole = scratch.saved(whole, "whole")
    scratch.drop(found)

    apart = scratch.saved(contexts.groupBy("anchor").agg(F.count("*").alias("differ")).where("differ > 1"), "apart")
    open_ = contexts.join(apart, "anchor").select(
        "id", "th", F.struct("anchor", "lo", "hi", "at", (F.col("n") > 1).alias("many"), (F.col("differ") > MOST_CONTEXTS).alias("hot")).alias("o")
    )
    open_ = scratch.saved(open_.groupBy("id", "th").agg(F.collect_list("o").alias("open")), "open")
    scratch.drop(contexts)
    schema = names + "anchor long, lo int, many boolean, hot boolean, bytes binary, left binary"
    # rows that share id and text are one here: their contexts were counted before
    texts = rows_of(docs, open_, ["id", "th"]).join(open_, ["id", "th"])
    held = scratch.saved(texts.mapInArrow(_contexts, schema), "held")
    scratch.drop(open_)
    cold = held.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_partition, names + "a int, b int")
    hot = _sorted_repeats(held.where("hot"), scratch)
    spans = whole.unionByName(cold).unionByName(hot).distinct()
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bytes_kept: bool = True) -> DataFrame:
    """Rows (id, n_bytes, n_removed, removed array<struct<start,end>>, kept_sha256[, kept]) of every document row:
    offsets are UTF-8 bytes, kept the remaining bytes.

    A byte goes if a string of WIDTH bytes around it starts at another place too, in the same document or another.
    Null texts count as empty. Every row takes part, those without an id too; rows that share id and text are separate
    occurrences and are treated alike; rows that share only the id are told apart by the text's 32-bit hash. A text of any
    length is read in segments. Other columns, whatever their names, play no part. No documents give no rows."""
    kind = bounded(docs).select(id_col).schema[0].dataType
    key = F.col(id_col).cast("long") if isinstance(kind, IntegralType) else F.xxhash64(id_col)
    texts = docs.select(
        F.col(id_col).alias("own"), F.coalesce(key, F.lit(-(1 << 63))).alias("id"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.col(text_col).alias("text"),
    )
    with Scratch() as scratch:
        found = saved(repeats(texts.select("id", "th", "text"), scratch), "spans")
    struct = "removed array<struct<start:long,end:long>>"
    schema = f"own {kind.simpleString()}, n_bytes long, n_removed long, {struct}, kept_sha256 string, kept binary"
    if found.limit(MOST_IDS + 1).count() <= MOST_IDS:  # most texts hold no repeats: only the others meet their spans
        rest = rows_of(texts, found, ["id", "th"], how="left_anti").withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>"))
        parts = rows_of(texts, found, ["id", "th"]).join(found, ["id", "th"]).unionByName(rest)
    else:
        parts = texts.join(found, ["id", "th"], "left")
    out = parts.select("own", "text", "spans").mapInArrow(_cut(bytes_kept), schema)
    return (out if bytes_kept else out.drop("kept")).withColumnRenamed("own", id_col)


def op1(docs: DataFrame) -> DataFrame:
    """The contract's row for each document; see dedup()."""
    return dedup(docs, bytes_kept=False).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
