"""Substring dedup by line or paragraph hashing: units are normalised, their digests grouped over all documents, the
earliest ranked occurrence of each stays, and every other one goes, with its original offsets on record.

Lines can be cut at sentence ends too, so that a passage is found inside longer lines. Then a repeated unit goes only in
a run of repeated units that holds enough words: a passage, not a phrase that writers share. Each unit is hashed once;
what comes back to a document is the numbers of its repeated units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, Scratch, bounded, in_slices, rows_of, saved

_SPACE = re.compile(r"[ \t\r\f\v]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BREAK = {
    "line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[ \t\r\f\v]*\n)+"), "sentence": re.compile(r"\n|(?<=[.!?]) +"),
}
#: Words that a run of repeated units holds at least: half of a passage of 50 words, which can start and end inside units.
LEAST_RUN = 25


def units(text: str | None, unit: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, start of the next, normalised text) of each unit of text in code points.

    Normalised: A-Z in lower case, runs of blanks as one, none at either end."""
    start = 0
    for stop in [*(m.span() for m in _BREAK[unit].finditer(text or "")), (len(text or ""), -1)]:
        plain = _SPACE.sub(" ", text[start : stop[0]].replace("\n", " ") if text else "").strip(" ").translate(_UPPER)
        after = stop[1] if stop[1] >= 0 else stop[0]
        yield start, stop[0], after, plain
        start = after


def _digest(plain: str) -> bytes:
    return blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _words(plain: str) -> int:
    return plain.count(" ") + 1 if plain else 0


def _units(unit: str, least_words: int):
    """A row for each unit that has words enough: its document's row `who`, number, words and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows, number, words, found = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for n, (_, _, _, plain) in enumerate(units(text, unit)):
                    if plain and (size := _words(plain)) >= least_words:
                        rows.append(row)
                        number.append(n)
                        words.append(size)
                        found.append(_digest(plain))
            arrays = [pa.array(number, pa.int32()), pa.array(words, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("who").take(pa.array(rows, pa.int64())), *arrays], names=["who", "n", "words", "digest"])

    return run


def passages(found: list[tuple[int, int, int, str]], repeated: set[int], least_run: int) -> list[int]:
    """Numbers of the repeated units that lie in runs of least_run words; units without words don't part a run."""
    out: list[int] = []
    run: list[int] = []
    size = 0
    for n, (_, _, _, plain) in enumerate([*found, (0, 0, 0, ".")]):
        if n in repeated:
            run.append(n)
            size += _words(plain)
        elif plain:
            if size >= least_run:
                out += run
            run, size = [], 0
    return out


def own_repeats(found: list[tuple[int, int, int, str]], least_words: int) -> set[int]:
    seen: set[str] = set()
    out = set()
    for n, (_, _, _, plain) in enumerate(found):
        if plain and _words(plain) >= least_words:
            if plain in seen:
                out.add(n)
            seen.add(plain)
    return out


def _cut(unit: str, least_words: int, least_run: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out: list[tuple] = []
            for own, text, gone in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "gone")), strict=True):
                if not text or own is not None and not gone:
                    out.append((sum(1 for _ in _BREAK[unit].finditer(text)) + 1 if text else 0, [], text))
                    continue
                found = list(units(text, unit))
                cut = set(passages(found, set(gone) if own is not None else own_repeats(found, least_words), least_run))
                keep = [u for n, u in enumerate(found) if n not in cut]
                spans = [{"start": found[n][0], "end": found[n][1]} for n in sorted(cut)]
                kept = "".join(text[a:after] for a, _, after, _ in keep[:-1])
                if keep:  # the break after the last kept unit goes with what followed
                    kept += text[keep[-1][0] : keep[-1][1]]
                out.append((len(found), spans, kept))
            n, spans, texts = zip(*out, strict=True)
            arrays = [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_units", "removed", "text"])

    return run


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, unit: str = "line",
    least_words: int = 5, least_run: int = 0,
) -> DataFrame:
    """Rows (id, n_units, removed array<struct<start,end>>, text) of every document row; offsets are code points of the
    original text. Units are lines, paragraphs, or sentences of lines.

    Of each unit that occurs again, the occurrence of the lowest (rank, id), then the first in the text, is the one that
    counts as first; the rank is the id unless a column is named. The others go if they lie in a run of such units of
    least_run words. Units of fewer than least_words words never count as repeated. A unit goes with the break after it;
    the break after the last unit that stays goes too if anything followed.

    Rows that share id and text are copies of one document and are cut alike; rows without an id only lose what repeats
    in themselves. Null texts stay null and, like empty ones, have no units; no documents give no rows. A text of any
    length is read whole; other columns, whatever their names, play no part.

    Units meet in two plain shuffles by digest, so a digest that a third of all documents hold is split at run time."""
    kind = bounded(docs).select(id_col).schema[0].dataType.simpleString()
    rank = F.col(rank_col or id_col).alias("rank")
    whole = docs.select(rank, F.col(id_col).alias("id"), F.hash(text_col).alias("th"), F.col(text_col).alias("text"))
    who = whole.where("id is not null").select(F.struct("rank", "id", "th").alias("who"), "text")
    schema = f"who {who.schema[0].dataType.simpleString()}, n int, words int, digest binary"
    with Scratch() as scratch:
        every = scratch.saved(who.mapInArrow(_units(unit, least_words), schema), "units")
        first = F.min(F.struct("who.rank", "who.id", "n", "who.th")).alias("first")
        shared = every.groupBy("digest").agg(first, F.count("*").alias("times")).where("times > 1").drop("times")
        shared = scratch.saved(shared, "repeated")
        same = (F.col("who.id") == F.col("first.id")) & (F.col("n") == F.col("first.n")) & (F.col("who.th") == F.col("first.th"))
        again = every.join(shared, "digest").where(~same).select("who.id", "who.th", "n", "words")
        gone = again.groupBy("id", "th").agg(F.collect_list("n").alias("gone"), F.sum("words").alias("words"))
        gone = saved(gone.where(F.col("words") >= least_run).drop("words"), "gone")
    if gone.limit(MOST_IDS + 1).count() <= MOST_IDS:  # most texts lose nothing: only the others meet their units
        rest = rows_of(whole, gone, ["id", "th"], how="left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
        whole = rows_of(whole, gone, ["id", "th"]).join(gone, ["id", "th"]).unionByName(rest)
    else:
        whole = whole.join(gone, ["id", "th"], "left")
    schema = f"id {kind}, n_units long, removed array<struct<start:long,end:long>>, text string"
    return whole.select("id", "text", "gone").mapInArrow(_cut(unit, least_words, least_run), schema).withColumnRenamed("id", id_col)


def op2(docs: DataFrame, least_words: int = 1, least_run: int = LEAST_RUN) -> DataFrame:
    """Lines are cut at sentence ends; units that occur before are removed in runs of LEAST_RUN words. See dedup()."""
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return dedup(docs, unit="sentence", least_words=least_words, least_run=least_run).select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"), "text"
    )


OP2_SQL = r"""
WITH p AS (
  SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] +)', '\1' || chr(1), 'g'), chr(1)) AS ps
  FROM documents WHERE text <> ''),
l AS (
  SELECT doc_id, i, piece, line, sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i) - len(piece) AS a
  FROM (SELECT doc_id, i, piece, CASE WHEN ends_with(piece, chr(10)) THEN left(piece, -1) ELSE regexp_replace(piece, '([.!?]) +$', '\1') END AS line
        FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p))),
u AS (
  SELECT *, translate(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS plain FROM l),
r AS (
  SELECT doc_id, i, len(plain) - len(replace(plain, ' ', '')) + 1 AS words,
         row_number() OVER (PARTITION BY plain ORDER BY doc_id, i) > 1 AS again,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u WHERE plain <> ''),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, again ORDER BY i) AS island FROM r),
w AS (SELECT doc_id, i, again AND sum(words) OVER (PARTITION BY doc_id, again, island) >= 25 AS gone FROM g),
k AS (SELECT u.*, coalesce(w.gone, false) AS gone FROM u LEFT JOIN w ON u.doc_id = w.doc_id AND u.i = w.i)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_units, CAST(coalesce(g, 0) AS BIGINT) AS n_removed,
       coalesce(spans, '') AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, sum(CAST(gone AS INT)) AS g,
         string_agg(CAST(a AS VARCHAR) || ':' || CAST(a + len(line) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE gone) AS spans,
         string_agg(CASE WHEN i = last THEN line ELSE piece END, '' ORDER BY i) FILTER (WHERE NOT gone) AS t
  FROM (SELECT *, max(CASE WHEN NOT gone THEN i END) OVER (PARTITION BY doc_id) AS last FROM k) GROUP BY doc_id) USING (doc_id)
"""

#: The same with runs of any number of words.
OP2_EVERY_SQL = OP2_SQL.replace(">= 25 AS gone", ">= 0 AS gone")
