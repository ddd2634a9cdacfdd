"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers,
and a span classifier, trained on the outcome over the span's shape and its context, decides.

Spans of the plain rules (email, ip, card, phone) always stay; the classifier adds others, such as spelled-out
addresses or national phone numbers. Vote patterns are counted over all documents by Spark; there are at most
4 kinds x 3**6 of them. The classifier is fitted to a bounded sample of spans (SAMPLE), whose labels are what expectation-
maximisation says of their votes; so what reaches the driver is bounded whatever the corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, in_slices, saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,}+)+"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{2,}+)+"
)
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-]?[0-9])")
_LONG = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])")

#: Gazetteers: fixed values.
SUFFIXES = frozenset(
    "com org net edu gov mil int info biz io ai app dev me tv co ac de fr es uk it nl eu us ca au nz ch at be pl se no dk fi ie pt gr cz"
    " sk hu ro bg hr si rs ua ru tr il in cn jp kr tw hk sg my th vn id ph br ar cl mx pe za ng ke eg ma ae sa".split()
)
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    " 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 971 972".split()
)
NEAR = {
    "email": frozenset(
        "email e-mail mail contact write reach correo courriel address adresse mailto inbox send reply escribe ecrivez schreiben kontakt".split()
    ),
    "ip": frozenset("ip ipv4 host server address client from login connected router gateway dns subnet ping serveur servidor rechner".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte kreditkarte tarjeta carte paid charged billing expiry cvv".split()),
    "phone": frozenset(
        "phone call tel telephone mobile cell fax telefon telefono llame appelez whatsapp contact ring dial sms text handy anrufen numero".split()
    ),
}
AGAINST = frozenset("version release v order isbn issn section chapter serial token key sha hash id no invoice ticket build port page line".split())
LABELERS = ("rule", "check", "near", "against", "edges", "gazetteer")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) of the plain rules: leftmost and not overlapping within a kind, in linear time."""
    out, over = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            over = m.end()
        else:
            over = max(over, at + 1)
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, a = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                b = a + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((1, a, b))
                a = b + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of looser patterns that overlap no base span."""
    found = [(0, *m.span()) for m in _SPELLED.finditer(text)] if "at" in text else []
    found += [(2, *m.span()) for m in _LONG.finditer(text)] + [(3, *m.span()) for m in _NATIONAL.finditer(text)]
    out: list[tuple[int, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken] or [0])
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[0])):
        k = int(np.searchsorted(starts, b)) - 1
        if (k < 0 or reach[k] <= a) and (not out or out[-1][2] <= a):
            out.append((kind, a, b))
    return out


def votes(text: str, kind: int, a: int, b: int, rule: bool) -> str:
    """A character for each labeler: 1 for, 0 against, - abstains."""
    name, span = KINDS[kind], text[a:b]
    left = re.findall(r"[\w-]+", text[max(0, a - 40) : a].lower())[-3:]
    digits = "".join(c for c in span if c.isdigit())
    check = gazetteer = "-"
    if name == "email":
        suffix = re.split(r"[^A-Za-z0-9]+", span.lower())[-1]
        gazetteer = "1" if suffix in SUFFIXES else "0"
        check = "1" if rule or re.search(r"[(\[{]at|\bat\b.*\bdot\b", span) else "0"
    elif name == "ip":
        check = "0" if all(len(p) == 1 for p in span.split(".")) else "1"
        gazetteer = "0" if span.startswith("0.") else "1"
    elif name == "card":
        check = "1" if luhn(digits) else "0"
        gazetteer = "1" if digits[:1] in "3456" and len(digits) in (13, 14, 15, 16, 19) else "0"
    else:
        check = "1" if 9 <= len(digits) <= 15 else "0"
        code = re.match(r"\+([0-9]{1,3})", span)
        gazetteer = "-" if not code else "1" if any(code[1][:k] in COUNTRY_CODES for k in (1, 2, 3)) else "0"
    before, after = text[a - 1 : a] if a else " ", text[b : b + 1] or " "
    edges = "0" if before.isalnum() or after.isalnum() or before in "\"'=" else "1"
    against = "0" if AGAINST.intersection(left) or text[max(0, a - 3) : a].strip()[-1:] in ("=", "#") else "-"
    return ("1" if rule else "-") + check + ("1" if NEAR[name].intersection(left) else "-") + against + edges + gazetteer


#: Places of the classifier's features, which are hashed, and spans that it is fitted to at most: those of lowest hash.
PLACES, SAMPLE = 1 << 13, 20_000


def describe(text: str, kind: int, a: int, b: int, cast: str) -> list[int]:
    """Hashed features of a span: its votes, shape, size and start, and the words and signs around it."""
    span, name = text[a:b], KINDS[kind]
    words = re.findall(r"[\w-]+", text[max(0, a - 40) : a].lower())[-3:]
    after = re.findall(r"[\w-]+", text[b : b + 24].lower())[:1]
    shape = re.sub(r"([0-9])+", "9", re.sub(r"[^\W\d_]+", "a", span))[:24]
    digits = "".join(c for c in span if c.isdigit())
    out = [name, f"s{name} {shape}", f"n{name} {len(digits)}", f"d{name} {digits[:2]}", f"l{name} {min(len(span) // 4, 12)}"]
    out += [f"w{w}" for w in words] + [f"a{w}" for w in after] + [f"b{text[a - 1 : a]}", f"e{text[b : b + 1]}"]
    out += [f"v{name if j == 1 else ''}{j}{v}" for j, v in enumerate(cast)]
    return sorted({zlib.crc32(f.encode("utf-8", "surrogatepass")) % PLACES for f in out})


_SPAN = pa.struct(
    [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
)
_FOUND = "found array<struct<kind:int,start:int,end:int,votes:string,features:array<int>>>"
_HINT = re.compile(r"[0-9@]|[(\[{]at[)\]}]| dot ")


def scan_text(text: str | None) -> list[tuple[int, int, int, str, list[int]]]:
    if not text or not _HINT.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, votes(text, k, a, b, True)) for k, a, b in base]
    out += [(k, a, b, votes(text, k, a, b, False)) for k, a, b in more_candidates(text, base)]
    return [(*s, describe(text, *s)) for s in out]


def _scan(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [
                [dict(zip(("kind", "start", "end", "votes", "features"), s, strict=True)) for s in scan_text(t)]
                for t in batch.column(text_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(rows, pa.list_(_SPAN))], names=["id", "found"])

    return run


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, found array<struct<kind,start,end,votes,features>>) of every document row; offsets are code points."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return bounded(docs).select(id_col, text_col).mapInArrow(_scan(id_col, text_col), f"id {kind}, {_FOUND}")


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = 50) -> dict[tuple[int, str], float]:
    """Probability of personal data for each (kind, votes) pattern, from how often each occurs.

    Expectation-maximisation over a true/false class per span: each labeler's rate of voting for and against given
    the class, shared by all kinds, and a prior per kind; priors of Beta form keep unseen votes harmless. The rule
    labeler starts and stays trusted."""
    if not patterns:
        return {}
    kinds = np.array([k for k, _, _ in patterns])
    cast = np.array([["-01".index(c) for c in v] for _, v, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    m = len(LABELERS)
    rates = np.empty((2, m, 3))  # class, labeler, vote
    rates[1], rates[0] = (0.3, 0.1, 0.6), (0.3, 0.6, 0.1)
    rates[:, 0] = [(0.999, 0.0005, 0.0005), (0.1, 0.0005, 0.8995)]
    start = rates.copy()
    prior = np.full(len(KINDS), 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        log = np.log(np.stack([1 - prior, prior]))[:, kinds]
        for j in range(m):
            log = log + np.log(rates[:, j, :])[:, cast[:, j]]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        weight = np.stack([n * (1 - post), n * post])
        for j in range(1, m):
            for v in range(3):
                rates[:, j, v] = weight[:, cast[:, j] == v].sum(1)
            rates[:, j] += start[:, j] * 20
            rates[:, j] /= rates[:, j].sum(-1, keepdims=True)
        for k in range(len(KINDS)):
            prior[k] = (weight[1, kinds == k].sum() + 1) / (n[kinds == k].sum() + 2)
    return {(int(k), v): float(q) for (k, v, _), q in zip(patterns, post, strict=True)}


def classifier(size: np.ndarray, at: np.ndarray, p: np.ndarray, *, l2: float = 1e-5, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression: span i has the next size[i] of the features `at`, and label p[i], a probability."""
    row, w = np.repeat(np.arange(len(size)), size), np.zeros(PLACES)
    m, v = np.zeros(PLACES), np.zeros(PLACES)
    for step in range(1, steps + 1):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(size)), -30, 30)))
        grad = np.bincount(at, (q - p)[row], PLACES) / max(len(size), 1) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, learned from candidates(): votes are counted over all of them, and the spans of lowest
    hash, at most `sample`, are what it is fitted to."""
    rows = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    counts = rows.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    chance = reliabilities([tuple(r) for r in counts])
    some = rows.orderBy(F.xxhash64("kind", "votes", "features"), "features").limit(sample).toArrow().combine_chunks()
    p = np.array([chance[k] for k in zip(some.column("kind").to_pylist(), some.column("votes").to_pylist(), strict=True)], float)
    if not len(p):
        return np.zeros(PLACES)
    lists = some.column("features").combine_chunks()
    return classifier(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), p)


def holds(span: tuple, weights: np.ndarray, least: float) -> bool:
    """Whether a span of scan_text() counts: those of the plain rules do."""
    return span[3][0] == "1" or 1 / (1 + np.exp(-min(max(float(weights[span[4]].sum()), -30), 30))) >= least


_KEPT = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """Rows (id, spans array<struct<start,kind,end,base>>) by start, then kind; every document row has one.

    A null or empty text has no spans. Repeated rows give repeated results; no documents give none. Texts are scanned in
    linear time whatever their length; other columns play no part, whatever their names."""
    found = saved(candidates(docs, id_col=id_col, text_col=text_col), "pii")
    weights = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in in_slices(batches):
            out = []
            for row in batch.column("found").to_pylist():
                kept = sorted((s["start"], s["kind"], s["end"], s["votes"][0] == "1") for s in row if holds(tuple(s.values()), w, least))
                out.append([dict(zip(("start", "kind", "end", "base"), s, strict=True)) for s in kept])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, _KEPT)], names=["id", "spans"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = found.mapInArrow(run, f"id {kind}, spans array<struct<start:int,kind:int,end:int,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def mask(docs: DataFrame, *, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """The documents, all columns kept, with each span replaced by its kind's tag, such as [EMAIL].

    The texts are read twice: once for the votes, once to rewrite; nothing but vote counts is gathered. Overlapping
    spans become one tag, the first one's."""
    at = docs.columns.index(text_col)
    with Scratch() as scratch:
        found = candidates(docs.select(F.lit(0).alias("row"), F.col(text_col).alias("text")), id_col="row").where(F.size("found") > 0)
        weights = docs.sparkSession.sparkContext.broadcast(fit(scratch.saved(found, "pii")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in in_slices(batches):
            texts = []
            for text in batch.column(at).to_pylist():
                out, over = [], 0
                for span in sorted(scan_text(text), key=lambda s: (s[1], s[0])):
                    if holds(span, w, least):
                        kind, a, b = span[:3]
                        if a >= over:
                            out += [text[over:a], f"[{KINDS[kind].upper()}]"]
                        over = max(over, b)
                texts.append("".join([*out, text[over:]]) if out else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded(docs).mapInArrow(run, docs.schema)


def _joined(c: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _is(kind: int):
    return lambda s: s["kind"] == kind


def op8(docs: DataFrame) -> DataFrame:
    """The contract's row for each document; the counts are of base spans. See spans()."""
    out = spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
