"""Main text of web pages, with site templates removed: element subtrees are hashed and Spark counts on how many pages of
a host each occurs.

There are two hashes. That of a subtree with its text finds what is repeated word for word; what is on most pages of a
host goes. That of a subtree's place, which is blind to text (tags and classes from the root down), finds the frame:
of the places that most pages of a host have, the smallest container with most of the host's text is its main block,
and the places beside it are the site's menus, adverts and footers, whatever they say. Tags and class words are weak
priors for hosts of few pages; they never remove what holds an article or most of a page's text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from xxhash import xxh64_intdigest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, in_slices, saved

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_MAIN = re.compile(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articlebody\b""", re.I)
_ROLE = re.compile(r"""role\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu)\b""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")
#: Tags of a page whose quotes never close, after which quotes aren't respected in it any more.
BROKEN = 100
#: Depth to which elements have places of their own; deeper ones share the place above.
DEPTH = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul head".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe svg button select input textarea dialog object canvas audio"
    " video map head menu math".split()
)
#: What is never text, with or without priors.
UNSEEN = frozenset("script style noscript template iframe svg head object canvas audio video map math".split())
#: Words in a class or id that mark what is not the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert footer masthead topbar comment comments"
    " disqus reply replies respond share sharing social related recommended newsletter subscribe signup popup modal overlay login"
    " search widget toolbar pagination pager skip banner".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
_NO_TAGS: frozenset[str] = frozenset()
FENCE = frozenset("ul ol dl table td th div article section main body html aside nav footer header form blockquote select".split())
#: What a start tag closes, and the fences for it.
CLOSED_BY = {tag: (closed, FENCE - closed) for tag, closed in CLOSES.items()}
PARAGRAPH, PARAGRAPH_FENCE = frozenset(["p"]), FENCE - {"p"}
#: Elements that can be a host's main block.
BOXES = frozenset("article main section div td center body".split())
#: Text elements that no template removal touches inside an explicit article.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def squeeze(text: str) -> str:
    """White space as single spaces, none at either end."""
    return " ".join(text.split())


def _names(attrs: str) -> list[str]:
    return [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attrs)]


@lru_cache(maxsize=1 << 14)
def _place(above: int, tag: str, attrs: str) -> int:
    names = _DIGITS.sub("0", " ".join(_names(attrs)).lower()) if attrs else ""
    return xxh64_intdigest(f"{above} {tag} {names}".encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=1 << 14)
def _marks(attrs: str) -> tuple[bool, bool, list[str]]:
    """Whether attributes mark an article, whether they hide or give a role beside it, and the class words and ids."""
    return bool(_MAIN.search(attrs)), bool(_HIDDEN.search(attrs) or _ROLE.search(attrs)), " ".join(_names(attrs)).split()


#: Attributes of more characters aren't held in the caches of _place and _marks.
CACHED = 512


def place(above: int, tag: str, attrs: str) -> int:
    return (_place if len(attrs) <= CACHED else _place.__wrapped__)(above, tag, attrs)


def marks(attrs: str) -> tuple[bool, bool, list[str]]:
    return (_marks if len(attrs) <= CACHED else _marks.__wrapped__)(attrs)


class Page:
    """A page as events in document order: element numbers opening (n), closing (~n), and strings; elements carry
    their tag, attribute text, subtree digest, and the lengths of their text and of its linked part."""

    def __init__(self, html: str | None):
        self.tags: list[str] = []
        self.attrs: list[str] = []
        self.digests: list[int] = []
        self.sizes: list[int] = []
        self.linked: list[int] = []
        self.anchors: list[int] = []
        self.holds: list[bool] = []  # is or holds an article
        self.places: list[int] = []
        self.depth: list[int] = []
        self.events: list[int | str] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}  # open elements by tag
        self.parts: list[list[bytes]] = []
        self._read(html or "")

    def _text(self, text: str) -> None:
        if text and self.open:
            text = unescape(text) if "&" in text else text
            self.events.append(text)
            size = len(text) - text.count(" ")
            self.sizes[self.open[-1]] += size
            if self.anchor:
                self.linked[self.open[-1]] += size
            if plain := squeeze(text):
                self.parts[-1].append(plain.encode("utf-8", "surrogatepass"))

    def _start(self, tag: str, attrs: str) -> None:
        n = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.digests.append(0)
        self.sizes.append(0)
        self.linked.append(0)
        self.anchors.append(int(tag == "a"))
        self.holds.append(self.is_main(n))
        up, deep = (self.places[self.open[-1]], self.depth[self.open[-1]]) if self.open else (0, 0)
        if tag in BLOCK and deep < DEPTH:
            up, deep = place(up, tag, attrs), deep + 1
        self.places.append(up)
        self.depth.append(deep)
        self.events.append(n)
        self.open.append(n)
        self.parts.append([])
        self.count[tag] = self.count.get(tag, 0) + 1
        self.anchor += tag == "a"

    def _end(self) -> None:
        n, parts = self.open.pop(), self.parts.pop()
        self.events.append(~n)
        self.count[self.tags[n]] -= 1
        self.anchor -= self.tags[n] == "a"
        self.digests[n] = xxh64_intdigest(b"\0".join([self.tags[n].encode("utf-8", "surrogatepass"), *parts])) - (1 << 63)
        if self.open:
            up = self.open[-1]
            self.sizes[up] += self.sizes[n]
            self.linked[up] += self.linked[n]
            self.anchors[up] += self.anchors[n]
            self.holds[up] |= self.holds[n] and self.sizes[n] > 0
            self.parts[-1].append(self.digests[n].to_bytes(8, "little", signed=True) if self.sizes[n] else self.tags[n].encode("utf-8", "surrogatepass"))

    def _close(self, tags: frozenset[str] | set[str], fence: frozenset[str]) -> None:
        """Close up to the innermost open element of these tags, if no fence lies inside it."""
        for tag in tags:
            if self.count.get(tag):
                break
        else:
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.tags[self.open[k]]
            if tag in tags:
                while len(self.open) > k:
                    self._end()
                return
            if tag in fence:
                return

    def _read(self, html: str) -> None:
        self.anchor = broken = 0
        self._start("html", "")
        at, size, lower = 0, len(html), None
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                break
            after = html[lt + 1 : lt + 2]
            if after in ("!", "?"):
                self._text(html[at:lt])
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    at = size if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = size if end < 0 else end + 1
                continue
            if html.find(">", lt) < 0:  # no tag ends any more
                self._text(html[at:])
                break
            m = _OPEN.match(html, lt) if broken < BROKEN else None
            if m is None and (m := _PLAIN.match(html, lt)):
                broken += 1
            if not m:
                self._text(html[at : lt + 1])
                at = lt + 1
                continue
            self._text(html[at:lt])
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if self.open and self.tags[self.open[-1]] == tag:
                    self._end()
                else:
                    self._close({tag}, FENCE if tag not in FENCE else _NO_TAGS)
                continue
            if tag in ("html", "body", "head") and self.count.get(tag):
                continue
            if tag == "body":
                self._close({"head"}, _NO_TAGS)
            if tag in BLOCK and self.count.get("p"):
                self._close(PARAGRAPH, PARAGRAPH_FENCE)
            if tag in CLOSED_BY:
                self._close(*CLOSED_BY[tag])
            self._start(tag, m[3])
            if tag in RAW:
                lower = html.lower() if lower is None and not html.islower() else lower or html
                end = lower.find("</" + tag, at) if len(lower) == size else html.find("</" + tag, at)
                end = size if end < 0 else end
                if tag in ("title", "textarea"):
                    self._text(html[at:end])
                self._end()
                gt = html.find(">", end)
                at = size if gt < 0 else gt + 1
            elif tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                self._end()
        while self.open:
            self._end()

    def subtrees(self) -> set[int]:
        """Digests of block elements with text."""
        return {d for d, tag, n in zip(self.digests, self.tags, self.sizes, strict=True) if n and tag in BLOCK and tag not in ("html", "body", "head")}

    def layout(self) -> dict[int, tuple[int, bool, list[int]]]:
        """Text size, whether it is a box, and the places above, of each place that has text."""
        out: dict[int, tuple[int, bool, list[int]]] = {}
        above: list[int] = []
        for e in self.events:
            if isinstance(e, str):
                continue
            if e < 0:
                above.pop()
                continue
            if self.sizes[e] and self.tags[e] in BLOCK and (not above or self.places[e] != above[-1]):
                size, box, chain = out.get(self.places[e]) or (0, self.tags[e] in BOXES, list(dict.fromkeys(above)))
                out[self.places[e]] = (size + self.sizes[e], box, chain)
            above.append(self.places[e])
        return out

    def is_main(self, n: int) -> bool:
        return self.tags[n] in ("article", "main") or self.attrs[n] != "" and marks(self.attrs[n])[0]

    def _dropped(self, n: int, inside: bool, spared: bool) -> bool:
        """By tags, roles and class words; class words don't touch what is spared."""
        tag, attrs = self.tags[n], self.attrs[n]
        if tag in DROPPED or tag == "header" and not inside:
            return True
        if not attrs or tag in ("html", "body", "main", "article"):
            return False
        _, aside, names = marks(attrs)
        if aside or spared:
            return aside
        for name in names:
            words = [name] if tag in TEXTS else _TOKEN.findall(name)
            if any(w.lower() in NAMED or w.lower() == "header" and not inside for w in words):
                return True
        return False

    def main_text(self, templates: set[int], frame: set[int] = frozenset(), priors: bool = True) -> str:
        """Blocks of the article, or of all that is left of the body if none is marked, joined by line ends. templates:
        digests of subtrees that go; frame: places that go."""
        drop: list[bool] = []
        region: list[int] = []
        around = [2 * self.sizes[0] + 1 if priors and self.holds[0] else self.sizes[0]]  # text of the article around; none: of the page
        skip = within = 0
        for e in self.events:  # which elements go, which are articles
            if isinstance(e, str):
                continue
            if e >= 0:
                tag, mark = self.tags[e], self.is_main(e)
                spared = self.holds[e] or 2 * self.sizes[e] >= around[-1] > 0
                if priors:
                    gone = self._dropped(e, within > 0, spared)
                else:
                    gone = tag in UNSEEN
                if not gone and tag in BLOCK and tag not in ("html", "body", "head"):
                    gone = self.digests[e] in templates and not mark and not (within and tag in TEXTS)
                    gone |= self.places[e] in frame and not spared and not within
                drop.append(gone)
                skip += gone
                if mark and priors and not skip and self.sizes[e]:
                    region.append(e)
                within += mark
                if mark:
                    around.append(self.sizes[e])
            else:
                n = ~e
                skip -= drop[n]
                if self.is_main(n):
                    within -= 1
                    around.pop()
        chosen = {e for e in region if self.tags[e] == "article"} or set(region)
        blocks: list[str] = []
        run: list[str] = []
        skip = within = 0
        for e in self.events:
            if isinstance(e, str):
                if not skip and (within or not chosen):
                    run.append(e)
                continue
            n = e if e >= 0 else ~e
            menu = priors and not chosen and self._menu(n)
            if self.tags[n] in BLOCK:
                if text := squeeze("".join(run)):
                    blocks.append(text)
                run = []
            elif self.tags[n] == "br" and e >= 0:
                run.append(" ")
            step = 1 if e >= 0 else -1
            skip += step * (drop[n] or menu)
            within += step * (n in chosen)
        if text := squeeze("".join(run)):
            blocks.append(text)
        return "\n".join(blocks)

    def _menu(self, n: int) -> bool:
        return self.tags[n] in ("ul", "ol", "div", "table", "section") and self.anchors[n] > 1 and self.linked[n] >= 0.8 * self.sizes[n]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1))


_COUNTS = "host string, key long, place boolean, n long, size long, box boolean, above array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    names = ["host", "key", "place", "n", "size", "box", "above"]
    found: dict[tuple, list] = {}

    def batch_of() -> pa.RecordBatch:
        columns = zip(*((*k, *v) for k, v in found.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def signed(x: int) -> int:
        return x - (1 << 63)

    for batch in in_slices(batches):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            for d in page.subtrees():
                found.setdefault((host, d, False), [0, 0, False, []])[0] += 1
            for place, (size, box, above) in page.layout().items():
                row = found.setdefault((host, signed(place), True), [0, 0, box, [signed(x) for x in above]])
                row[0] += 1
                row[1] += size
            row = found.setdefault((host, 0, None), [0, 0, False, []])  # pages and text of the host
            row[0] += 1
            row[1] += page.sizes[0]
        if len(found) > 200_000:
            yield batch_of()
            found.clear()
    if found:
        yield batch_of()


def templates(
    pages: DataFrame, *, url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 10,
) -> DataFrame:
    """Rows (host, digests, frame): subtrees on at least `share` of the host's pages and on `least` of them, and the
    places that as many pages have beside the host's main block.

    The main block is, of the boxes on so many pages, the one of least text that has half of the host's text. A host has
    at most 1 / share times as many of either as a page has."""
    counts = bounded(pages).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_count, _COUNTS)
    counts = counts.groupBy("host", "key", "place").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("box").alias("box"), F.max("above").alias("above")
    )
    with Scratch() as scratch:
        counts = scratch.saved(counts.where(F.col("n") >= least), "subtrees")
        whole = counts.where("place is null").select("host", F.col("n").alias("pages"), F.col("size").alias("all_text"))
        often = counts.where("place is not null").join(whole, "host").where(F.col("n") >= share * F.col("pages"))
        often = scratch.saved(often, "often")
        exact = often.where("not place").groupBy("host").agg(F.collect_set("key").alias("digests"))
        places = often.where("place")
        boxes = places.where(F.col("box") & (2 * F.col("size") >= F.col("all_text")))
        main = boxes.groupBy("host").agg(F.min_by(F.struct("key", "above"), F.struct("size", -F.size("above"), "key")).alias("main"))
        beside = ~F.array_contains("main.above", F.col("key")) & (F.col("key") != F.col("main.key")) & ~F.array_contains("above", F.col("main.key"))
        frame = places.join(main, "host").where(beside).groupBy("host").agg(F.collect_set("key").alias("frame"))
        return saved(exact.join(frame, "host", "full"), "templates")


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 10,
    priors: bool = True,
) -> DataFrame:
    """Rows (id, url, text) of every page row. A null or empty page, or one without an article, has an empty text.

    Pages without a host (null or odd urls) count as one host's. Repeated rows count as pages each. A page of any length
    is read whole; other columns, whatever their names, play no part. Without priors only templates are removed, and
    what is never text. Spark broadcasts the templates if they are small and otherwise joins by host, splitting hosts of
    many pages. Empty tables give no rows."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(id_col, url_col).schema}
    found = templates(pages, url_col=url_col, html_col=html_col, share=share, least=least)
    whole = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = whole.join(found, "host", "left").select("id", "url", "html", "digests", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (set(), set())
        for batch in in_slices(batches):
            texts = []
            for html, digests, frame in zip(*(batch.column(c).to_pylist() for c in ("html", "digests", "frame")), strict=True):
                if (digests, frame) != last:
                    last, known = (digests, frame), (set(digests or ()), {x + (1 << 63) for x in frame or ()})
                texts.append(Page(html).main_text(*known, priors))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = bounded(rows).mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op9(pages: DataFrame) -> DataFrame:
    """The contract's row for each page; see extract()."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
