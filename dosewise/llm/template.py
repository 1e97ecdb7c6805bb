"""Main text of web pages: site templates removed by counting element subtrees over the pages of a host.

Every page is parsed into elements, and each element's subtree (tags, classes, text) is hashed. Spark counts for each host
with how many different main contents a subtree occurs; those found with many are the site's template and are deleted.
A paragraph or heading, also of an article, has to recur with at least half of them, a box (menu, list, footer, other
parts) with a fiftieth, as sites have several menus. Pages with the same article count once, so an article that is published at several
addresses does not become template. Cells, list items and inline elements are never deleted alone, nor is a subtree that
holds most of its page's text.

What is left is read as text: the article or main element where there is one, else the body, without menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles as far as tags and roles tell them. A class or
identifier tells it only if all its words do, and only of elements that hold less than half of the page's text (comments
may hold more). These help where a host has too few pages to count.

All subtrees are counted. Only those that would otherwise be kept need the verdict, so only their hashes go back to
their pages, and a page's HTML moves only if these lists are too many to broadcast.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import checked, filed, locator
from dosewise.session import pinned

# A subtree is template if it stands with at least MIN_PAGES different main contents of the host, and with MIN_SHARE of
# all if it is prose, BOX_SHARE if not.
MIN_PAGES = 5
MIN_SHARE, BOX_SHARE = 0.5, 0.02

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote address".split())
# Parts of a whole that are not deleted alone.
LONE = frozenset("li td th tr tbody thead tfoot dt dd figcaption summary hr".split())
LANDMARKS = ("article", "main")
DROPPED = frozenset(
    "head title script style noscript template iframe svg canvas object embed audio video nav footer aside form button select option "
    "textarea input label dialog menu xmp noembed noframes".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing "
    "social comment comments respond disqus related recommended widget pagination pager toolbar skip contentinfo complementary search".split())
# Words that say nothing about an element; a name of these and at least one of the above still tells it.
NEUTRAL = frozenset(
    "main top bottom site page global primary secondary left right upper lower wrapper wrap container inner outer box block area bar list item items "
    "link links section panel group row col column button buttons form icon icons text title content logo".split())
COMMENTS = frozenset("comment comments respond disqus".split())
# What an opening tag closes: the open elements in the first set, up to the nearest of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
# Attributes one by one; quoted text that belongs to no name is passed over whole.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
NAMES = frozenset("class id role itemprop hidden aria-hidden".split())
PARTS = re.compile(r"[A-Za-z]+")


class Page:
    """A parsed page: elements in document order, and the events (open, close, text) that they span."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = ["#page"]
        self.hashes: list[int] = [0]
        self.dropped: list[bool] = [False]  # by own or an ancestor's tag or names
        self.named: list[int] = [0]  # 1: names tell that it is no main text, 2: that it is comments
        self.chars: list[int] = [0]  # of the subtree's text, without scripts and the like
        self.parents: list[int] = [-1]
        self.has_text: list[bool] = [False]
        self.events: list[tuple[int, object]] = []  # (1, element) opens, (-1, element) closes, (0, text)
        self._stack = [0]
        self._content: list[list[bytes]] = [[]]
        self._parse(source)
        for e in range(1, len(self.tags)):
            by_name = self.named[e] == 2 or self.named[e] == 1 and not self._most(e)
            self.dropped[e] = self.dropped[e] or self.dropped[self.parents[e]] or by_name
        self.regions = self._regions()

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                break
            self._text(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self._close(tag)
                continue
            self._open(tag, found[3] or "")
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, at)
                self._text(source[at : end.start() if end else size])
                at = end.start() if end else size
        self._text(source[at:])
        while self._stack:
            self._pop()

    def _text(self, text: str) -> None:
        if not text:
            return
        text = entities.unescape(text) if "&" in text else text
        self.events.append((0, text))
        words = " ".join(text.split())
        if words:
            self._content[self._stack[-1]].append(words.encode("utf-8", "surrogatepass"))
            self.has_text[self._stack[-1]] = True
            if self.tags[self._stack[-1]] not in RAW:
                self.chars[self._stack[-1]] += len(words)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            for depth in range(len(self._stack) - 1, 0, -1):
                if self.tags[self._stack[depth]] in until:
                    break
                if self.tags[self._stack[depth]] in closed:
                    self._close(self.tags[self._stack[depth]])
                    break
        elif tag in BLOCK and tag not in ("html", "body"):
            for depth in range(len(self._stack) - 1, 0, -1):
                if self.tags[self._stack[depth]] == "p":
                    self._close("p")
                    break
                if self.tags[self._stack[depth]] in BLOCK:
                    break
        own: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() in NAMES:
                own.setdefault(name.lower(), value.strip("\"'"))
        named = 0
        if tag not in HEADINGS and tag not in ("html", "body", *LANDMARKS):
            for token in " ".join(own.get(k, "") for k in ("class", "id", "role", "itemprop")).lower().split():
                words = set(PARTS.findall(token))
                if words & DROPPED_NAMES and words <= DROPPED_NAMES | NEUTRAL:
                    named = max(named, 2 if words & COMMENTS else 1)
        parent = self._stack[-1]
        inside = any(self.tags[e] in LANDMARKS for e in self._stack) if tag == "header" else True
        out = tag in DROPPED or "hidden" in own or own.get("aria-hidden") == "true" or (tag == "header" and not inside)
        self.tags.append(tag)
        self.hashes.append(0)
        self.parents.append(parent)
        self.dropped.append(out)
        self.named.append(named)
        self.chars.append(0)
        self.has_text.append(False)
        self._content.append([f"<{tag} {own.get('class', '')}>".encode("utf-8", "surrogatepass")])
        element = len(self.tags) - 1
        self.events.append((1, element))
        self._stack.append(element)
        if tag in VOID:
            self._pop()

    def _close(self, tag: str) -> None:
        if any(self.tags[e] == tag for e in reversed(self._stack)):
            while self.tags[self._stack[-1]] != tag:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        element = self._stack.pop()
        value = xxhash.xxh64(b"\x00".join(self._content[element]))
        self.hashes[element] = (value.intdigest() >> 1 << 1 | (self.tags[element] in PROSE)) - (1 << 63)  # odd: prose
        self._content[element] = []
        self.events.append((-1, element))
        if self._stack:
            self._content[self._stack[-1]].append(value.digest())
            self.has_text[self._stack[-1]] |= self.has_text[element]
            self.chars[self._stack[-1]] += self.chars[element]

    def _most(self, element: int) -> bool:
        """Whether the element holds at least half of the page's text."""
        return 2 * self.chars[element] >= self.chars[0]

    def _regions(self) -> set[int]:
        """The outermost article elements, else main elements, else the page."""
        for name in LANDMARKS:
            found = {e for e, tag in enumerate(self.tags) if tag == name and not self.dropped[e]}
            outer = {e for e in found if not self._within(e, found)}
            if outer:
                return outer
        return {0}

    def _within(self, element: int, others: set[int]) -> bool:
        while (element := self.parents[element]) >= 0:
            if element in others:
                return True
        return False

    def main(self) -> int:
        """Hash of the article or main elements, of the whole page where there is none."""
        own = sorted(self.regions)
        if len(own) == 1:
            return self.hashes[own[0]]
        return xxhash.xxh64(b"\x00".join(self.hashes[e].to_bytes(8, "little", signed=True) for e in own)).intdigest() - (1 << 63)

    def subtrees(self) -> tuple[list[int], list[int]]:
        """(hashes of all subtrees that can be template, those of them that would be kept).

        The regions and what holds them are never template, nor are parts that do not stand alone, a page's html or
        body, and what holds most of the page's text.
        """
        holding = set()
        for region in self.regions:
            while region >= 0:
                holding.add(region)
                region = self.parents[region]
        in_region = [False] * len(self.tags)
        every, kept = set(), set()
        for e in range(1, len(self.tags)):
            in_region[e] = e in self.regions or in_region[self.parents[e]] or 0 in self.regions
            tag = self.tags[e]
            if not self.has_text[e] or e in holding or tag in ("html", "body") or tag not in BLOCK or tag in LONE or self._most(e):
                continue
            every.add(self.hashes[e])
            if in_region[e] and not self.dropped[e]:
                kept.add(self.hashes[e])
        return sorted(every), sorted(kept)

    def text(self, template: set[int]) -> str:
        """Blocks of the regions in page order, without dropped elements and template subtrees."""
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            words = "".join(run).split()
            if words:
                blocks.append(" ".join(words))
            run.clear()

        region = 1 if 0 in self.regions else 0
        hidden = 0
        for kind, value in self.events:
            if kind == 0:
                if region and not hidden:
                    run.append(value)
                continue
            tag = self.tags[value]
            if tag in BLOCK and region:
                flush()
            elif tag == "br":
                run.append(" ")
            if value in self.regions and value:
                region += kind
            if self.dropped[value] or (template and self.hashes[value] in template):
                hidden += kind
        flush()
        return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty for null and for anything without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def subtree_table(pages: DataFrame, html_col: str) -> DataFrame:
    """(at, host, main, body, every, kept) for each page: hashes of its main content, of the page, of its possible template subtrees, of those kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [Page(h or "") for h in batch.column("html").to_pylist()]
            trees = [p.subtrees() for p in parsed]
            columns = [
                batch.column("at"), batch.column("host"), pa.array([p.main() for p in parsed], pa.int64()), pa.array([p.hashes[0] for p in parsed], pa.int64()),
                pa.array([t[0] for t in trees], pa.list_(pa.int64())), pa.array([t[1] for t in trees], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["at", "host", "main", "body", "every", "kept"])

    rows = pages.select(locator().alias("at"), host(F.col("url")).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "at struct<file:string,row:long>, host string, main long, body long, every array<long>, kept array<long>")


def templates(trees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, box_share: float = BOX_SHARE) -> DataFrame:
    """(host, tree): subtrees with many different main contents of the host; of pages with one content one is counted."""
    bodies = trees.groupBy("host", "main").agg(F.min_by("every", "body").alias("every"))
    sizes = bodies.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    counts = bodies.select("host", F.explode("every").alias("tree")).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    many = counts.where(F.col("n") >= min_pages).join(sizes, "host")
    share = F.when(F.col("tree").bitwiseAND(1) == 1, min_share).otherwise(box_share)
    return many.where(F.col("n") >= F.col("pages") * share).select("host", "tree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, box_share: float = BOX_SHARE, html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
    A null or empty page has an empty text. Pages without a host are counted together. Repeated rows are all
    returned. Other columns are ignored, whatever their names. Broken and unclosed markup is read as browsers would.
    """
    pages = filed(pages)
    trees = pinned(subtree_table(pages, html_col))
    asked = trees.select("at", "host", F.explode("kept").alias("tree"))
    verdicts = asked.join(templates(trees, min_pages, min_share, box_share), ["host", "tree"]).groupBy("at").agg(F.collect_list("tree").alias("template"))
    lists = checked(pinned(verdicts.withColumnRenamed("at", "of")), 20_000)
    rows = pages.select("page_id", "url", F.col(html_col).alias("html"), locator().alias("at"))
    rows = rows.join(lists, F.col("at") == F.col("of"), "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deleted = batch.column("template").to_pylist()
            texts = [Page(h or "").text(set(t or ())) for h, t in zip(batch.column("html").to_pylist(), deleted)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
