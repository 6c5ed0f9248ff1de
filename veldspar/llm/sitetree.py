"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements (tag and class or id). For each node the
pages' presentations (the sequence of child elements) and contents (the text below it) are counted, and the node's
importance is the normalised entropy of both, weighted by ``gamma``: what every page shows alike has none. The text of
a child is part of its parent's, so a node of low importance has no child of high importance. Branches of low
importance that a good share of a host's pages has are removed from each page; hosts with fewer than ``least_pages``
pages take the branches of the tree of all hosts. Counting is two grouped sums, which combine before the shuffle, so
that a host with a third of all pages is no hot group.

Entropy can't tell an advert or a form that differs from page to page from an article. Elements whose tag or role says so
go as well, and hidden ones. A class or id that consists of names of noise and of words for places is only a prior: the
element goes unless nearly all of the page's article (else of its main element, else of its text) lies inside. Nor does
a branch of low importance go that holds the article or main element. Where a page
has an article (else a main) element only its inside counts. Plain headings, paragraphs, lists, quotes, tables and code
inside of an article are never taken for low-importance branches, as pages may be copies of each other.

Text: character references decoded, white space inside a block one space, trimmed; blocks in page order joined by two
newlines. A null html or one without text gives an empty string, a null url belongs to the host ''. Repeated pages are
repeated rows; an empty table gives an empty result; other columns aren't read. Any markup is accepted, in time in
proportion to its length: unclosed and stray tags, broken attributes, unended comments. An element that goes and isn't
closed ends with the block around it or before the next block. Elements nest as deep as they like.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import bounded_broadcast, pieces, written


@dataclass(frozen=True)
class Settings:
    gamma: float = 0.9
    least_importance: float = 0.2
    least_pages: int = 8
    least_share: float = 0.25


#: A named element stays if less than this share of the article's characters lies outside of it.
LEAST_REST = 0.1


# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("noscript template iframe svg math object select".split())
DROPPED = frozenset("nav footer aside form header button dialog menu head label fieldset".split()) | RAW | FOREIGN
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption section div b i em strong a span u s small sub sup code mark q cite time abbr article main hgroup".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond discussion related recommended share sharing social widget pagination pager toolbar skip login search copyright".split())
PLACES = frozenset("site page main global top bottom left right wide inner outer wrap wrapper container box block area section panel bar group list item items links link text content col column row post article entry user users reader readers visitor block widget inline sticky fixed js is has the my".split())
OWNERS = frozenset("page post article entry content story section".split())
MODIFIERS = frozenset("has with no".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: An end tag or a start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = frozenset("table td th ul ol dl div section article main body html".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_WORDS = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    text: str
    dropped: bool  # by kind
    low: bool  # by the style tree
    article: bool
    main: bool


class Node:
    """An element. dropped: it or one around it is of a kind that goes; named, lowly: the nearest element, itself
    included, that goes by its name or by the style tree unless it holds the article; block: the nearest block."""

    __slots__ = ("tag", "path", "dropped", "named", "lowly", "article", "main", "block", "outer", "gone", "children", "start", "end")

    def __init__(self, tag: str, path: int, dropped: bool, article: bool, main: bool, above: Node | None, start: int):
        self.tag, self.path, self.dropped, self.article, self.main = tag, path, dropped, article, main
        self.named, self.lowly = (above.named, above.lowly) if above else (None, None)
        self.block = self if above is None or tag in BLOCKS else above.block
        self.outer: list[tuple[str, Node | None]] = []
        self.gone: dict[str, bool] = {}
        self.children: list[str] = []
        self.start, self.end = start, start

    def mark(self, kind: str) -> None:
        """Let this element go by its name or by the style tree ("named" or "lowly") if nothing speaks against it."""
        self.outer.append((kind, getattr(self, kind)))
        setattr(self, kind, self)


class _Tags:
    """Where the tags of a page lie; every character is passed once."""

    def __init__(self, html: str):
        self.html, self.open_quotes = html, set("\"'")
        self.last: dict[str, int] = {}

    def end(self, at: int) -> int:
        """Place of the > that ends the tag at this place, -1 if none does; a quote without an end is no quote."""
        i = at
        while m := _STOP.search(self.html, i):
            if m[0] == ">":
                return m.start()
            i = m.end()
            if m[0] in self.open_quotes:
                close = self.html.find(m[0], i)
                if close < 0:
                    self.open_quotes.discard(m[0])
                    return self.end(at)
                i = close + 1
        return self.html.find(">", at)

    def closed_after(self, tag: str, at: int) -> bool:
        if tag not in self.last:
            self.last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", self.html, re.I)), default=-1)
        return self.last[tag] > at


def _named(names: str) -> bool:
    """Whether a class or id consists of names of noise and words for places, at least one of the former."""
    for name in names.split():
        words = _WORDS.findall(name)
        if words and (words[0] in MODIFIERS or "header" in words and OWNERS.intersection(words)):
            continue
        if any(w in NAMES for w in words) and all(w in NAMES or w in PLACES for w in words):
            return True
    return False


def parse(html: str | None, low: frozenset | set = frozenset()) -> tuple[list[Node], list[Block]]:
    """The elements and the text blocks of a page. An element's blocks are start to end - 1; low: paths to remove."""
    html = html or ""
    root = Node("", 0, False, False, False, None, 0)
    nodes, stack, blocks, tops, held, tags = [root], [root], [], [], [], _Tags(html)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    scopes = [0]
    at, n = 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1].block
                tops.append(top)
                blocks.append(Block(text, top.dropped, False, top.article, top.main))

    def hold(text: str) -> None:
        """Text of an element that goes, inside of a block that doesn't, is left out of the block."""
        top, around = stack[-1], stack[-1].block
        if top is not around and (top.dropped and not around.dropped or top.named is not around.named or top.lowly is not around.lowly):
            text = " "
        held.append(text)

    def close(k: int) -> None:
        """End all open elements from number k on."""
        if any(x.tag in BLOCKS for x in stack[k:]):
            flush()
        for x in reversed(stack[k:]):
            x.end = len(blocks)
            if x is not root:
                places[x.tag].pop()
                if x.tag in SCOPES:
                    scopes.pop()
        del stack[k:]

    def close_nearest(ends) -> None:
        """End the innermost open element of these tags, if it isn't outside of the innermost scope."""
        k = max((places[t][-1] for t in ends if places[t]), default=0)
        if k and k >= scopes[-1]:
            close(k)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            hold(html[at:])
            break
        if start > at:
            hold(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(html, start)
        end = tags.end(start + 1) if m or html[start + 1 : start + 2] in ("!", "?") else -1
        if end < 0:  # no tag
            hold("<")
            at = start + 1
            if m:  # nor any further one
                hold(html[at:])
                break
            continue
        at = end + 1
        if not m:
            continue
        tag = m[1].lower()
        if html[start + 1] == "/":
            k = places[tag][-1] if places[tag] else 0
            if k and (tag in BLOCKS or k >= scopes[-1]):
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            hold(" " if tag == "br" else "")
            continue
        if tag in RAW:
            finish = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if tags.closed_after(tag, start) else None
            at = finish.end() if finish else n
            stack[-1].children.append(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            stack[-1].children.append(tag)
            continue
        if tag in BLOCKS:
            while stack[-1].dropped and stack[-1].tag not in BLOCKS and not stack[-2].dropped and not (stack[-1].tag in FOREIGN and tags.closed_after(stack[-1].tag, start)):
                close(len(stack) - 1)
            if tag not in ("html", "body", "head"):
                close_nearest(("p",))
            close_nearest(CLOSES.get(tag, ()))
            flush()
        above = stack[-1]
        names, role, hidden = "", "", False
        for a in _ATTRIBUTE.finditer(html, m.end(), end):
            key = a[1].lower()
            value = (a[2] or a[3] or a[4] or "").lower()
            if key == "role":
                role = value
            elif key in ("class", "id"):
                names += " " + value
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
                hidden = True
        article, main = above.article or tag == "article", above.main or tag == "main"
        dropped, named = above.dropped, False
        if not dropped and (tag not in ("html", "body", "article", "main") or tag == "article" and above.article):
            own_heading = article and "header" in (tag, *_WORDS.findall(names))
            dropped = hidden or role in ROLES or tag in DROPPED and not own_heading
            named = not own_heading and _named(names)
        above.children.append(tag)
        path = zlib.crc32(f"{above.path}/{tag}.{names}".encode("utf-8", "surrogatepass"))
        node = Node(tag, path, dropped, article, main, above, len(blocks))
        if named:
            node.mark("named")
        if path in low and not (article and tag in PLAIN and not names):
            node.mark("lowly")
        nodes.append(node)
        places[tag].append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(node)
    flush()
    close(0)
    _judge(nodes, blocks, tops)
    return nodes, blocks


def _judge(nodes: list[Node], blocks: list[Block], tops: list[Node]) -> None:
    """Decide which of the marked elements go, outer ones first, and with them their blocks (of the nodes tops)."""
    level = next((x for x in ("article", "main") if any(getattr(b, x) and not b.dropped for b in blocks)), None)
    before = [0, *accumulate(0 if b.dropped or level and not getattr(b, level) else len(b.text) for b in blocks)]
    for x in nodes:
        for kind, outer in x.outer:
            inside = before[x.end] - before[x.start]
            holds = level is None or not getattr(x, level)
            if kind == "lowly":
                holds = holds and level is not None
            spared = holds and inside > 0 and before[-1] - inside < LEAST_REST * before[-1]
            x.gone[kind] = outer is not None and outer.gone[kind] or not spared
    for b, top in zip(blocks, tops, strict=True):
        b.dropped = b.dropped or top.named is not None and top.named.gone["named"]
        b.low = top.lowly is not None and top.lowly.gone["lowly"]


PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E687 % PRIME


def features(html: str | None) -> dict[int, tuple[int, int]]:
    """Of a page: node -> hashes of its presentation and of the text below it; equal paths are taken together."""
    nodes, blocks = parse(html)
    style: dict[int, int] = {}
    content: dict[int, int] = {}
    before, power = [0], [1]  # hashes of the first blocks, so that any run of blocks has its hash at once
    for b in blocks:
        before.append((before[-1] * BASE + zlib.crc32(b.text.encode("utf-8", "surrogatepass")) + 1) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    for x in nodes:
        runs = [t for t, before in zip(x.children, ["", *x.children], strict=False) if t != before]
        style[x.path] = zlib.crc32(" ".join(runs).encode("utf-8", "surrogatepass"), style.get(x.path, 0))
        below = (before[x.end] - before[x.start] * power[x.end - x.start]) % PRIME
        content[x.path] = hash((content.get(x.path, 0), below)) & 0x7FFFFFFFFFFFFFFF
    return {p: (style[p], content[p]) for p in style}


def main_text(html: str | None, low: set[int] | frozenset = frozenset()) -> str:
    """The page's text without the branches in low."""
    _, blocks = parse(html, low)
    if any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    elif any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    return "\n\n".join(b.text for b in blocks if not b.dropped and not b.low)


def low_importance(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, low): the branches to remove of each host with enough pages, and of all pages in the row whose host is
    null; a written table. pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            rows = [(h, p, k, v) for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for p, both in features(t).items() for k, v in enumerate(both)]
            if rows:
                h, p, k, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], ["host", "node", "kind", "value"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, node long, kind int, value long").groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    seen = written(seen, "site-trees")
    everywhere = seen.groupBy("node", "kind", "value").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("host"), "node", "kind", "value", "c")

    def low(counts: DataFrame) -> DataFrame:
        by_kind = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("w"))
        entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("w") / F.col("m")) / F.log("m")).otherwise(1.0)
        weight = F.when(F.col("kind") == 0, 1 - s.gamma).otherwise(s.gamma)
        of_node = by_kind.groupBy("host", "node").agg(F.max("m").alias("m"), F.sum(entropy * weight).alias("importance"))
        size = of_node.filter("node = 0").select(F.col("host").alias("h"), F.col("m").alias("pages"))
        joined = of_node.join(size, F.col("host").eqNullSafe(F.col("h"))).filter((F.col("pages") >= s.least_pages) & (F.col("m") >= s.least_share * F.col("pages")))
        few = joined.filter((F.col("node") != 0) & (F.col("importance") < s.least_importance))
        return joined.filter("node = 0").select("host").join(few.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low")).withColumnRenamed("host", "g"), F.col("host").eqNullSafe(F.col("g")), "left").select("host", F.coalesce("low", F.array().cast("array<long>")).alias("low"))

    return written(low(seen).union(low(everywhere)), "site-branches")  # at most 1 / least_share times a page's nodes each


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    branches = low_importance(whole, s)
    usual = [int(x) for r in branches.filter("host is null").collect() for x in r.low]  # of one tree
    joined = whole.join(bounded_broadcast(branches.filter("host is not null"), 4096), "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            texts = [main_text(t, frozenset(usual if low is None else low)) for t, low in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
