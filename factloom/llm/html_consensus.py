"""Main text of pages by consensus of their host.

First pass: every page scores its containers by the text of their own blocks
(long, with few links), climbs from the best one to its parents while what they
add is not mostly links, and votes for the path of that: tags with their
classes, digits generalised, from the body down. In Spark the votes are summed
by host and path, and each host keeps the path with the most. Second pass: the
text is taken from the containers at the host's path, from which the page
climbs likewise inside the body; a page that has none there uses its own best.

Names of classes and ids never remove text while a page is read. An element
whose name says that it is no part of the article (``named``) is a container of
its own, whose text counts for itself at ``DOUBT`` and not for what is around
it, and so is a form: an article inside one, or inside a page-wide form, is
found if it has most of the text or if its host votes for it.

A path is a 64-bit hash of its parent's and its own tag and classes, so that
memory grows with the page and not with its depth; pages are read from left to
right once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import slices, written
from .url_rules import host_of

#: Winners of up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Weight of the text of elements that are named like no part of the article.
DOUBT = 0.001

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SKIP = frozenset("script style noscript template nav header footer aside button select textarea title head iframe svg canvas object menu dialog math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
#: Start tags that end an open paragraph, and elements of a list or table that end their like.
CLOSES_P = BLOCK - {"body", "html", "li", "td", "th", "tr", "dd", "dt", "legend", "summary", "figcaption", "tbody", "thead", "tfoot"}
LIKE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ROLES = frozenset("banner complementary contentinfo dialog alert navigation search form menu menubar".split())

#: Names of what is not the article, and words that may stand beside them in one name.
APART = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside cookie cookies gdpr notice notices alert popup modal subscribe subscription newsletter signup share sharing sharebar social related recommended recommendations trending comment comments commentlist disqus replies responses pagination pager tagcloud widget widgets toolbar copyright disclaimer".split()
)
BESIDE = frozenset("site page top bottom left right upper lower main primary secondary global sticky fixed floating box block bar list item items area wrap wrapper container inner outer row col column section slot unit zone panel banner strip link links button buttons icon icons media form thread post posts article articles entry story stories news reader readers user users the our your and of consent law policy".split())
WHOLE = frozenset("header site-header page-header top-header skip-link skip-links skip-to-content respond reply-form".split())
ADVERTS = frozenset("ad ads advert advertisement sponsored".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The end of a tag, or one attribute; a quote counts only after a '=', and only if another ends it.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?)""")
TELLING = re.compile(r"class|id|role|hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=1 << 14)
def named(names: str) -> bool:
    """Whether a class or an id says that an element is no part of the article:
    a word of ``APART`` alone, or among none but words of ``BESIDE`` and
    numbers, so that 'cookie-banner' does and 'social-history' does not."""
    for name in names.split():
        if name.lower() in WHOLE:
            return True
        words = [w for w in (DIGITS.sub("", x).lower() for x in PARTS.split(name)) if w]
        if any(w in APART for w in words) and all(w in APART or w in BESIDE for w in words):
            return True
    return False


@dataclass
class Page:
    """Containers as columns, parents first, and the blocks of text, each with
    its container."""

    path: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    apart: list[bool] = field(default_factory=lambda: [False])
    chars: list[float] = field(default_factory=lambda: [0.0])
    text: list[int] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, classes: str, apart: bool) -> int:
        self.path.append(xxhash.xxh64_intdigest(f"{tag}.{classes}", self.path[parent]))
        self.parent.append(parent)
        self.tag.append(tag)
        self.apart.append(apart)
        self.chars.append(0.0)
        self.text.append(0)
        self.links.append(0)
        return len(self.path) - 1


class Stack:
    """Open elements; the last of a name, block or container is known at once."""

    def __init__(self) -> None:
        self.tags, self.containers, self.skipped = [""], [0], [False]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.holders: list[int] = []

    def push(self, tag: str, container: int, skipped: bool) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.containers.append(container)
        self.skipped.append(skipped)
        self.where.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in CONTAINER:
            self.holders.append(at)

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def cut(self, to: int) -> None:
        while len(self.tags) > to:
            self.where[self.tags.pop()].pop()
            self.containers.pop()
            self.skipped.pop()
        for marks in (self.blocks, self.holders):
            while marks and marks[-1] >= to:
                marks.pop()


def tag_end(html: str, at: int) -> tuple[int, dict[str, str]]:
    """(where a start tag ends, its telling attributes); -1 if it is left open."""
    end = html.find(">", at)
    if end < 0:
        return -1, {}
    raw = html[at:end]
    quoted = '"' in raw or "'" in raw
    if not quoted and not TELLING.search(raw):
        return end + 1, {}
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(html, at)
        if m[1]:
            return m.end(), found
        if m.end() == at:
            return -1, found
        if m[2] and (name := m[2].lower()) in ("class", "id", "role", "hidden"):
            found.setdefault(name, entities.unescape(m[3] or m[4] or m[5] or ""))
        at = m.end()


def parse(html: str) -> Page:
    """Read a page leniently: what is not closed ends with its parent, rogue
    end tags are ignored, a tag left open at the end is dropped."""
    page, stack = Page(), Stack()
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                c = stack.containers[-1]
                page.blocks.append((c, text))
                page.chars[c] += max(0, len(text) - linked) * (1.0 if len(text) > 40 else 0.25)
                page.text[c] += len(text)
                page.links[c] += min(len(text), linked)
        linked = 0

    def close(to: int) -> None:
        if stack.blocks and stack.blocks[-1] >= to:
            flush()
        stack.cut(to)

    def take(text: str) -> None:
        nonlocal linked
        if text and not stack.skipped[-1]:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack.where.get("a"):
                linked += len(text.strip())

    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            take(html[at:])
            break
        follow = html[begin + 1 : begin + 2]
        if follow in ("!", "?"):
            take(html[at:begin])
            comment = html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + (4 if comment else 1))
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        ending = follow == "/"
        m = NAME.match(html, begin + 1 + ending)
        if not m:
            take(html[at : begin + 1])  # no tag
            at = begin + 1
            continue
        take(html[at:begin])
        tag = m[0].lower()
        at, a = tag_end(html, m.end())
        if at < 0:
            break
        if ending:
            depth = stack.last(tag)
            if depth and (tag in BLOCK or not (stack.holders and stack.holders[-1] >= depth)):
                close(depth)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            take("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            depth = stack.last("p")
            if depth and not (stack.holders and stack.holders[-1] > depth):
                close(depth)
        elif tag in LIKE:
            like, within = LIKE[tag]
            depth = stack.last(*like.split())
            if depth and depth > stack.last(*within):
                close(depth)
        if tag in BLOCK:
            flush()
        names = f"{a.get('class', '')} {a.get('id', '')}"
        apart = tag == "form" or tag in BLOCK and tag not in ("body", "html", "main", "article") and named(names)
        skipped = stack.skipped[-1] or tag in SKIP or a.get("role", "").lower() in ROLES or "hidden" in a or tag not in BLOCK and not ADVERTS.isdisjoint(names.split())
        container = stack.containers[-1]
        if (apart or tag in CONTAINER) and not skipped:
            container = page.add(container, tag, ".".join(sorted({DIGITS.sub("#", c) for c in a.get("class", "").split()})), apart)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            if not end:
                break
            close_at = html.find(">", end.start())
            at = close_at + 1 if close_at >= 0 else size
            continue
        if tag in BLOCK or html[at - 2] != "/":
            stack.push(tag, container, skipped)
    flush()
    return page


def _sums(page: Page, own: list) -> list[float]:
    """Of each container with those inside, but not with what stands apart."""
    total = list(map(float, own))
    for k in range(len(total) - 1, 0, -1):
        if not page.apart[k]:
            total[page.parent[k]] += total[k]
    return total


def best(page: Page) -> tuple[int, float, bool]:
    """(container, score, whether no name speaks against it): a container has
    its blocks' score and half of that of each container directly inside; an
    article or main counts more, what is named as no part of the article next
    to nothing."""
    own, doubt = list(page.chars), [1.0] * len(page.chars)
    for k in range(1, len(own)):
        doubt[k] = DOUBT if page.apart[k] and page.tag[k] != "form" else doubt[page.parent[k]]
    for k in range(len(own) - 1, 0, -1):
        if not page.apart[k]:
            own[page.parent[k]] += 0.5 * own[k]
    score = [s * d * (1.5 if t in ("article", "main") else 1.0) for s, d, t in zip(own, doubt, page.tag, strict=True)]
    k = max(range(len(score)), key=lambda k: (score[k], -k))
    return k, score[k], doubt[k] == 1.0


def climbed(page: Page, roots: list[int], body: bool) -> set[int]:
    """Each container, or the highest above it up to which each one adds text
    that is not mostly links. The body, if it may be taken, must add mostly
    long blocks; an article or main is taken also if it adds nothing; what
    stands apart is neither left nor entered."""
    chars, text, links = (_sums(page, x) for x in (page.chars, page.text, page.links))
    found: set[int] = set()
    taken: set[int] = set()  # parents that an earlier one has climbed to
    for k in roots:
        at, up, way = k, k, []
        while not page.apart[up] and (up := page.parent[up]) >= 0 and up not in taken and not page.apart[up]:
            more = text[up] - text[at]
            if more and (not body or 2 * (chars[up] - chars[at]) < more if page.tag[up] in ("", "body") else 2 * (links[up] - links[at]) > more):
                break
            way.append(up)
            if more or page.tag[up] in ("article", "main"):
                at = up
                taken.update(way)
                way = []
        if up not in taken or at != k:
            found.add(at)
    return found


def chosen(page: Page) -> tuple[int, float, bool]:
    """(container, score, sure): where the best container climbs to, with the best one's."""
    k, score, sure = best(page)
    return min(climbed(page, [k], body=True)), score, sure


def text_at(page: Page, path: int | None) -> str:
    """The text of all containers at a path and where they climb to. Where there
    is none, that of the page's own choice, unless its name speaks against it."""
    roots = climbed(page, [k for k, p in enumerate(page.path) if p == path], body=False) if path is not None else set()
    if not roots:
        k, _, sure = chosen(page)
        roots = {k} if sure else set()
    inside = [False] * len(page.path)
    for k, p in enumerate(page.parent):  # parents come first
        inside[k] = k in roots or p >= 0 and inside[p] and not page.apart[k]
    return "\n\n".join(text for c, text in page.blocks if inside[c])


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def votes(pages: DataFrame) -> DataFrame:
    """host, html -> (host, path, sure, share): the path of the page's chosen
    container, whether no name speaks against it, and the best one's score as a
    share of the page's text, 0 to 1. Pages without text have no vote."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                rows = []
                for host, t in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                    page = parse(t.as_py() or "")
                    if page.blocks:
                        k, score, sure = chosen(page)
                        rows.append((host, _signed(page.path[k]), sure, min(1.0, score / max(1.0, 1.5 * sum(page.text)))))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "sure", "share"])

    return pages.select("host", "html").mapInArrow(run, "host string, path long, sure boolean, share double")


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winner; of equal votes the smaller path. Votes
    are whole millionths, so that the order of adding changes nothing. A path
    that names speak against needs the votes of two pages."""
    counted = votes(pages).groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"), F.max("sure").alias("sure"), F.count("*").alias("pages"))
    return counted.filter("votes > 0 and (sure or pages > 1)").groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null or empty html, and pages without text outside boilerplate, give the
    empty text. Pages without a host (null url, or no ://) share the empty
    host. Repeated rows and null ids stay; a page of any length or depth is
    read once from left to right, in memory that grows with its length; other
    columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    winners = written(consensus(base), "html-consensus")
    small = (winners.agg(F.sum(F.octet_length("host") + 64)).first()[0] or 0) <= BROADCAST_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "html"):
                paths = [None if p is None else p % (1 << 64) for p in b.column("path").to_pylist()]
                texts = [text_at(parse(t.as_py() or ""), p) for t, p in zip(b.column("html"), paths, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = base.join(F.broadcast(winners) if small else winners, "host", "left")
    return met.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
