"""Main text of web pages by consensus host paths.

Every page's containers are scored; the pages of a host vote, in Spark, on the generalised tag-class
path of the best one; each page is then extracted from the containers on its host's winning path, or
from its own best one where the page has no such container.

A path is named by a hash of the tags and class words on it. Defined results: null or empty html gives an empty
text; a page of any depth takes memory for its elements only; pages with a null or unusual url vote as one
host of an empty name; repeated rows stay, each with its text; ties of votes go to the higher score,
then to the path that sorts last.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import stored

#: Up to so many hosts (with a path of 24 characters each) the winning paths are broadcast; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 20_000
#: Shares that a host's pages are dealt into when the winning paths are joined by shuffle.
HOST_SALTS = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
CLASSES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
DROPPED = frozenset("head nav footer aside form menu button select option object canvas audio video".split())
#: Elements whose text is the article's only inside an article or main.
OUTSIDE = frozenset("header dialog label fieldset legend".split())
#: Elements that their class words never drop: what is inside a line.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Boxes, the only elements that class words drop inside an article or main.
BOXES = frozenset("aside details dialog div dl fieldset footer form header iframe nav ol section table ul".split())
#: Words in a class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended comment comments disqus respond reply replies "
    "widget toolbar pagination pager search login complementary contentinfo".split()
)
#: Words that mark boilerplate only beside words of these.
WEAK = frozenset("related search social alert login".split())
BESIDE = WEAK | BOILERPLATE | frozenset("posts post articles article links link stories story list box bar block area section container wrapper inner outer top bottom left right icons buttons form items item content page media news".split())
#: Words of the edges of a page, and those that they may stand beside; inside an article or main they mark nothing.
EDGES = frozenset("header top topbar copyright branding logo".split())
EDGES_BESIDE = EDGES | frozenset("site global page brand bar wrapper container inner outer box area".split())
#: A class that starts so says what is there, or not, beside the element's own text.
ABOUT = frozenset("no not non without has have with is".split())
MAIN = frozenset("article main".split())
#: Share of a page's text that makes a container the whole page's.
NEARLY_ALL = 0.9
#: Share of what a page's own best container holds that the host's path has to hold on the page.
FAIR = 0.5
CONTAINERS = frozenset("html body article main section div td center".split())
#: A start tag of the left closes an open element of the right, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    path: str
    main: bool


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (text, nearest container, characters inside links) in page order
    blocks: list[tuple[str, int, int]] = field(default_factory=list)
    #: characters of the page, and of each element (by its number) that its class words mark, without those marked in it
    size: int = 0
    marked: dict[int, int] = field(default_factory=dict)
    #: of each marked element, the next one around it that is marked, if any
    around: dict[int, int | None] = field(default_factory=dict)
    #: of each article or main, the number of the next marked element around it, if any
    mains: list[int | None] = field(default_factory=list)


def label(tag: str, words: list[str]) -> str:
    return ".".join([tag, *words])


def below(path: str, name: str) -> str:
    """A path's name, of a fixed size however deep it is, from that of the container around it."""
    return hashlib.blake2b(f"{path}/{name}".encode(), digest_size=12).hexdigest()


def marks(token: str, in_main: bool) -> bool:
    """Whether a class, id or role marks boilerplate."""
    words = WORD.findall(token)
    if not in_main and EDGES.intersection(words) and EDGES_BESIDE.issuperset(words):
        return True
    found = BOILERPLATE.intersection(words)
    if not found or words[0] in ABOUT and len(words) > 1:
        return False
    return not found <= WEAK or BESIDE.issuperset(words)


def parse(source: str) -> Page:
    """The containers and text blocks of a page, without boilerplate.

    Where no article or main stays otherwise, the marked elements do that hold one, all around it at once, or nearly all
    of the text.
    """
    kept: set[int] = set()
    while True:
        page = _parsed(source, kept)
        if None in page.mains:
            return page
        more: set[int] = set()
        for number in page.mains:
            while number is not None and number not in more:
                more.add(number)
                number = page.around[number]
        whole = dict(page.marked)
        for number in sorted(whole, reverse=True):  # an element comes after those around it
            if (outer := page.around[number]) is not None:
                whole[outer] += whole[number]
        more |= {k for k, n in whole.items() if n >= NEARLY_ALL * page.size > 0}
        if not more:
            return page
        kept |= more


def _parsed(source: str, kept: set[int]) -> Page:
    """A page without what tags and class words drop, but for the elements of the numbers ``kept``."""
    page = Page(nodes=[Node("", -1, "", False)])
    # tag, nearest container, inside boilerplate, dropped by its tag or one around it, number of the next marked element
    open_: list[tuple[str, int, bool, bool, int | None]] = []
    tags: Counter[str] = Counter()  # of the open elements
    number = 0
    text: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            if block:
                page.blocks.append((block, open_[-1][1] if open_ else 0, links))
            text.clear()
        links = 0

    def said(raw: str) -> None:
        nonlocal links
        if raw and not (open_ and open_[-1][3]):
            n = len(raw.strip())
            page.size += n
            if open_ and open_[-1][4] is not None:
                page.marked[open_[-1][4]] += n
        if raw and not (open_ and open_[-1][2]):
            s = entities.unescape(raw) if "&" in raw else raw
            text.append(s)
            if in_link:
                links += len(s.strip())

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            said(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "a" and in_link:
                in_link -= 1
            if tag in BLOCKS:
                flush()
            while tags[tag]:
                closed = open_.pop()[0]
                tags[closed] -= 1
                if closed == tag:
                    break
            continue
        if tag == "br":
            said(" ")
            continue
        if tag in BLOCKS:
            flush()
            if open_ and open_[-1][0] in CLOSES.get(tag, ()):
                tags[open_.pop()[0]] -= 1
            for k in range(len(open_) - 1, -1, -1) if tags["p"] else ():
                if open_[k][0] == "p":
                    tags.subtract(x[0] for x in open_[k:])
                    del open_[k:]
                    break
                if open_[k][0] in BLOCKS:
                    break
        if tag in VOID:
            continue
        if tag == "a":
            in_link += 1
        outer, inside, by_tag, by_class = open_[-1][1:] if open_ else (0, False, False, None)
        number += 1
        attrs = m["attrs"] or m["attrs2"] or ""
        classes = [t for a in CLASSES.finditer(attrs) for t in (a[2] or a[3] or a[4] or "").lower().split()] if attrs else []
        words = [w for t in classes for w in WORD.findall(t)]
        in_main = page.nodes[outer].main
        by_tag = by_tag or tag in DROPPED or tag in OUTSIDE and not in_main
        may = tag in BOXES if in_main else tag not in INLINE and tag not in ("html", "body")
        if may and not by_tag and number not in kept and any(marks(t, in_main) for t in classes):
            page.around[number], by_class = by_class, number
            page.marked[number] = 0
        dropped = inside or by_tag or by_class is not None
        if tag in MAIN and not by_tag:
            page.mains.append(by_class)
        if tag in CONTAINERS and not dropped:
            main = in_main or tag in MAIN or "main" in words or "articlebody" in words
            page.nodes.append(Node(tag, outer, below(page.nodes[outer].path, label(tag, sorted(set(words)))), main))
            outer = len(page.nodes) - 1
        open_.append((tag, outer, dropped, by_tag, by_class))
        tags[tag] += 1
    if at < len(source):
        said(source[at:])
    flush()
    return page


def scores(page: Page) -> dict[int, float]:
    """Score of each container: its own text counts in full, that of its child containers in half, and so on;
    text in links counts against it, and containers marked as the main one weigh ten times."""
    held = [0.0] * len(page.nodes)
    seen = [False] * len(page.nodes)
    for text, node, links in page.blocks:
        held[node] += max(0, len(text) - 2 * links)
        seen[node] = True
    for k in range(len(held) - 1, 0, -1):  # a container comes after those around it
        held[page.nodes[k].parent] += held[k] / 2
        seen[page.nodes[k].parent] |= seen[k]
    return {k: v * (10 if page.nodes[k].main else 1) for k, v in enumerate(held) if seen[k]}


def best(page: Page) -> tuple[str, float] | None:
    """Path and score of a page's best container; the first in page order wins ties."""
    found = scores(page)
    if not found:
        return None
    node = max(found, key=lambda k: (found[k], -k))
    # of nested main containers, the outermost has all of the article; others may be one part of several
    if page.nodes[node].main:
        while (up := page.nodes[node].parent) >= 0 and page.nodes[up].main:
            node = up
    else:
        whole = [0] * len(page.nodes)
        for text, k, links in page.blocks:
            whole[k] += max(0, len(text) - 2 * links)
        for k in range(len(whole) - 1, 0, -1):  # a container comes after those around it
            whole[page.nodes[k].parent] += whole[k]
        while whole[node] < NEARLY_ALL * whole[0]:
            node = page.nodes[node].parent
    return page.nodes[node].path, found.get(node, 0.0)


def extract(source: str, path: str | None) -> str:
    """The text blocks in the containers on ``path``, a line each, if they hold a fair share of what the page's own
    best container holds; else those in that one."""
    page = parse(source)
    own = best(page)
    if own is None:
        return "\n".join(text for text, _, _ in page.blocks)
    found, mine = inside(page, path), inside(page, own[0])
    size = lambda held: sum(max(0, len(text) - 2 * links) for text, node, links in page.blocks if held[node])
    if not any(found[node] for _, node, _ in page.blocks) or size(found) < FAIR * size(mine):
        found = mine
    return "\n".join(text for text, node, _ in page.blocks if found[node])


def inside(page: Page, path: str | None) -> list[bool]:
    """Of each container, whether it is on ``path`` or in one that is."""
    found: list[bool] = []
    for n in page.nodes:
        found.append(n.path == path or n.parent >= 0 and found[n.parent])
    return found


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and the winning path of its pages: the one that is best on most pages."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(h, *b) for h, source in zip(batch["host"], batch["html"]) if (b := best(parse(source)))]
            yield pd.DataFrame(found, columns=["host", "path", "score"])

    read = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    cast = read.mapInPandas(votes, "host string, path string, score double")
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path"))["path"].alias("path"))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``output`` (replacing a column of that name)."""
    winners = stored(host_paths(pages, url, html), "host-paths")
    row = F.struct(*[pages[c] for c in pages.columns]).alias("row")
    marked = pages.select(row, host_of(pages[url]).alias("host"), pages[html].cast("string").alias("html"), F.xxhash64(pages[url], pages[html]).alias("h"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = marked.join(F.broadcast(winners), "host", "left")
    else:  # a large host's pages go to many tasks
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
        joined = marked.withColumn("salt", F.pmod("h", F.lit(HOST_SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([extract(s or "", p) for s, p in zip(sources, paths)], dtype=object)

    made = joined.select("row", extracted("html", "path").alias("made"))
    return made.select(*[F.col("row")[c].alias(c) for c in pages.columns if c != output], F.col("made").alias(output))
