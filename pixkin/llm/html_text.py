"""Main text of web pages, with site templates removed.

Element subtrees outside the prose are hashed by their tags and words and counted per host in Spark. Subtrees that go with several
different articles of a host are its template and are deleted, besides what a page's own tags and class names say is not its article.
Reading a page takes time in proportion to its length, however its tags are nested, left open or broken off.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import attach, attach_left, cut_lineage, small_batches, unused

#: A subtree that goes with at least so many different articles of a host, and this share of them, belongs to the host's template.
LEAST_ARTICLES, LEAST_SHARE = 5, 0.1
#: Up to so many template subtrees travel to the executors as arrays (8 MB); beyond, pages are joined to theirs.
BROADCAST_SUBTREES = 500_000

# Fixed values of the format: elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style title noscript template iframe nav footer aside form button select option datalist textarea input svg canvas object embed audio video map dialog menu noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CONTROLS = frozenset("form button select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COUNTED = frozenset("div nav section aside header footer ul ol dl form table menu".split())
BOXES = frozenset("div section aside ul ol dl table details figure ins nav header footer center".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table div section article main body html td th aside nav".split())
KEEPS_P = frozenset("table td th caption button object".split())
# Words of the names (classes and ids) of boxes that are no part of an article, and words that may stand beside them. A
# name counts if it is made of such words alone: "related-posts" is one, "related-work", "side-effects" and "no-comments" are none.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
BOX_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored promo promos promotion promoted banner sidebar side nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended "
    "recommendation recommendations widget widgets pagination pager toolbar skip".split()
)
NEUTRAL_WORDS = frozenset(
    "site main page primary secondary global top bottom left right header bar box boxes block blocks area section wrap wrapper container inner outer content list lists item items link links button buttons icon icons "
    "post posts article articles story stories news form thread unit slot row col column group panel module mobile desktop layer dialog message messages text to for by and the id".split()
)
SENTENCE_END = re.compile(r"[.!?…。！？؟।](?:$|[\s\"'”’»)\]])")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", re.I)

#: A tag's inside: quotes count after an equals sign only. No part is tried twice.
INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}


@lru_cache(4096)
def box_of(names: str) -> tuple[bool, bool]:
    """Whether one of the names in a class or id attribute says that a box is no part of an article, and whether one speaks of comments."""
    boxed = comment = False
    for name in names.split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if words & BOX_WORDS and words <= BOX_WORDS | NEUTRAL_WORDS:
            boxed, comment = True, comment or bool(words & COMMENT_WORDS)
    return boxed, comment


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    first: int  # of the page's parts
    out: bool = False  # not part of an article, by its tag or attributes
    boxed: bool = False  # by its name
    comment: bool = False  # by its name
    below: bool = False  # is a comment or inside of one
    named: bool = False
    control: bool = False  # is or directly holds a part of a form
    end: int = -1
    #: Texts and numbers of children, in page order.
    inside: list[str | int] = field(default_factory=list)
    dropped: bool = False
    article: int = -1  # the outermost article that it is in or is


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, text) in page order; a text of None is a block's edge.
    parts: list[tuple[int, str | None]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Elements and texts in page order, by a scan that closes what the format lets be left open. Tags that no '>' ends are left out with all after them."""
    page = Page([Element("", -1, 0)])
    elements, parts, stack = page.elements, page.parts, [0]
    places: dict[str, list[int]] = {}  # of the open elements of a tag, in the stack
    menus: list[int] = []  # and of those that are no part of an article

    def pop() -> None:
        e = elements[stack.pop()]
        e.end = len(parts)
        places[e.tag].pop()
        if menus and menus[-1] == len(stack):
            menus.pop()

    def close(to: int) -> None:
        while len(stack) > to:
            pop()
        parts.append((stack[-1], None))

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(raw: str) -> None:
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append((stack[-1], raw))
            elements[stack[-1]].inside.append(raw)

    at = shown = 0
    loose = False  # a tag whose quotes never end was met: quotes count no more
    while (at := html.find("<", at)) >= 0:
        if html.startswith(("<!", "<?"), at):
            text(html[shown:at])
            stop = html.find("-->", at + 4) + 3 if html.startswith("<!--", at) else html.find(">", at) + 1
            at = shown = stop if stop > 2 else len(html)
            continue
        closing = html.startswith("</", at)
        name = NAME.match(html, at + 1 + closing)
        if not name:
            at += 1
            continue
        text(html[shown:at])
        stop = None if loose else INSIDE.match(html, name.end())
        if stop is None:
            loose, after = True, html.find(">", name.end()) + 1
            if not after:
                shown = len(html)
                break
        else:
            after = stop.end()
        tag, inner = name[0].lower(), html[name.end() : after - 1]
        at = shown = after
        if closing:
            if places.get(tag):
                to = places[tag][-1]
                if tag in INLINE:
                    while len(stack) > to:
                        pop()
                else:
                    close(to)
            continue
        if tag in VOID:
            if tag == "input":
                elements[stack[-1]].control = True
            if tag not in INLINE:
                parts.append((stack[-1], None))
            continue
        if tag in CLOSES_P and places.get("p") and places["p"][-1] > nearest(KEEPS_P):
            close(places["p"][-1])
        if tag in SAME_CLOSES and (same := nearest(SAME_CLOSES[tag])) and same > nearest(STOPS - {tag}):
            close(same)
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(inner)} if inner.strip() else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}" if attributes else ""
        boxed, about = box_of(names) if names.strip() and tag not in ("html", "body", "main") else (False, False)
        if tag in ("article", "main") and not about and menus and not elements[stack[-1]].below:
            close(menus[0])  # an article is not part of a menu that was left open before it
        role = attributes.get("role", "").lower()
        e = Element(tag, stack[-1], len(parts), comment=about, below=about or elements[stack[-1]].below)
        e.out = tag in DROPPED or "hidden" in attributes or role in ROLES
        e.boxed = boxed and tag != "article"
        e.control = tag in CONTROLS
        e.named = tag == "main" or role == "main" or bool(names and CONTENT.search(names))
        elements[stack[-1]].inside.append(len(elements))
        elements.append(e)
        if tag not in INLINE:
            parts.append((len(elements) - 1, None))
        if e.out:
            menus.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(elements) - 1)
        if tag in RAW:
            end = ENDS[tag].search(html, at)
            parts.append((stack[-1], html[at : end.start() if end else len(html)]))
            at = shown = end.end() if end else len(html)
            pop()
    text(html[shown:])
    while stack:
        elements[stack.pop()].end = len(parts)
    decide(page)
    return page


def decide(page: Page) -> None:
    """Which elements are dropped. A box by its name alone ('has-sidebar', 'no-comments') that holds the page's article isn't one.

    The article is the main element, else the longest article (inside a box only if it has more than half of the page's prose outside of
    links, or no heading of first rank is there); comments are none. Without one, a box stays if it has more than half of the prose and the heading of first rank, or is no
    comment.
    """
    elements = page.elements
    out, links, boxed, size = ([x] * len(elements) for x in (False, False, False, 0))
    for i, e in enumerate(elements[1:], 1):
        out[i], links[i], boxed[i] = out[e.parent] or e.out, links[e.parent] or e.tag == "a", boxed[e.parent] or e.boxed
    for i, t in page.parts:
        if t and not out[i] and not links[i]:
            size[i] += len(t) - t.count(" ")
    for i in range(len(elements) - 1, 0, -1):
        size[elements[i].parent] += size[i]
    holds: set[int] = set()
    fine = [i for i, e in enumerate(elements) if not out[i] and (e.tag in ("main", "article") and not e.below or e.tag == "h1")]
    for tag, test in (("main", lambda i: True), ("article", lambda i: not boxed[i]), ("article", lambda i: 2 * size[i] > size[0]), ("h1", lambda i: not elements[i].below), ("article", lambda i: True), ("h1", lambda i: True)):
        if found := [i for i in fine if elements[i].tag == tag and test(i)]:
            j = max(found, key=lambda i: (size[i], -i))
            sure = tag != "h1"
            while j >= 0:
                if sure or 2 * size[j] > size[0]:
                    holds.add(j)
                j = elements[j].parent
            break
    else:
        holds.update(i for i, e in enumerate(elements) if 2 * size[i] > size[0] and not e.below)
    proved = evidence(page, out, links)
    for i, e in enumerate(elements[1:], 1):
        up = elements[e.parent]
        e.dropped = up.dropped or e.out or (e.boxed or e.comment) and i not in holds and proved[i] or e.tag == "header" and up.article < 0
        e.article = up.article if up.article >= 0 else i if e.tag == "article" and not e.dropped else -1


def evidence(page: Page, out: list[bool], links: list[bool]) -> list[bool]:
    """What besides its name says that an element is no part of the article it is in. Outside of articles, and of boxes of other kinds than an article has, a name is enough.

    Inside: half of its text or more is links, it holds a part of a form, an article of its own or no sentence, or it is about comments and holds a comment or is
    followed by boxes only.
    """
    elements = page.elements
    text, linked, other, comments, prose = ([x] * len(elements) for x in (0, 0, False, False, False))
    zone, hidden = [-1] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        zone[i] = zone[e.parent] if zone[e.parent] >= 0 else i if e.tag in ("article", "main") else -1
        hidden[i] = hidden[e.parent] or e.out or e.boxed or e.comment
        other[i] = e.control or e.tag == "article"
    last: dict[int, int] = {}
    for k, (i, t) in enumerate(page.parts):
        if t and not out[i]:
            size = len(t) - t.count(" ")
            text[i], linked[i], prose[i] = text[i] + size, linked[i] + size * links[i], prose[i] or bool(SENTENCE_END.search(t))
            if zone[i] >= 0 and not hidden[i] and not t.isspace():
                last[zone[i]] = k
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        text[e.parent], linked[e.parent] = text[e.parent] + text[i], linked[e.parent] + linked[i]
        other[e.parent], comments[e.parent], prose[e.parent] = other[e.parent] or other[i], comments[e.parent] or comments[i] or e.comment, prose[e.parent] or prose[i]
    found = []
    for i, e in enumerate(elements):
        inside = e.parent >= 0 and zone[e.parent] >= 0 or e.tag not in BOXES
        found.append(not inside or 2 * linked[i] >= text[i] or other[i] or not prose[i] or e.comment and (comments[i] or e.first > last.get(zone[i], -1)))
    return found


def texts_before(page: Page) -> np.ndarray:
    """Lengths of the kept texts before each part, in all."""
    return np.cumsum([0, *(len(t) if t and not page.elements[e].dropped else 0 for e, t in page.parts)])


def root(page: Page) -> int:
    """The element of the article: the longest article that isn't dropped, else main or what is named so, else the whole page."""
    before = texts_before(page)
    length = lambda i: int(before[page.elements[i].end] - before[page.elements[i].first])
    for choose in (lambda i, e: e.article == i, lambda i, e: e.named):
        found = [i for i, e in enumerate(page.elements) if i and not e.dropped and choose(i, e)]
        if found:
            return max(found, key=lambda i: (length(i), -i))
    return 0


def under(page: Page, top: int, cut: frozenset[int] | set[int] = frozenset()) -> str:
    """The text under an element, without what is dropped or cut: blocks joined by one space, white space inside them made one space."""
    e = page.elements
    keep: dict[int, bool] = {top: not e[top].dropped and top not in cut}
    head = {top: False}
    out = []
    for i, t in page.parts[e[top].first : e[top].end]:
        chain, j = [], i
        while j not in keep:
            chain.append(j)
            j = e[j].parent
            if j < 0:
                keep[j], head[j] = False, False
        for k in reversed(chain):
            p = e[k].parent
            in_head = head[p] or e[k].tag == "header"
            head[k] = in_head and e[k].tag not in HEADINGS
            keep[k] = keep[p] and not e[k].dropped and k not in cut
        out.append(" " if t is None else t if keep[i] and not head[i] else "")
    return " ".join("".join(out).split())


def subtrees(page: Page, top: int) -> dict[int, int]:
    """Hashes, by element, of the containers that may be a template's: not the article nor what holds it. A hash is made of the tag, the texts and the children's hashes."""
    holds, j = set(), top
    while j >= 0:
        holds.add(j)
        j = page.elements[j].parent
    hashes = [0] * len(page.elements)
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        made = xxhash.xxh64(e.tag.encode("utf-8", "surrogatepass"))
        for x in e.inside:
            made.update(b"\1" + hashes[x].to_bytes(8, "little") if isinstance(x, int) else b"\0" + " ".join(x.split()).encode("utf-8", "surrogatepass"))
        hashes[i] = made.intdigest()
    return {i: hashes[i] - 2**63 for i, e in enumerate(page.elements) if e.tag in COUNTED and i not in holds}


def candidates(html: str | None) -> tuple[int, list[int]]:
    """A hash of the article and those of the page's containers."""
    page = parse(html or "")
    top = root(page)
    return xxhash.xxh64_intdigest(under(page, top).encode("utf-8", "surrogatepass")) - 2**63, sorted(set(subtrees(page, top).values()))


def main_text(html: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    page = parse(html or "")
    top = root(page)
    cut = {i for i, h in subtrees(page, top).items() if h in template} if template else frozenset()
    return under(page, top, cut)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(rows: DataFrame, least: int = LEAST_ARTICLES, share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(site, subtree, n) of the subtrees that go with ``least`` different articles of a site and ``share`` of all its articles, and (site, key, subtree) of all pages. rows: site, key, html."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int | None]] = []
            for site, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                article, found = candidates(text.as_py())
                out.extend((site, key, article, h) for h in (None, *found))  # a row without a subtree counts the article
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), (), ()))], ["site", "key", "article", "subtree"])

    seen = cut_lineage(rows.select("site", "key", "html").mapInArrow(hashed, "site long, key long, article long, subtree long").distinct())
    hosts = seen.groupBy("site").agg(F.count_distinct("article").alias("of"))
    seen = seen.where("subtree is not null")
    often = cut_lineage(seen.groupBy("site", "subtree").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("n")).where(F.col("articles") >= least))
    hosts = cut_lineage(hosts.join(often.groupBy("site").agg(F.count("*").alias("subtrees")), "site"))
    found = attach(often, hosts, ["site"], "subtrees", max(1, often.count())).where(F.col("articles") >= share * F.col("of"))
    return cut_lineage(found.select("site", "subtree", "n")), seen.select("site", "key", "subtree")


def extract(pages: DataFrame, *, html: str = "html", url: str = "url", least: int = LEAST_ARTICLES, share: float = LEAST_SHARE, broadcast: int = BROADCAST_SUBTREES) -> DataFrame:
    """``pages`` with ``text`` (empty if none) instead of the html column; every row is kept.

    A null html is an empty page; rows without a host (null or odd urls) form one of their own. Copies of an article count once, so
    that they are no template; what a few articles of a large host share is their own text. Long pages count whole. A column ``text`` of
    ``pages`` is replaced, other columns may have any names. An empty table gives no rows.
    """
    pages = small_batches(pages)
    pages = pages.drop("text") if html != "text" else pages
    s, k, h, found = unused(pages, "page_site", "page_key", "page_html", "page_subtrees")
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    source = F.coalesce(F.col(html).cast("string"), F.lit(""))
    keyed = pages.select(*others, F.xxhash64(host(F.col(url))).alias(s), F.xxhash64(source).alias(k), source.alias(h))
    template, seen = templates(keyed.select(F.col(s).alias("site"), F.col(k).alias("key"), F.col(h).alias("html")), least, share)
    kinds = "".join(f"`{c}` {t}, " for c, t in pages.dtypes if c != html)

    def cleaned(subtrees_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.num_columns
                text = [main_text(x.as_py(), subtrees_of(y)) for x, y in zip(b.column(n - 1), b.column(n - 2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n - 2)), pa.array(text, pa.string())], [*b.schema.names[: n - 2], "text"])

        return run

    if template.count() <= broadcast:
        table = template.select("site", "subtree").orderBy("site", "subtree").toArrow()  # ``broadcast`` rows at most
        arrays = pages.sparkSession.sparkContext.broadcast((table["site"].to_numpy(), table["subtree"].to_numpy()))

        def of_site(site: int) -> frozenset[int]:
            sites, subtree = arrays.value
            return frozenset(subtree[np.searchsorted(sites, site, "left") : np.searchsorted(sites, site, "right")].tolist())

        return keyed.select(*others, s, h).mapInArrow(cleaned(of_site), f"{kinds}text string")
    met = attach(seen, template, ["site", "subtree"], "n", max(1, seen.count())).groupBy(F.col("site").alias(s), F.col("key").alias(k)).agg(F.collect_set("subtree").alias(found))
    return attach_left(keyed, met, [s, k]).select(*others, found, h).mapInArrow(cleaned(lambda x: frozenset(x or ())), f"{kinds}text string")


def page_report(pages: DataFrame) -> DataFrame:
    """The digest: page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
