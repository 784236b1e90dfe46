"""Main text of web pages by removal of site templates.

A page is read into elements once. Every block element's subtree, on the whole
page, is hashed from its markup, and Spark counts, for each host, on how many
different articles' pages a subtree stands. Subtrees on ``MIN_PAGES`` pages or
more, and on a share of ``SHARE`` of the host's different pages or more, are the
site's template and are deleted: a paragraph that a few pages of a large host
have in common is none. Besides, elements that say what they are (by tag, role
or class: menus, footers, adverts, forms, comments and the like) are deleted;
inside an article or ``main`` that holds for containers alone, and for a class
or id only if all its parts are such names.
The main element is the article, else ``main``, else the body. An article or
``main`` counts where it holds half or more of the text that the template
leaves of its page; else the page's text is all that is left of the body. In an
article or ``main``, paragraphs and headings are never taken for template, only
containers are, so that sentences which many articles share stay. Copies of one
article count as one page, so a repeated article is not its own template.

Counting is by (host, subtree) with partial aggregation, so a host with a third
of all pages is no group of its own. Subtrees that a page shares with its site
are sent back to it by a join on the page.

Defined results: a null or empty page has an empty text; a null url is a host of
its own; malformed markup is read as browsers do (implied ends, stray end tags
ignored, raw text in scripts). Equal rows get equal results. White space runs,
no-break spaces included, become one space inside a block; blocks are joined by
line feeds. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES = 3
SHARE = 0.2

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements that take no part in lines: all others start and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small"
                   " span strike strong sub sup time tt u var wbr".split())
# A start tag ends these open elements, up to the nearest stated boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
KEEPS_P = frozenset("table".split())
DROPPED_TAGS = frozenset("head script style nav footer aside form noscript template iframe svg button select dialog menu"
                         " textarea title audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar"
                          " toolbar tablist note".split())
DROPPED_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion"
                          " cookie cookies consent gdpr notice notices alert popup modal overlay sidebar rail comment"
                          " comments disqus respond replies nav navbar navigation menu breadcrumb breadcrumbs footer"
                          " masthead topbar share sharing social related recommended newsletter subscribe signup login"
                          " widget widgets pagination pager skip toolbar".split())
# Elements of the main text itself, which are no template however often they recur.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead blockquote pre figcaption".split())
PROTECTED = frozenset(("html", "body", "article", "main"))


class Page:
    """The elements and texts of a page."""

    def __init__(self, html: str):
        self.html = html
        # tag, attributes, start, end, parent, dropped
        self.tag, self.attrs, self.start, self.end, self.parent = ["#"], [""], [0], [len(html)], [-1]
        self.texts: list[tuple[int, int, str]] = []  # (element, block, raw text)
        self.hash = [0]
        stack, block, at, pos = [0], 0, 0, 0
        tag, parent = self.tag, self.parent
        # A subtree's hash is made of its start tag, its texts and its children's
        # hashes as they end, so that a page is read once, however deep it is.
        hashes, opened = [xxhash.xxh3_64()], Counter()

        def seen(markup: str) -> None:
            hashes[-1].update(markup.encode("utf-8", "surrogatepass"))

        def close_to(depth: int, where: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                self.end[i] = where
                opened[tag[i]] -= 1
                self.hash[i] = hashes.pop().intdigest() - (1 << 63)
                hashes[-1].update(self.hash[i].to_bytes(8, "little", signed=True))

        n = len(html)
        while at < n:
            m = TAG.search(html, at)
            upto = m.start() if m else n
            if upto > pos:
                self.texts.append((stack[-1], block, html[pos:upto]))
                seen(html[pos:upto])
            if not m:
                break
            at = pos = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == name), 0) if opened[name] else 0
                if k and name in INLINE and any(tag[stack[j]] not in INLINE for j in range(k + 1, len(stack))):
                    continue  # an inline end tag does not end the blocks inside
                if k:
                    close_to(k, at)
                if name not in INLINE:
                    block += 1
                continue
            if name == "br":
                self.texts.append((stack[-1], block, " "))
                seen(m[0])
                continue
            if name not in INLINE:
                block += 1
                if name not in KEEPS_P:
                    # A block ends an open paragraph, with what is open in it.
                    k = next((k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == "p"
                              or tag[stack[k]] not in INLINE), 0)
                    if k and tag[stack[k]] == "p":
                        close_to(k, m.start())
                if name in ENDS:
                    ended, bounds = ENDS[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if tag[stack[k]] in bounds:
                            break
                        if tag[stack[k]] in ended:
                            close_to(k, m.start())
                            break
            if name in VOID:
                seen(m[0])
                continue
            tag.append(name)
            opened[name] += 1
            self.hash.append(0)
            hashes.append(xxhash.xxh3_64())
            seen(m[0])
            self.attrs.append(m[3] or m[6] or "")
            self.start.append(m.start())
            self.end.append(n)
            parent.append(stack[-1])
            stack.append(len(tag) - 1)
            if name in RAW:
                shut = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
                seen(html[at:shut.end() if shut else n])
                at = pos = shut.end() if shut else n
                close_to(len(stack) - 1, at)
        close_to(1, n)
        self._mark()

    def _says_so(self, i: int, by_name: bool, inside: bool) -> bool:
        """Whether an element states that it is no main text; ``by_name``: in
        its attributes, not only by its tag. ``inside`` an article or ``main``,
        paragraphs, headings and the like are text whatever their names, and a
        container's class or id must be made of such names alone."""
        name = self.tag[i]
        if name in PROTECTED and name != "article":
            return False
        if name in DROPPED_TAGS or not by_name:
            return name in DROPPED_TAGS
        for m in ATTRIBUTE.finditer(self.attrs[i]) if self.attrs[i].strip(" /") else ():
            key, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in DROPPED_ROLES:
                return True
            if key in ("class", "id"):
                words = [set(re.split(r"[^a-z0-9]+", w)) - {""} for w in value.split()]
                if inside and name in CONTENT:
                    continue
                if any(w and (w <= DROPPED_NAMES if inside else w & DROPPED_NAMES) for w in words):
                    return True
        return False

    def _mark(self) -> None:
        n = len(self.tag)
        self.dropped, in_main = [False] * n, [False] * n
        # What holds the longest article is no sidebar, whatever its class
        # says, unless that is a small part of a main element.
        size = lambda i: self.end[i] - self.start[i]
        holds, j = set(), max((i for i in range(1, n) if self.tag[i] == "article"), key=size, default=0)
        main = max((i for i in range(1, n) if self.tag[i] == "main"), key=size, default=0)
        j = main if main and (not j or 2 * size(j) < size(main)) else j
        while j > 0:
            j = self.parent[j]
            holds.add(j)
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.tag[self.parent[i]] in ("article", "main")
            self.dropped[i] = self.dropped[self.parent[i]] or self._says_so(i, i not in holds, inside[i])
        live = [i for i in range(1, n) if not self.dropped[i]]
        for name in ("article", "main", "body"):
            self.main = {i for i in live if self.tag[i] == name}
            if self.main:
                break
        else:
            self.main = {0}
        self.whole_body = not any(self.tag[i] in ("article", "main") for i in self.main)
        for i in range(n):
            in_main[i] = i in self.main or i > 0 and in_main[self.parent[i]]
        # A site's header may stand inside the main element; an article's own has a heading.
        headed = {i for i in range(1, n) if self.tag[i] == "header"}
        has_heading = [False] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            if has_heading[i] or self.tag[i] in ("h1", "h2", "h3"):
                has_heading[self.parent[i]] = True
        headed = {i for i in headed if not has_heading[i]}
        for i in range(1, n):
            if i in headed or self.tag[i] == "header" and not in_main[i]:
                self.dropped[i] = True
            self.dropped[i] = self.dropped[i] or self.dropped[self.parent[i]]
        self.in_main = in_main

    def article(self) -> int:
        """Hash of the main element, or of all that may be text on a page whose
        main element holds less than half of it."""
        size = [0, 0]
        for i, _, raw in self.texts:
            if not self.dropped[i]:
                size[self.in_main[i]] += _size(raw)
        if size[True] < size[False]:
            of = "\0".join(raw for i, _, raw in self.texts if not self.dropped[i])
        else:
            i = min(self.main)
            of = self.html[self.start[i]:self.end[i]]
        return xxhash.xxh3_64_intdigest(of.encode("utf-8", "surrogatepass")) - (1 << 63)

    def subtrees(self) -> list[tuple[int, int]]:
        """(element, hash) of the subtrees that may be template."""
        out = []
        for i in range(1, len(self.tag)):
            name = self.tag[i]
            if name in INLINE or name in PROTECTED or name in RAW or name == "head":
                continue
            if self.in_main[i] and not self.whole_body and name in CONTENT:
                continue
            out.append((i, self.hash[i]))
        return out

    def parts(self) -> tuple[list[tuple[int, int, str, bool]], list[tuple[int, int]]]:
        """What may be text: (block, node, raw text, in the main element)
        pieces, and the nodes: (the node around it, or -1; its hash), outer ones
        first, of the subtrees that may be template."""
        own = dict(self.subtrees())
        at, nodes = [-1], []
        for i in range(1, len(self.tag)):
            up = at[self.parent[i]]
            if i in own:
                nodes.append((up, own[i]))
                up = len(nodes) - 1
            at.append(up)
        pieces = [(block, at[i], raw, self.in_main[i]) for i, block, raw in self.texts if not self.dropped[i]]
        return pieces, nodes

    def text(self, template: set[int]) -> str:
        return join_parts(*self.parts(), template)


def _size(raw: str) -> int:
    """Characters of a raw text, without white space."""
    return sum(map(len, raw.split()))


def join_parts(pieces: list[tuple[int, int, str, bool]], nodes: list[tuple[int, int]], template: set[int]) -> str:
    """The text of the pieces that stand in no template subtree: those in the
    main element, if they are half of them or more."""
    stays = []
    for up, h in nodes:
        stays.append(h not in template and (up < 0 or stays[up]))
    left = [p for p in pieces if p[1] < 0 or stays[p[1]]]
    size = [0, 0]
    for p in left:
        size[p[3]] += _size(p[2])
    whole = size[True] < size[False]
    blocks: dict[int, list[str]] = {}
    for block, _, raw, main in left:
        if whole or main:
            blocks.setdefault(block, []).append(raw)
    # References are decoded within a piece: one cut by markup is none.
    lines = (" ".join("".join(map(unescape, b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def _keyed(pages: DataFrame) -> DataFrame:
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long"), url.alias("url"), html.alias("html"), host.alias("host"),
                        common.key64(F.lit(1), F.col("page_id"), url, html).alias("k1"),
                        common.key64(F.lit(2), html, F.col("page_id"), url).alias("k2"))


def template_subtrees(pages: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(k1, k2, template): the hashes of a page that its host's pages share."""
    schema = pa.schema([("host", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("article", pa.int64()),
                        ("tree", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, k1, k2, html in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                page = Page(html)
                article = page.article()
                # The row without a subtree counts the page.
                out += [(host, k1, k2, article, h) for h in {None, *(h for _, h in page.subtrees())}]
            if out:
                yield common.batch_of(schema, list(map(list, zip(*out, strict=True))))

    rows = common.cut(pages.select("host", "k1", "k2", "html").mapInArrow(
        run, "host string, k1 long, k2 long, article long, tree long").withColumn("host", F.xxhash64("host")))
    often = (rows.select("host", "tree", "article").distinct().groupBy("host", "tree").count()
             .filter(F.col("count") >= min_pages))
    often = common.cut(often)
    n = often.filter("tree IS NULL").select("host", F.col("count").alias("n"))
    shared = (often.filter("tree IS NOT NULL").join(common.sent_whole(n), "host")
              .filter(F.col("count") >= share * F.col("n")).select("host", "tree"))
    return (rows.select("host", "tree", "k1", "k2").join(shared, ["host", "tree"])
            .groupBy("k1", "k2").agg(F.collect_set("tree").alias("template")))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    import zstandard

    common.small_batches(pages.sparkSession)
    pages = _keyed(pages)
    read = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("parts", pa.binary())])
    done = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    # What is moved to meet the template is the main text alone, packed.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            got = [pack(pickle.dumps(Page(html).parts())) for html in b.column(4).to_pylist()]
            yield common.batch_of(read, [*(b.column(i) for i in range(4)), got])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            got = [join_parts(*pickle.loads(unpack(p)), set(t or ()))
                   for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield common.batch_of(done, [b.column(0), b.column(1), got, [len(x) for x in got]])

    parts = pages.select("page_id", "url", "k1", "k2", "html").mapInArrow(
        cut, "page_id long, url string, k1 long, k2 long, parts binary")
    return (parts.join(template_subtrees(pages, min_pages, share), ["k1", "k2"], "left")
            .select("page_id", "url", "parts", "template")
            .mapInArrow(finish, "page_id long, url string, text string, n_chars long"))
