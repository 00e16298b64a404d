"""Main text of web pages by site template removal.

A first pass hashes the element subtrees of every page; Spark counts in how many different bodies of its host each subtree stands. A second
pass deletes subtrees that recur across several bodies of the host, together with elements that are furniture by their tag, role or class,
and joins the blocks that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, pieces

#: A subtree is a template if it stands on so many pages of a host with different bodies.
MIN_PAGES = 5
#: Templates (host and hash) that may be broadcast; beyond it each page is joined with those of its own.
BROADCAST_TEMPLATES = 200_000

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title canvas audio video noembed noframes xmp".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption".split())
BLOCK = PROSE | frozenset("address article aside body center details dialog dir div dl fieldset figure footer form header hgroup html hr main menu nav ol section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - frozenset("li dt dd td th tr tbody thead tfoot caption figcaption body html summary".split())
#: An opening tag ends an open element of these tags, as far as the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
FURNITURE = frozenset("head nav footer aside button select datalist dialog menu fieldset label input option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Class names that say that an element is no article: alone, as the noun that a compound ends in, or as the word that it starts with.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login paywall sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar comment comments commentlist disqus respond replies".split()
)
STARTS = frozenset("ad ads advert adsense sponsored cookie comment comments nav menu sidebar footer newsletter breadcrumb pagination disqus".split())
#: First words of class names that tell a page's layout.
LAYOUT = frozenset("has with no without is show hide hides use two one left right".split())
#: Class names of boxes that are no article if most of their text is links.
LINKED = frozenset("related share sharing social recommended recommendations outbrain taboola widget widgets promo promos promotion skip tags more popular".split())
#: Share of link text that makes a list of links, and of a page's running text that makes an element its frame.
LINKS, FRAME = 0.6, 0.5
ROOTS = frozenset("html body article main".split())


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class name and of the id."""
    spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()
    return [w for w in ([x for x in re.split(r"[^a-z]+", name) if x] for name in spaced.split()) if w]


def furniture(tag: str, attrs: dict[str, str], in_article: bool, linked: bool) -> bool:
    """Whether an element is no part of the article by its tag, role, class or id; linked: most of its text is links."""
    if tag in FURNITURE or tag == "form" or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    for w in names(attrs):
        if w[0] in LAYOUT and len(w) > 1:
            continue
        if w[-1] in NAMES or w[0] in STARTS or linked and not LINKED.isdisjoint(w):
            return True
        if "header" in w and {*w} <= {"header", "site", "page", "global", "top"} and not in_article:
            return True
    return False


class Page:
    """Elements of a page in a row: parent, tag, attributes, and the pieces (texts, element numbers) in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.attrs = [-1], ["#root"], [{}]
        self.pieces: list[list[str | int]] = [[]]
        stack, at, size = [0], 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(stack, html[at:])
                break
            if m.start() > at:
                self._text(stack, html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if not m[3].rstrip().endswith("/"):
                    at = end.end() if end else size if tag in ("script", "style", "template") else at
            else:
                self._open(stack, tag, m[3])

    def _text(self, stack: list[int], text: str) -> None:
        self.pieces[stack[-1]].append(text)

    def _until(self, stack: list[int], tags: frozenset | set, stops: frozenset | set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in tags:
                del stack[k:]
                return
            if t in stops:
                return

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        if tag in ENDS:
            self._until(stack, *ENDS[tag])
        if tag in CLOSES_P:
            self._until(stack, {"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote", "table", "aside", "nav", "body"})
        n = len(self.tag)
        self.pieces[stack[-1]].append(n)
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.attrs.append(attributes(attrs))
        self.pieces.append([])
        if tag not in VOID:
            stack.append(n)

    def _close(self, stack: list[int], tag: str) -> None:
        stops = {"article", "main", "body"} - {tag} if tag not in ("html", "body", "article", "main") else {"html"} - {tag}
        self._until(stack, {tag}, stops)

    def hashes(self) -> list[int]:
        """A hash of each element's subtree: its tag, its texts with white space made one, and its elements."""
        out = [0] * len(self.tag)
        for n in range(len(self.tag) - 1, -1, -1):  # elements follow their parents
            parts = [self.tag[n]]
            for p in self.pieces[n]:
                parts.append(f"\x01{out[p]:x}" if isinstance(p, int) else " ".join(unescape(p).split()))
            out[n] = xxhash.xxh3_64_intdigest("\x00".join(x for x in parts if x)) - 2**63
        return out

    def inside(self) -> list[bool]:
        """Whether each element lies in an article or a main element."""
        out = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            p = self.parent[n]
            out[n] = out[p] or self.tag[p] in ("article", "main") or self.attrs[p].get("role") == "main"
        return out

    def template_hashes(self) -> tuple[int, set[int]]:
        """The body's hash, or the whole page's where there is none; hashes of the subtrees that may be templates: blocks with content, but neither roots nor the prose of an article."""
        hashes, inside = self.hashes(), self.inside()
        body = next((hashes[n] for n, t in enumerate(self.tag) if t == "body"), hashes[0])
        return body, {hashes[n] for n, t in enumerate(self.tag) if t in BLOCK and t not in ROOTS and self.pieces[n] and not (inside[n] and t in PROSE)}

    def weights(self) -> tuple[list[int], list[int], list[int]]:
        """Letters of each element's subtree, those in links among them, and the number of links."""
        size = len(self.tag)
        total, linked, links = [0] * size, [0] * size, [0] * size
        for n in range(size - 1, -1, -1):
            total[n] += sum(len("".join(p.split())) for p in self.pieces[n] if isinstance(p, str))
            if self.tag[n] == "a":
                linked[n], links[n] = total[n], 1
            if n:
                up = self.parent[n]
                total[up], linked[up], links[up] = total[up] + total[n], linked[up] + linked[n], links[up] + links[n]
        return total, linked, links

    def marked(self, inside: list[bool], weights: tuple[list[int], list[int], list[int]]) -> list[bool]:
        """The elements that are furniture by what they are called, or as lists of links outside an article."""
        out = [False] * len(self.tag)
        for n, (t, attrs, total, linked, links) in enumerate(zip(self.tag, self.attrs, *weights, strict=True)):
            dense = links > 0 and linked >= LINKS * total
            listed = dense and links > 1 and t in BLOCK and t not in ROOTS and not inside[n]
            out[n] = n > 0 and (listed or furniture(t, attrs, inside[n] or t == "article", dense))
        return out

    def _roots(self, gone: list[bool]) -> list[int]:
        size = len(self.tag)
        roots = [n for n in range(1, size) if self.tag[n] == "article" and not gone[n] and not self._within(n, {"article"})]
        return roots or [n for n in range(1, size) if (self.tag[n] == "main" or self.attrs[n].get("role") == "main") and not gone[n]][:1]

    def _below(self, own: list[bool]) -> list[bool]:
        gone = own.copy()
        for n in range(1, len(gone)):
            gone[n] = gone[n] or gone[self.parent[n]]
        return gone

    def text(self, templates: set[int] | frozenset[int] = frozenset()) -> str:
        """The article's blocks, joined by one line end each.

        If there is no article or main element outside of furniture, and furniture holds nearly all running text, then the elements that frame
        the most of it are not furniture, whatever they are called.
        """
        inside, weights = self.inside(), self.weights()
        own = self.marked(inside, weights)
        gone = self._below(own)
        roots = self._roots(gone)
        if not roots:
            running = [x - y for x, y in zip(*weights[:2], strict=True)]
            lost = sum(running[n] for n in range(1, len(own)) if own[n] and not gone[self.parent[n]] and self.tag[n] != "head")
            every = running[0] - sum(running[n] for n, t in enumerate(self.tag) if t == "head")
            if lost >= 0.8 * every > 0:
                frames = ("form", "div", "section", "p", "center", "table", "tbody", "tr", "td", "article", "ul", "ol", "fieldset")
                own = [x and not (t in frames and running[n] >= FRAME * every) for n, (x, t) in enumerate(zip(own, self.tag, strict=True))]
                gone = self._below(own)
                roots = self._roots(gone)
        roots = roots or [0]
        if templates:
            for n, h in enumerate(self.hashes()):
                t = self.tag[n]
                own[n] = own[n] or n > 0 and t in BLOCK and t not in ROOTS and not (inside[n] and t in PROSE) and h in templates
            gone = self._below(own)
        blocks: list[str] = []
        line: list[str] = []

        def end() -> None:
            joined = " ".join("".join(line).split())
            if joined:
                blocks.append(joined)
            line.clear()

        for root in roots:
            todo: list[tuple[int, int]] = [(root, 0)]
            while todo:
                n, k = todo.pop()
                if k == len(self.pieces[n]):
                    if self.tag[n] in BLOCK:
                        end()
                    continue
                todo.append((n, k + 1))
                piece = self.pieces[n][k]
                if isinstance(piece, str):
                    line.append(unescape(piece))
                elif self.tag[piece] == "br":
                    line.append(" ")
                elif not gone[piece]:
                    if self.tag[piece] in BLOCK:
                        end()
                    todo.append((piece, 0))
                elif self.tag[piece] in BLOCK:
                    end()
            end()
        return "\n".join(blocks)

    def _within(self, n: int, tags: set[str]) -> bool:
        while n := max(self.parent[n], 0):
            if self.tag[n] in tags:
                return True
        return False


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _candidates(pages: DataFrame) -> DataFrame:
    """(host, page, body, hash) of the subtrees of pages that may be templates; page is a hash of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            at, bodies, hashes = [], [], []
            for i, html in enumerate(b.column(2).to_pylist()):
                body, found = Page(html or "").template_hashes()
                at += [i] * len(found)
                bodies += [body] * len(found)
                hashes += sorted(found)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(bodies, pa.int64()), pa.array(hashes, pa.int64())], ["host", "page", "body", "hash"])

    return pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").mapInArrow(run, "host string, page long, body long, hash long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash): the subtrees that recur across the pages of a host. Pages with the same body count once; the host's size plays no part."""
    return _candidates(pages).groupBy("host", "hash").agg(F.count_distinct("body").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null html is an empty page, a page without text gives the empty string, and pages without a host share the host ''. Unclosed and stray
    tags are taken as a browser takes them; nesting is not limited. Repeated rows each give a row; other columns are not read.
    """
    spark = pages.sparkSession
    known = materialize(templates(pages, min_pages), "templates")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    shared = None
    if known.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for r in known.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.hash)
        shared = spark.sparkContext.broadcast(by_host)
    else:
        # A page's own templates only: their number doesn't grow with the host.
        own = _candidates(pages).join(known, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("hashes"))
        rows = rows.withColumn("page", F.xxhash64("html")).join(materialize(own, "own_templates"), ["host", "page"], "left").select("page_id", "url", "html", "hashes")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            of = b.column(3).to_pylist()
            texts = [Page(html or "").text(shared.value.get(t, frozenset()) if shared else frozenset(t or ())) for html, t in zip(b.column(2).to_pylist(), of, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
