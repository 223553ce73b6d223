"""Main text of HTML pages with a site style tree.

The pages of one host are merged into a tree: a node is a place, the chain of tag names with first classes down to an
element (inline elements without a class are none; below `DEPTH` all share the last place). For every node the tree
knows in how many pages m it stands, which styles it has there (the sequence of its children, repeats as one), and which
contents (its own texts). Importance comes from entropy:

* of content: a text found in k of m pages has 1 - log_m k, one minus the entropy of its spread; a node the mean;
* of presentation: the entropy, to base m, of the node's styles over its pages;
* both are drawn towards 1 by few pages: 1 - (1 - importance) * (m - 1) / (m + 1);
* composite: the mean over a node's branch, where a content weighs 1 and the presentation of a node 1 - `DAMPING` a page.

A branch is noise when neither its node nor any node under it has a composite importance of `LEAST` or more: menus,
footers and notices repeat on every page and come near 0, articles stay near 1, and five pages at least must agree.
Noise branches are removed from each page of the host. Pages with equal main parts count once, so copies of an article
on one host don't make it noise.

What markup itself says goes first: scripts, styles, forms, navigation, headers, footers, asides, hidden parts, and
elements whose class, id or role names a menu, advert, notice, sidebar or comment section are no content; and where a
page has an article (else a main part) with text, the rest of the page is none. In an article, plain elements
(paragraphs, headings, lists, tables) are always kept, since near copies on one host repeat them too.

Character references are decoded, white space in a block becomes one blank, blocks are joined by a newline. Nothing
else is dropped or shortened. A null html or one without text gives ''. Pages with a null or odd url share the host
''. Repeated rows are copies. An empty table gives an empty result. Extra columns are ignored. Parsing takes time in
proportion to the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import written

LEAST = 0.4
DAMPING = 0.9
DEPTH = 48

#: The begin of a comment, a declaration, an end tag, a start tag without `<` in it, or the begin of some other; nothing is tried twice.
_TAG = re.compile(r"""<!--|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)""")
_REST = re.compile(r"""[^"'<>]*+""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: HTML element kinds.
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes canvas audio video".split())
DROPPED = RAW | frozenset("head nav aside form button select menu dialog footer fieldset datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q ruby rb rp rt s samp small span strike strong sub sup time tt u var td th center img wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder mtable mtr mtd semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption section div header".split()) | INLINE

#: Words of a class or id, and roles, that name what is no article text, and those of them that don't in an article.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner cookie cookies consent gdpr popup popups modal overlay promo promotion sponsor sponsored sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup login notice notices alert alerts paywall pagination pager skip".split())
OUTSIDE = frozenset("share sharing social related recommended recommendations alert alerts pagination pager skip login signup toolbar masthead topbar overlay banner header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = re.compile(r"[a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def _noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in ROLES:
        return True
    if tag in ("body", "html", "article", "main"):
        # A whole article may be a comment; the page itself isn't named by its class.
        named = attrs.get("class", "") if tag == "article" else ""
        return any(w in ("comment", "ad", "advert", "promo", "sponsored", "related") for w in _WORDS.findall(named.lower()))
    named = NOISE - OUTSIDE if in_article else NOISE
    return any(w in named for key in ("class", "id") for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attrs.get(key, "")).lower()))


class _Open:
    """An open element: tag, node, the nodes above it, level, whether plain, and the style of its children so far."""

    __slots__ = ("tag", "node", "above", "level", "plain", "owner", "style", "last")

    def __init__(self, tag: str, node: int, above: tuple[int, ...], level: int, plain: bool, parent: _Open | None):
        self.tag, self.node, self.above, self.level, self.plain = tag, node, above, level, plain
        self.owner = self if parent is None or tag not in INLINE or level < 0 else parent.owner
        self.style, self.last = 0, None


class Page:
    """One pass over a page: its blocks of text, and the nodes of its tree.

    blocks: (node, text, level, plain) of each block with text in page order; level 0 outside, 1 in main, 2 in article,
    -1 in parts that markup names as noise. nodes: node -> (nodes above it, styles); paths: node -> place, if asked for.
    """

    def __init__(self, html: str | None, paths: bool = False):
        self.html = html or ""
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.nodes: dict[int, tuple[tuple[int, ...], set[int]]] = {}
        self.paths: dict[int, str] | None = {0: ""} if paths else None
        self.stack = [_Open("", 0, (), 0, False, None)]
        #: Places in the stack of the open elements of each tag.
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.blank = True
        self.owner = self.stack[0]
        #: Behind the last `>`, and the last places of quotes before it; begins of tags that are known not to end.
        self.end = self.html.rfind(">") + 1
        self.last = {q: self.html.rfind(q, 0, self.end) for q in "\"'"}
        self.endless: set[int] = set()
        self._read()

    def _flush(self) -> None:
        if not self.blank:
            owner = self.owner
            self.blocks.append((owner.node, " ".join("".join(self.text).split()), owner.level, owner.plain))
        self.text, self.blank = [], True

    def _add(self, piece: str) -> None:
        if self.blank:
            self.owner = self.stack[-1].owner
        piece = unescape(piece)
        self.text.append(piece)
        self.blank = self.blank and not piece.strip()

    def _at(self, *tags: str) -> int:
        """Place in the stack of the innermost open element of these tags; 0 if none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.node != self.stack[-1].node:
                self.nodes.setdefault(e.node, (e.above, set()))[1].add(e.style)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.stack[-1]
        noise = parent.level >= 0 and _noise(tag, attrs, parent.level > 0)
        if tag not in INLINE or noise:
            self._flush()
        elif tag in ("td", "th"):
            self._add(" ")
        style = (attrs.get("class") or "").split()
        level = -1 if noise or parent.level < 0 else 2 if tag == "article" else max(parent.level, 1) if tag == "main" else parent.level
        plain = tag == "article" or tag == "main" or (parent.plain and tag in PLAIN and not style)
        node, above = parent.node, parent.above
        if (tag not in INLINE or style) and len(above) < DEPTH:
            name = f"{tag}.{style[0]}" if style else tag
            kind = _hash(name)
            node, above = _mixed(node, kind), (*above, node)
            if kind != parent.last:
                parent.style, parent.last = _mixed(parent.style, kind), kind
            if self.paths is not None:
                self.paths[node] = f"{self.paths[parent.node]}/{name}"
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, node, above, level, plain, parent))

    def _close(self, tag: str) -> None:
        depth = self._at(tag)
        if not depth:
            return
        if tag not in INLINE or self.stack[depth].level != self.stack[depth - 1].level or any(e.tag not in INLINE for e in self.stack[depth:]):
            self._flush()
        elif tag in ("td", "th"):
            self._add(" ")
        self._cut(depth)

    def _implied(self, tag: str) -> None:
        """Closes what a start tag ends: an open paragraph, list item, cell or row."""
        if tag in CLOSES_P:
            depth = self._at("p")
            if depth and all(e.tag in INLINE for e in self.stack[depth + 1 :]):
                self._flush()
                self._cut(depth)
        elif tag in SAME:
            pair = next((x for x in (("td", "th"), ("dt", "dd")) if tag in x), (tag,))
            depth = self._at(*pair)
            if depth > self._at(*SAME[tag]):
                if tag not in INLINE:
                    self._flush()
                self._cut(depth)

    def _ends(self, start: int, at: int) -> int:
        """Behind the end of the tag that begins at start and whose name ends at `at`; -1 if it has none.

        What stands outside quotes goes on alike from wherever it was begun. So if a tag doesn't end, neither do those
        that begin within it outside its quotes, and they aren't looked at again: each place is passed a few times at most.
        """
        html = self.html
        passed = [start + k for k, c in enumerate(html[start:at]) if c == "<"]
        while start not in self.endless:
            at = _REST.match(html, at, self.end).end()
            c = html[at] if at < self.end else ""
            if c == ">":
                return at + 1
            if c == "<":
                if at in self.endless:
                    break
                passed.append(at)
                at += 1
            elif c and at < self.last[c]:
                at = html.index(c, at + 1, self.end) + 1
            else:
                break
        self.endless.update(passed)
        return -1

    def _read(self) -> None:
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            m = _TAG.search(html, at, self.end)
            if m is None:
                # Behind the last `>` only an unclosed comment is none of the text.
                open_ = html.find("<!--", at)
                self._add(html[at : open_ if open_ >= 0 else size])
                break
            if m[0] == "<!--":
                self._add(html[at : m.start()])
                close = html.find("-->", m.end())
                at = close + 3 if close >= 0 else size
                continue
            name, attrs = m[2] or m[4], m[3]
            ends = m.end() if m[4] is None else self._ends(m.start(), m.end())
            if ends < 0:
                self._add(html[at : m.start() + 1])
                at = m.start() + 1
                continue
            if at < m.start():
                self._add(html[at : m.start()])
            at = ends
            if m[1]:
                self._close(m[1].lower())
            elif name:
                attrs = html[m.end() : ends - 1] if m[4] else attrs
                tag = name.lower()
                if tag == "hr":
                    self._flush()
                elif tag == "br":
                    self._add(" ")
                if tag in VOID:
                    continue
                self._implied(tag)
                if tag in RAW:
                    if tag not in INLINE:
                        self._flush()
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at, self.end)
                    at = end.end() if end else size
                else:
                    self._push(tag, _attributes(attrs))
        self._flush()
        self._cut(1)


def page_host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _mixed(a: int, b: int) -> int:
    x = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True))
    return x - (1 << 64) if x >> 63 else x


#: What a row of the tree's table tells of a node in a page: that it is there, a style of it, a content of it.
THERE, STYLE, CONTENT = 0, 1, 2
_TREE = "host string, node long, kind int, value long, page long, above array<long>"


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) -> one row for each node, style and content of a page; equal ones of equal pages once a batch.

    A page is named by the hash of its main part: the blocks of the article or main part, else all.
    """
    for batch in batches:
        found: dict[tuple, tuple[int, ...] | None] = {}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            host, page = page_host(url), Page(html.as_py())
            best = max((b[2] for b in page.blocks), default=0)
            contents = [(node, _hash(text), level) for node, text, level, _ in page.blocks]
            name = 0
            for _, h, level in contents:
                name = _mixed(name, h) if level == best else name
            for node, (above, styles) in page.nodes.items():
                found[host, node, THERE, 0, name] = above
                for style in styles:
                    found[host, node, STYLE, style, name] = None
            for node, h, _ in contents:
                found[host, node, CONTENT, h, name] = None
        columns = list(zip(*found)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(found.values(), pa.list_(pa.int64()))], names=["host", "node", "kind", "value", "page", "above"])


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", damping: float = DAMPING) -> DataFrame:
    """host, node, pages, content, presentation, importance (composite), best (that of the branch's most important node)."""
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_tree_rows, _TREE)
    once = rows.groupBy("host", "node", "kind", "value", "page").agg(F.max("above").alias("above"))
    counts = once.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("k"), F.max("above").alias("above"))

    def of(kind: int, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))

    spread = F.col("k") * F.log("k")
    nodes = counts.groupBy("host", "node").agg(
        of(THERE, F.col("k")).alias("pages"), of(CONTENT, F.col("k")).alias("contents"), of(CONTENT, spread).alias("repeats"),
        of(STYLE, F.col("k")).alias("styles"), of(STYLE, spread).alias("style_repeats"), F.max("above").alias("above"),
    )
    m = F.col("pages")
    content = F.when((m > 1) & (F.col("contents") > 0), F.lit(1.0) - F.col("repeats") / F.col("contents") / F.log(m)).otherwise(1.0)
    presentation = F.when((m > 1) & (F.col("styles") > 0), (F.log("styles") - F.col("style_repeats") / F.col("styles")) / F.log(m)).otherwise(1.0)

    def drawn(x: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return F.lit(1.0) - (F.lit(1.0) - x) * F.greatest(m - 1, F.lit(0.0)) / (m + 1)

    nodes = nodes.select("host", "node", "pages", "contents", drawn(content).alias("content"), drawn(presentation).alias("presentation"), F.coalesce("above", F.array().cast("array<bigint>")).alias("above"))
    nodes = written(nodes, "html-nodes")
    branch = F.explode(F.concat("above", F.array("node"))).alias("top")
    shown = F.col("pages") * (1 - damping)
    sums = nodes.select("host", branch, (F.col("contents") * F.col("content") + shown * F.col("presentation")).alias("x"), (F.col("contents") + shown).alias("w"))
    composite = sums.groupBy("host", "top").agg((F.sum("x") / F.sum("w")).alias("importance"))
    scored = written(nodes.join(composite.withColumnRenamed("top", "node"), ["host", "node"]), "html-composite")
    best = scored.select("host", branch, "importance").groupBy("host", F.col("top").alias("node")).agg(F.max("importance").alias("best"))
    return scored.join(best, ["host", "node"]).select("host", "node", "pages", "content", "presentation", "importance", "best")


def main_text(html: str | None, noise: frozenset[int] = frozenset()) -> str:
    """The page's text without the branches that markup or the host's tree call noise."""
    kept = [b for b in Page(html).blocks if b[2] >= 0 and (b[3] or b[0] not in noise)]
    best = max((b[2] for b in kept), default=0)
    return "\n".join(text for _, text, level, _ in kept if level == best)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py(), frozenset(noise or ())) for html, noise in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tree = style_tree(pages, url_col=url_col, html_col=html_col)
    noise = written(tree.where(F.col("best") < least).groupBy("host").agg(F.collect_set("node").alias("noise")), "html-noise")
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("of"))
    met = rows.join(noise, rows["of"] == noise["host"], "left").select("page_id", "url", "html", "noise")
    return met.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
