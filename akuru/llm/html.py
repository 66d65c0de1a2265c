"""Main text of web pages by tag-path ratios.

A page is read once into text blocks below a tree of elements. The path of a block is its
container (an element that holds other blocks) and the tags below it. Per path, the text length,
the punctuation and the text within links are set against the number of blocks; the ratios are
smoothed along the page between blocks whose paths are near each other, and fused into a score.
Paths above a share of the best score are content. Their containers bring in their other blocks
(headings, list items, short paragraphs), and the region they span brings in what lies between
and scores above a much smaller share. Names (tags such as nav, class words such as sidebar)
only veto what the ratios can't tell from an article, such as comments and notices, and a veto
falls where the element holds most of the page's prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[,.;:!?،؛؟。、，！？]")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements whose text is character data up to their end tag; it is never shown as text.
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text: they neither end a block nor lengthen a path.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mfenced semantics".split()
)
#: Elements that never hold text of an article.
_NEVER = frozenset("head button select option optgroup datalist object canvas audio video map input dialog".split())
#: Elements that say they aren't the article; form only does so as long as it doesn't hold most of the page.
_BESIDE = frozenset("nav footer aside menu form".split())
#: Elements that are items of the element around them, not containers of their own.
_ITEMS = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption figure figcaption summary address center hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that speak against an element, and words that say nothing beside them.
_AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus submenu topbar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets related recommended share sharing social comment comments disqus respond reply replies reviews cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup login search pagination pager toolbar byline complementary contentinfo tooltip".split()
)
_NEUTRAL = frozenset("list item items box container wrapper wrap area section block inner outer top bottom left right main site page global primary secondary text body the bar unit slot group links col row tree thread form".split())
_REMARKS = frozenset("comment comments disqus respond reply replies reviews".split())
#: Words that an article's own parts may carry.
_FINE_INSIDE = frozenset(["header"])
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr tbody thead tfoot body".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
    "head": frozenset(["body", "article", "main", "div", "p", "h1", "nav", "section", "table", "ul"]),
}
_SCOPE = frozenset("html body table td th div article section main aside nav header footer form ul ol dl blockquote li".split())
#: Weights of a block and of its neighbours up to two places away.
_KERNEL = (0.399, 0.242, 0.054)
#: Each step between two paths divides their blocks' weight by this; beyond the last step they don't count.
_STEP, _STEPS = 6.0, 8
#: Shares of the best score from which a path is content, and from which it is within the region of content paths.
CONTENT, NEAR = 0.1, 0.001
#: Of a block's text, the share in links from which a path that isn't content is a list of links.
LINKS = 0.5
#: A vetoed element is acquitted if it holds this share of the text, in blocks of at least so many characters on average.
MOST, PROSE = 0.5, 100


class Node:
    """An element: its tag, its parent, whether it holds other blocks, and what speaks against it."""

    __slots__ = ("tag", "parent", "depth", "holds", "veto", "vetoed", "chars", "count", "linked")

    def __init__(self, tag: str, parent: Node | None, veto: str = "") -> None:
        self.tag, self.parent, self.veto = tag, parent, veto
        self.depth = parent.depth + 1 if parent else 0
        self.holds = False
        #: The nearest vetoed element from here up to the root.
        self.vetoed: Node | None = self if veto else parent.vetoed if parent else None
        self.chars = self.count = self.linked = 0

    def container(self) -> Node:
        at = self
        while at.parent and (not at.holds or at.tag in _ITEMS):
            at = at.parent
        return at


class Block:
    """A run of text within one innermost block element."""

    __slots__ = ("node", "parts", "linked", "_text")

    def __init__(self, node: Node) -> None:
        self.node, self.parts, self.linked, self._text = node, [], 0, None

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = _SPACE.sub(" ", "".join(self.parts)).strip()
        return self._text


def _against(value: str, inside: bool) -> str:
    """The kind of veto that names in a class, id or role amount to: each word of a name must be known."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and all(w in _AGAINST or w in _NEUTRAL or w.isdigit() for w in words):
            found = {w for w in words if w in _AGAINST and not (inside and w in _FINE_INSIDE)}
            if found:
                return "remarks" if found & _REMARKS else "name"
    return ""


def _veto(tag: str, attrs: str, inside: bool) -> str:
    """What speaks against an element: never, tag, form, remarks, name or nothing."""
    if tag in _NEVER:
        return "never"
    found = "form" if tag == "form" else "tag" if tag in _BESIDE or (tag == "header" and not inside) else ""
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
            return "never"
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            found = found or _against(value, inside)
    return found


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; references are decoded, text that isn't shown is left out."""
    root = Node("", None)
    stack = [root]
    hidden: list[str] = []  # inline elements that aren't shown
    out: list[Block] = []
    at, new, end, links, inside = 0, True, len(html), 0, 0

    def text(raw: str) -> None:
        nonlocal new
        if not raw or hidden:
            return
        top = stack[-1]
        if top.vetoed and top.vetoed.veto == "never":
            return
        raw = unescape(raw) if "&" in raw else raw
        if new:
            if raw.isspace():
                return
            out.append(Block(top))
            new = False
        out[-1].parts.append(raw)
        if links:
            out[-1].linked += len(raw)

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if tag in _INLINE:
            if tag == "br":
                text(" ")
            elif closing:
                links -= tag == "a" and links > 0
                if hidden and hidden[-1] == tag:
                    hidden.pop()
            elif tag not in _VOID:
                links += tag == "a"
                if m[3] and (hidden or _veto(tag, m[3], True) == "never"):
                    hidden.append(tag)
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    inside -= sum(n.tag in ("article", "main") for n in stack[k:])
                    del stack[k:]
                    hidden.clear()
                    links = 0
                    break
                if tag in ("p", "li", "dt", "dd") and stack[k].tag in _SCOPE:
                    break
            new = True
            continue
        new = True
        hidden.clear()
        links = 0
        while tag in _CLOSES.get(stack[-1].tag, ()):
            inside -= stack.pop().tag in ("article", "main")
        if tag in _VOID:
            continue
        stack[-1].holds = True
        stack.append(Node(tag, stack[-1], _veto(tag, m[3], inside > 0)))
        if tag in ("article", "main"):
            inside += 1
            above = stack[-2].vetoed
            while above:  # names that take in the page's declared main part say nothing about it
                if above.veto in ("name", "form") or (tag == "main" and above.veto != "never"):
                    above.veto = "void"
                above = above.parent.vetoed if above.parent else None
    return out


def _vetoes(node: Node) -> Iterator[Node]:
    at = node.vetoed
    while at:
        if at.veto != "void":
            yield at
        at = at.parent.vetoed if at.parent else None


def _allowed(found: list[Block]) -> list[Block]:
    """Blocks without a veto, or whose vetoes all fall: names and forms that hold most of the page in prose."""
    total = 0
    for b in found:
        total += len(b.text)
        for v in _vetoes(b.node):
            v.chars += len(b.text)
            v.linked += b.linked
            v.count += 1
    acquitted = lambda v: v.veto in ("name", "form") and v.chars > MOST * total and v.chars >= PROSE * v.count and 2 * v.linked < v.chars
    return [b for b in found if all(map(acquitted, _vetoes(b.node)))]


def _steps(a: Node, b: Node) -> int:
    """Steps from one element to the other through the tree, at most _STEPS + 1."""
    n = 0
    while a is not b and n <= _STEPS:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        n += 1
    return n


def path_scores(usable: list[Block]) -> tuple[list[tuple], dict[tuple, float], dict[tuple, float]]:
    """The path of each block, and per path its fused score and the share of its text in links."""
    paths = []
    for b in usable:
        box, at, below = b.node.container(), b.node, []
        while at is not box:
            below.append(at.tag)
            at = at.parent
        paths.append((box, tuple(below)))
    length: dict[tuple, int] = {}
    marks: dict[tuple, int] = {}
    nodes: dict[tuple, int] = {}
    linked: dict[tuple, int] = {}
    for p, b in zip(paths, usable, strict=True):
        length[p] = length.get(p, 0) + len(b.text)
        marks[p] = marks.get(p, 0) + len(_PUNCTUATION.findall(b.text))
        nodes[p] = nodes.get(p, 0) + 1
        linked[p] = linked.get(p, 0) + b.linked
    links = {p: min(linked[p] / length[p], 1.0) for p in length}
    score = dict.fromkeys(length, 0.0)
    for i, p in enumerate(paths):
        w_sum = by_text = by_mark = 0.0
        for j in range(max(0, i - 2), min(len(paths), i + 3)):
            q = paths[j]
            steps = 0 if p is q or p == q else _steps(usable[i].node, usable[j].node)
            if steps <= _STEPS:
                w = _KERNEL[abs(i - j)] / _STEP**steps
                w_sum += w
                by_text += w * length[q] / nodes[q]
                by_mark += w * marks[q] / nodes[q]
        score[p] += by_text / w_sum * (1 + by_mark / w_sum) / nodes[p]
    return paths, {p: s * length[p] * (1 - links[p]) for p, s in score.items()}, links


def content(found: list[Block], ratios: bool = True, names: bool = True) -> list[Block]:
    """The blocks of content, in page order. Tests switch the ratios or the names off to see what they decide."""
    found = [b for b in found if b.text]
    usable = _allowed(found) if names else found
    if not usable or not ratios:
        return usable
    paths, score, links = path_scores(usable)
    best = max(score.values())
    seeds = {p for p, s in score.items() if s >= CONTENT * best}
    boxes = {box for box, _ in seeds}
    region = next(iter(boxes))
    for box in boxes:  # the smallest element that holds all content paths
        a, b = region, box
        while a is not b:
            if a.depth >= b.depth:
                a = a.parent
            else:
                b = b.parent
        region = a
    titled, said = set(), set()  # containers with a heading, and with a sentence
    for (box, below), b in zip(paths, usable, strict=True):
        if not _HEADINGS.isdisjoint(below):
            titled.add(box)
        elif b.text[-1] in ".!?؟。！？…":
            said.add(box)
    at: Node | None = region
    while at and at.tag not in ("article", "main"):
        at = at.parent
    alike = {box for box in titled & said if box is not region and box.tag == region.tag and box.parent is region.parent}
    region = at or (region.parent if alike and region.parent else region)
    within: dict[Node, bool] = {}

    def belongs(node: Node) -> bool:
        chain = []
        at: Node | None = node
        while at and at not in within and at is not region and at.depth >= region.depth:
            chain.append(at)
            at = at.parent
        known = at is region or (at is not None and within.get(at, False))
        within.update(dict.fromkeys(chain, known))
        return known

    near = {box for (box, _), s in score.items() if s >= NEAR * best and belongs(box)}
    last = max(i for i, p in enumerate(paths) if p in seeds)
    out = []
    for i, ((box, below), b) in enumerate(zip(paths, usable, strict=True)):
        p = (box, below)
        if p in seeds:
            out.append(b)
        elif links[p] < LINKS and belongs(b.node) and (box in boxes or box in near or box in titled & said or (i < last and not _HEADINGS.isdisjoint(below))):
            out.append(b)
    return out


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for a null or blank page."""
    return "\n".join(b.text for b in content(blocks(html or "")))


def main_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract, na_action=None).astype("object")

    return of(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row; null and empty pages have an empty text.

    Repeated rows are extracted alike, other columns are left out, an empty table gives no rows.
    """
    out = pages.select("page_id", "url", main_text(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
