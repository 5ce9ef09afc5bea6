"""The main text of web pages, by the ratios of their tag paths.

Every text of a page belongs to a path of tags from the root. By path the texts' length, their marks of punctuation and the
part that stands in links are added up; lengths and marks a text are smoothed over the page's order, fused by product, and
paths over a threshold from their spread are content. What elements are for counts too: a path through an element that is
navigation, a footer, an advert, a form and so on, by its tag, role, class or id, has the ratio nought. The content paths'
texts show where the article is: an article or main element, or else the innermost block that holds nearly all of their
text. All texts of that block are its text, short ones as well, but for paths of ratio nought and for lists that are all links.

Pages are read one by one, so no host or page meets another. Defined results: null html and pages without main text give an
empty text; broken markup is closed by what follows it, and what is cut off ends with the page; repeated rows stay; an empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import drop_caches, small_batches, table, trim

# Names of HTML's elements, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
NO_TEXT = frozenset("head script style noscript template svg math iframe object embed audio video canvas map select datalist button textarea input form dialog menu nav aside noframes noembed".split())
EDGES = frozenset("header footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p pre blockquote li dt dd td th caption figcaption address summary".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Elements that a start tag closes, and what stops the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: One of these words in class or id.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright disclaimer
    disqus footer footnav gdpr hidden login masthead menu menus modal nav navbar navigation navi newsletter notice notification notifications overlay pager pagination popup popular
    promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription
    tags teaser toolbar topbar tracking trending widget widgets""".split()
)
#: These only outside of an article.
OUTER = frozenset("header head top hero bottom foot aside meta".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[,.;:!?…。，、！？；：،؟।]")
_CLOSING: dict[str, re.Pattern[str]] = {}

#: Shares: of the content's text that the article's block holds at least, and of a list's text in links from which it is a menu.
HELD, LINKED = 0.9, 0.9
#: The share of the content's text from which an article or main element is the article: less is a teaser beside it.
LEAST_MARKED = 0.2
#: The threshold over smoothed, fused ratios, in standard deviations.
SPREAD = 0.5


class _Node:
    __slots__ = ("tag", "parent", "path", "off", "inside", "linked", "blocks", "kids", "mass", "list")

    def __init__(self, tag: str, parent: _Node | None, path: int, off: bool, inside: bool) -> None:
        self.tag, self.parent, self.path, self.off, self.inside = tag, parent, path, off, inside
        self.linked = tag == "a" or (parent is not None and parent.linked)
        self.list = self if tag in ("ul", "ol", "dl", "menu") else parent.list if parent is not None else None
        self.kids, self.mass = 0, 0


class _Text:
    __slots__ = ("text", "node", "block")

    def __init__(self, text: str, node: _Node, block: int) -> None:
        self.text, self.node, self.block = text, node, block


def _named_off(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's role, class, id or style says that it is no content."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            words = {w.lower() for w in _PIECE.findall(value)}
            if words & WORDS or (not inside and words & OUTER):
                return True
    return False


class _Page:
    """One pass over a page's tags: its texts in order, each with its element and the number of its block."""

    def __init__(self, page: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[_Text] = []
        self.block = 0
        self.root = self.top = _Node("", None, 0, False, False)
        self.open: dict[str, int] = {}  # by tag, how many of the open elements
        self.nodes = [self.root]
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            if m is None:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in RAW:
                    end = _CLOSING.setdefault(tag, re.compile(f"</{tag}(?![a-z0-9])[^>]*(?:>|$)", re.I)).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    self.start(tag, m[3])

    def say(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        if text:
            self.texts.append(_Text(text, self.top, self.block))

    def close(self, node: _Node) -> None:
        """Ends node and all that is open in it."""
        while True:
            top = self.top
            self.open[top.tag] -= 1
            self.block += top.tag not in INLINE
            self.top = top.parent
            if top is node:
                return

    def find(self, tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> _Node | None:
        """The outermost open element of `tags` below the innermost of `stops`."""
        found, node = None, self.top
        if not any(self.open.get(t) for t in tags):
            return None
        while node.parent is not None and node.tag not in stops:
            found = node if node.tag in tags else found
            node = node.parent
        return found

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.say("\n")
            return
        if tag in VOID:
            self.block += tag == "hr"
            return
        if tag in ("article", "main", "body") and self.top.off:  # navigation or the like that nothing has closed
            node = self.find(NO_TEXT | EDGES if tag != "body" else frozenset(["head"]), frozenset(["article", "main"]) if tag == "main" else frozenset(["article", "main", "section"]))
            if node is not None:
                self.close(node)
        if tag in CLOSES_P and self.open.get("p"):
            p = self.find({"p"}, {"table", "td", "th", "button", "object", "caption"})
            if p is not None:
                self.close(p)
        if tag in ENDS:
            node = self.find(*ENDS[tag])
            if node is not None:
                self.close(node)
        up = self.top
        inside = up.inside or tag in ("article", "main")
        off = up.off or tag in NO_TEXT or (tag in EDGES and not up.inside) or (tag == "footer" and up.inside) or _named_off(tag, attributes, up.inside)
        path = self.paths.setdefault((up.path, tag), len(self.paths) + 1)
        self.top = node = _Node(tag, up, path, off, inside)
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag not in INLINE:
            self.block += 1
            up.kids += 1

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.block += 1
            return
        if not self.open.get(tag):
            return
        node, inline = self.top, tag in INLINE
        while node.parent is not None and node.tag != tag:
            if (inline and node.tag not in INLINE) or node.tag in ("article", "main") or (node.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot")):
                return  # an end tag reaches no further
            node = node.parent
        if node.parent is not None:
            self.close(node)


def _smoothed(x: np.ndarray) -> np.ndarray:
    """Each value with a quarter of each neighbour's."""
    if len(x) < 3:
        return x
    y = np.concatenate([x[:1], x, x[-1:]])
    return y[:-2] / 4 + y[1:-1] / 2 + y[2:] / 4


def content_paths(page: _Page) -> set[int]:
    """Paths whose fused ratio is over the threshold."""
    size: dict[int, list[float]] = {}  # by path: texts, length, length outside links, marks
    order: list[int] = []
    for t in page.texts:
        n = len(t.text.strip())
        if n and not t.node.off:
            s = size.setdefault(t.node.path, [0.0, 0.0, 0.0, 0.0])
            s[0] += 1
            s[1] += n
            s[2] += 0 if t.node.linked else n
            s[3] += len(_MARK.findall(t.text))
            order.append(t.node.path)
    if not order:
        return set()
    length = {p: s[2] / s[0] * (s[2] / s[1]) for p, s in size.items()}
    marks = {p: 1 + s[3] / s[0] for p, s in size.items()}
    fused = _smoothed(np.array([length[p] for p in order])) * _smoothed(np.array([marks[p] for p in order]))
    bound = min(SPREAD * fused.std(), fused.max())
    best: dict[int, float] = {}
    for p, f in zip(order, fused.tolist(), strict=True):
        best[p] = max(best.get(p, 0.0), f)
    return {p for p, f in best.items() if f >= bound and length[p] > 0}


def _article(page: _Page, content: set[int]) -> _Node | None:
    """The block that holds the article."""
    for t in page.texts:
        if t.node.path in content and not t.node.off:
            n, node = len(t.text.strip()), t.node
            while node is not None:
                node.mass += n
                node = node.parent
    marked = [n for n in page.nodes if n.tag in ("article", "main") and not n.off]
    if marked:
        best = max(marked, key=lambda n: (n.mass, n.tag == "article"))
        if best.mass >= LEAST_MARKED * page.root.mass:
            return best
    if not page.root.mass:
        return None
    below: dict[int, list[_Node]] = {}
    for n in page.nodes[1:]:
        below.setdefault(id(n.parent), []).append(n)
    node = page.root
    while True:
        into = [n for n in below.get(id(node), []) if n.mass >= HELD * node.mass and n.tag not in LEAVES and n.tag not in INLINE and n.kids > (n.tag not in ("html", "body"))]
        if not into:
            # a block all of whose own children are of one kind, or one that only wraps another
            only = [n for n in below.get(id(node), []) if n.mass >= HELD * node.mass and n.tag in ("html", "body", "div", "section", "center", "td", "tr", "tbody", "table") and n.kids]
            if not only:
                return node
            into = only
        node = max(into, key=lambda n: n.mass)


def main_text(page: str) -> str:
    """The article of a page: its blocks with single spaces, joined by empty lines."""
    tree = _Page(page)
    article = _article(tree, content_paths(tree))
    if article is None:
        return ""
    inner, inside = {id(article)}, []
    for n in tree.nodes:  # parents come first
        if n.parent is not None and id(n.parent) in inner:
            inner.add(id(n))
    lists: dict[int, list[int]] = {}
    for t in tree.texts:
        if not t.node.off and id(t.node) in inner:
            inside.append(t)
            if t.node.list is not None and (n := len(t.text.strip())):
                s = lists.setdefault(id(t.node.list), [0, 0, 0])
                s[0], s[1], s[2] = s[0] + n, s[1] + n * t.node.linked, s[2] + 1
    menus = {k for k, (n, linked, many) in lists.items() if many > 2 and linked >= LINKED * n}
    blocks: list[str] = []
    last, parts = None, []
    for t in [*inside, None]:
        if t is None or t.block != last:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(joined)
            parts, last = [], t.block if t else None
        if t is not None and not (t.node.list is not None and id(t.node.list) in menus):
            parts.append(t.text)
    return "\n\n".join(blocks)


def _texts() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [main_text(x) if x else "" for x in b.column(b.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string()), pa.array([len(m) for m in made], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return run


def articles(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, text, n_chars) of each page."""
    given = pages.select(*keys, html)
    out = pages.select(*keys).schema.add("text", "string").add("n_chars", "long")
    small_batches(pages.sparkSession)

    def run(batches):
        drop_caches()
        work = _texts()
        for b in batches:
            if b.num_rows:
                yield work(b)
        trim()

    return given.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(table(spark, sf_dir, "pages"), ["page_id", "url"])
