"""HTML to Markdown: a lexer built from regular expressions, a tree of the elements that Markdown knows, and a writer of its blocks.

Text counts only inside a heading, paragraph, quote, list item, cell or preformatted block; a block that is never closed is
lost; an unclosed comment, script or style is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import Run, pieces, through

#: Named entities.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "laquo": "\u00ab", "raquo": "\u00bb"}
_ENTITY = re.compile(r"&(?:#?[xX]([0-9a-fA-F]+)|#([0-9]+)|(\w+));")
_TAG = re.compile(r"""<((?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^>"'])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*(?:=\s*(?:"([^"]*)"?|'([^']*)'?|(\S*)))?""", re.S)
# script text: strings and comments may hold what looks like the end tag
_RAW = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|//[^\r\n]*(?=[\r\n])|/\*.*?\*/|(?!["'`]|//|/\*|</{0}[\s>/]).)*+</{0}[\s/]?[^>]*>"""
_RAW_END = {name: re.compile(_RAW.format(name), re.S | re.I) for name in ("script", "style")}


class HtmlError(ValueError):
    """The source can't be converted without loss."""


def _entity(m: re.Match) -> str:
    hexa, decimal, name = m.groups()
    if len(m.group().encode()) > 12:
        return m.group()
    if name:
        return NAMED.get(name, m.group())
    code = int(hexa, 16) if hexa else int(decimal)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()


def decode(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&" in text else text


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes): kind is start, end or text."""
    at, text = 0, []
    while at < len(html):
        if html[at] != "<":
            stop = html.find("<", at)
            stop = len(html) if stop < 0 else stop
            text.append(decode(html[at:stop]))
            at = stop
            continue
        if text:
            yield "text", "".join(text), {}
            text = []
        if html.startswith("<!--", at):
            stop = html.find("-->", at)
            if stop < 0:
                raise HtmlError(f"a comment at {at} is not closed")
            at = stop + 3
            continue
        if html[at : at + 9].lower() == "<!doctype":
            stop = html.find(">", at)
            at = len(html) if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, at)
        at, body = m.end(), m.group(1)
        if body.startswith("/"):
            yield "end", body[1:].strip().lower(), {}
            continue
        name, _, rest = body.rstrip().rstrip("/").strip().partition(" ") if not re.search(r"\s", body) else (*re.split(r"(\s)", body.rstrip().rstrip("/").strip(), maxsplit=1), "", "")[:3]
        name = name.lower()
        if name in _RAW_END:
            end = _RAW_END[name].match(html, at)
            if not end:
                raise HtmlError(f"<{name}> before {at} is not closed")
            at = end.end()
            continue
        attributes: dict[str, str] = {}
        for k, *v in _ATTRIBUTE.findall(rest):
            attributes.setdefault(k.lower(), decode("".join(v)))
        yield "start", name, attributes
    if text:
        yield "text", "".join(text), {}


def escape(text: str, characters: str = "\\*`[]_") -> str:
    return "".join("\\" + c if c in characters else c for c in text)


def destination(url: str) -> str:
    if any(c.isspace() or c in "<>" for c in url):
        return "<" + url.replace(">", "\\>") + ">"
    return url.replace("\\", "\\\\").replace(")", "\\)")


def _title(attributes: dict[str, str]) -> str:
    t = attributes.get("title")
    return "" if t is None else ' "' + t.replace("\\", "\\\\").replace('"', '\\"') + '"'


def table_text(rows: list[list[str]], alignments: list[str | None] | None = None) -> str:
    """A Markdown table; the first row is its head."""
    rule = {"left": ":---", "center": ":---:", "right": "---:"}
    line = lambda cells: "| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>") for c in cells) + " |"
    marks = [rule.get((alignments or [])[k] if k < len(alignments or []) else None, "---") for k in range(len(rows[0]))]
    return "\n".join([line(rows[0]), "| " + " | ".join(marks) + " |", *map(line, rows[1:])])


# ---- from tags to a tree

#: Elements whose text is shown; they end by any end tag of these, and are lost if none comes.
HEADINGS = {f"h{n}": n for n in range(1, 7)}
SHOWN = frozenset([*HEADINGS, "p", "blockquote", "li", "td", "th", "pre"])
#: Elements that only arrange others.
ARRANGING = frozenset(["ul", "ol", "table", "tr"])
#: What stands around the text of inline elements.
AROUND = {"strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "del": ("~~", "~~"), "s": ("~~", "~~"), "u": ("<u>", "</u>"), "sup": ("$^{", "}$"), "sub": ("$_{", "}$"), "code": ("`", "`")}
INLINE = frozenset([*AROUND, "span", "a"])
EMPTY = frozenset(["br", "hr", "img", "input"])
NOTE = "note"
#: Inline elements inside one another, at most.
DEEPEST = 128


class Element:
    """A node of a page's tree, with what its place in the tree says. ended: the tag that ended it; None while nothing has."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list[Element | str] = []
        self.ended: str | None = None
        self.classes = attributes.get("class", "").split()
        up = parent.tag if parent is not None else ""
        of = lambda name, default: getattr(parent, name) if parent is not None else default
        self.list: Element | None = parent if up in ("ul", "ol") else of("list", None)
        self.lists: int = of("lists", 0) + (up in ("ul", "ol"))
        self.quotes: int = of("quotes", 0) + (up == "blockquote")
        self.in_item: bool = of("in_item", False) or up == "li"
        self.is_shown: bool = of("is_shown", False) or up in SHOWN
        self.in_mark: bool = of("in_mark", False) or (up == "sup" and "footnote-reference" in parent.classes)
        self.deep: int = of("deep", 0) + 1 if up in INLINE else 0

    def add(self, tag: str, attributes: dict[str, str]) -> Element:
        self.items.append(Element(tag, attributes, self))
        return self.items[-1]


def _hides(e: Element) -> bool:
    """Whether what follows an element's start, up to its end tag, is not shown."""
    if e.tag == "sup":
        return "footnote-definition-label" in e.classes
    return e.tag in ("head", "title") or (e.tag == "a" and ("footnote-backref" in e.classes or _note_mark(e) is not None))


def _note_mark(e: Element) -> str | None:
    """The label of a note that a link in a reference mark leads to."""
    href = e.attributes.get("href", "")
    return href[1:] if e.in_mark and href.startswith("#") else None


class Tree:
    """The elements of a page that Markdown knows; other tags leave no trace. done() hears of each element as it ends."""

    def __init__(self, done: Callable[[Element], None], begun: Callable[[Element], None]) -> None:
        self.at = Element("", {}, None)
        self.open: Counter[str] = Counter()
        self.done, self.begun = done, begun

    def read(self, html: str) -> None:
        hidden: str | None = None
        for kind, value, attributes in tokens(html):
            if hidden is not None:
                hidden = None if kind == "end" and value == hidden else hidden
            elif kind == "text":
                self.at.items.append(value)
            elif kind == "end":
                self.end(value)
            else:
                hidden = value if self.start(value, attributes) else None

    def start(self, name: str, attributes: dict[str, str]) -> bool:
        """Opens an element; whether it hides what follows."""
        e = Element(name, attributes, self.at)
        if name == "p" and (e.in_item or self.at.tag == "li"):
            return False  # an item's paragraphs are its text
        if name == "div" and "footnote-definition" in e.classes and "id" in attributes:
            e.tag = NOTE
        if e.deep > DEEPEST:
            raise HtmlError(f"nesting exceeds {DEEPEST}")
        hides = _hides(e)
        if e.tag in EMPTY or (hides and e.tag == "a"):
            self.at.items.append(e)
            self.done(e)
        elif not hides and (e.tag in SHOWN or e.tag in ARRANGING or e.tag in INLINE or e.tag == NOTE):
            self.at.items.append(e)
            self.open[e.tag] += 1
            self.at = e
            self.begun(e)
        return hides

    def end(self, name: str) -> None:
        if name == "p" and (self.at.in_item or self.at.tag == "li"):
            return
        wanted, within = frozenset([NOTE if name == "div" else name]), False
        if name in SHOWN:
            wanted = SHOWN  # any of these ends the innermost of these
        elif name in ("ul", "ol"):
            wanted = frozenset(["ul", "ol"])
        elif name in INLINE:
            within = True  # never beyond the text it stands in
        if not any(self.open[t] for t in wanted):
            return
        e = self.at
        while e.parent is not None and e.tag not in wanted:
            if within and e.tag in SHOWN:
                return
            e = e.parent
        if e.parent is None:
            return
        while self.at is not e:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[e.tag] -= 1
        e.ended, self.at = name, e.parent
        self.done(e)


# ---- from the tree to Markdown


def inline_text(e: Element, cell: bool, math: bool = False) -> str:
    """What an element shows itself, without the blocks inside it."""
    out: list[str] = []
    for item in e.items:
        if isinstance(item, Element):
            out.append(_inline(item, cell))
        elif math:
            out.append(item)
        else:
            text = re.sub(r"\s+", " ", item)
            if out and out[-1] in ("[x]", "[ ]") and not text.startswith(" "):
                text = " " + text
            out.append(text if cell else escape(text))
    return "".join(out)


def _inline(e: Element, cell: bool) -> str:
    if e.tag in SHOWN or e.tag in ("hr", NOTE):
        return ""
    if e.tag == "br":
        return "  \n"
    if e.tag == "img":
        return _image(e)
    if e.tag == "input":
        return "" if e.attributes.get("type") != "checkbox" else "[x]" if "checked" in e.attributes else "[ ]"
    if e.tag == "a":
        return _link(e, cell)
    before, after = AROUND.get(e.tag, ("", ""))
    if e.tag == "span":
        before = after = "$" if "math-inline" in e.classes else "$$" if "math-display" in e.classes else ""
    elif e.tag == "sup" and {"footnote-reference", "footnote-definition-label"} & {*e.classes}:
        before = after = ""
    text = inline_text(e, cell, math=e.tag == "span" and bool(before))
    return before + text + (after if e.ended else "")


def _link(e: Element, cell: bool) -> str:
    label, href, name = _note_mark(e), e.attributes.get("href", ""), e.attributes.get("id", e.attributes.get("name"))
    if "footnote-backref" in e.classes:
        return ""
    if label is not None:
        return f"[^{label}]"
    text = inline_text(e, cell)
    if not href:
        quoted = None if name is None else name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")
        return text if quoted is None else f'<a id="{quoted}"></a>{text}'
    return f"[{text}]({destination(href)}{_title(e.attributes)})" if e.ended else text


def _image(e: Element) -> str:
    return f"![{escape(e.attributes.get('alt', ''))}]({destination(e.attributes.get('src', ''))}{_title(e.attributes)})"


def _raw(e: Element) -> str:
    """The text of an element with all its white space."""
    return "".join(i if isinstance(i, str) else "" if i.tag in SHOWN else _raw(i) for i in e.items)


class Writer:
    """Blocks of a page in the order in which they end, as Markdown; notes come last."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.notes: list[str] = []
        self.numbers: dict[Element, int] = {}
        self.starts: dict[Element, int] = {}

    def begun(self, e: Element) -> None:
        if e.tag == NOTE:
            self.starts[e] = len(self.out)

    def done(self, e: Element) -> None:
        """Adds the block that an element is."""
        if e.tag == "hr":
            self.out.append("---\n\n")
        elif e.tag == "img" and not e.is_shown:
            self.out.append(_image(e) + "\n\n")
        elif e.tag == "table":
            self.table(e)
        elif e.tag == NOTE:
            self.note(e)
        elif e.tag in ("ul", "ol"):
            self.out += [] if e.lists else ["\n"]
        elif e.tag == "pre":
            codes = [c for i in e.items if isinstance(i, Element) and i.tag == "code" for c in i.classes if c.startswith("language-")]
            self.out.append(f"```{codes[0][9:] if codes else ''}\n" + _raw(e).strip("\n") + "\n```\n\n")
        elif e.tag in SHOWN and e.tag not in ("td", "th"):
            self.out += self.block(e)

    def block(self, e: Element) -> list[str]:
        text = inline_text(e, cell=False).strip()
        if not text:
            return []
        if e.tag in HEADINGS:
            return ["#" * HEADINGS[e.tag] + f" {text}\n\n"]
        if e.tag == "li":
            return ["    " * max(0, e.lists - 1) + self.mark(e) + text + "\n"]
        mark = "> " * (e.quotes + (e.tag == "blockquote"))
        return ["\n".join(mark + line for line in text.split("\n")) + "\n\n"]

    def mark(self, e: Element) -> str:
        if e.list is None or e.list.tag == "ul":
            return "- "
        first = e.list.attributes.get("start", "1")
        number = self.numbers.setdefault(e.list, int(first) if first.isdigit() else 1)
        self.numbers[e.list] = number + 1
        return f"{number}. "

    def table(self, e: Element) -> None:
        """Rows and cells that nothing ended are lost."""
        rows, sides = [], []
        for row in (r for r in e.items if isinstance(r, Element) and r.tag == "tr"):
            cells = [c for c in row.items if isinstance(c, Element) and c.tag in ("td", "th")]
            for c in cells:
                for span in ("colspan", "rowspan"):
                    if c.attributes.get(span, "1").strip() != "1":
                        raise HtmlError(f"{span}={c.attributes[span]} has no form in Markdown")
            styles = [re.search(r"text-align\s*:\s*(left|center|right)", c.attributes.get("style", ""), re.I) for c in cells if c.tag == "th"]
            sides += [m and m[1].lower() for m in styles]
            if row.ended:
                rows.append([inline_text(c, cell=True).strip() for c in cells if c.ended])
        if rows:
            self.out.append(table_text(rows, sides) + "\n\n")

    def note(self, e: Element) -> None:
        """A note's blocks are kept for the end."""
        start = self.starts[e]
        body = "".join(self.out[start:]).strip()
        del self.out[start:]
        if body:
            self.notes.append(f"[^{e.attributes['id']}]: " + "\n".join("    " + line if k and line else line for k, line in enumerate(body.split("\n"))))


def to_markdown(html: str) -> str:
    writer = Writer()
    Tree(writer.done, writer.begun).read(html)
    body = "".join(writer.out).rstrip()
    if writer.notes:
        return "\n\n".join([body, *writer.notes] if body else writer.notes)
    return body + "\n" if body else ""


def markdown_of(df: DataFrame, keys: list[str], html: str = "html", failfast: bool = False) -> DataFrame:
    """(keys, markdown, error): a document with an error has null Markdown, or stops the query if failfast."""
    return through(df.select(*keys, html), lambda schema: to_markdown_step(schema, failfast))


def to_markdown_step(given: T.StructType, failfast: bool = False) -> tuple[Run, T.StructType]:
    """markdown_of() as a step of batches whose last column is the page."""
    schema = T.StructType([*given[:-1], *T._parse_datatype_string("markdown string, error string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, -1):
            made, errors = [], []
            for source in batch.column(batch.num_columns - 1).to_pylist():
                text = error = None
                try:
                    text = to_markdown(source) if source is not None else None
                except HtmlError as e:
                    if failfast:
                        raise
                    error = str(e)
                made.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return run, schema
