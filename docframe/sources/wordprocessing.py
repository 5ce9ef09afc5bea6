"""Word-processing packages to and from the document tree."""

from __future__ import annotations

import re
from collections.abc import Mapping
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from ..operators import markdown as M
from ..operators.equations import latex
from ..operators.formulas import with_formulas
from .images import Parts, data_uri, extent
from .packages import _A, _R, _W, _XML, _rels, _types, _xml, attr, child, local, package, parts, relationships
from .structured import DataError

_RUN = {"strong": "<w:b/>", "emphasis": "<w:i/>", "strikethrough": "<w:strike/>", "underline": '<w:u w:val="single"/>', "superscript": '<w:vertAlign w:val="superscript"/>', "subscript": '<w:vertAlign w:val="subscript"/>', "code": '<w:rStyle w:val="Code"/>'}
DEEPEST_LIST = 9
#: Room for an image on a page, in EMU.
PAGE_WIDTH, PAGE_HEIGHT = 5_486_400, 7_315_200
_PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
_WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"


class _Writer:
    def __init__(self, assets: Mapping[str, bytes] | None = None) -> None:
        self.pictures, self.drawn = Parts("word/media", assets), 0
        self.rels: list[tuple[str, str, str, bool]] = []
        self.notes: dict[str, list[dict]] = {}
        self.number: dict[str, int] = {}
        self.lists: list[tuple[bool, int]] = []
        self.marks = 0
        self.code_styles: dict[str, None] = {"CodeBlock": None}  # one for each language that code names

    def run(self, text: str, props: str) -> str:
        body = "".join('<w:br/>' if p == "\n" else "<w:tab/>" if p == "\t" else f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in re.split("([\n\t])", text) if p)
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>"

    def inline(self, items: list[dict], props: str = "") -> str:
        out = []
        for i in items:
            kind = i["type"]
            if kind == "text":
                out.append(self.run(i["text"], props))
            elif kind == "code":
                out.append(self.run(i["text"], props + _RUN["code"]))
            elif kind == "math":
                out.append(f'<w:r><w:rPr><w:rStyle w:val="Math"/></w:rPr><w:t xml:space="preserve">{escape(M.render_inline(i))}</w:t></w:r>')
            elif kind in _RUN:
                out.append(self.inline(i["content"], props + _RUN[kind]))
            elif kind == "link":
                inner, tip = self.inline(i["content"], props), f" w:tooltip={quoteattr(i['title'])}" if i.get("title") is not None else ""
                if i["destination"].startswith("#"):
                    out.append(f"<w:hyperlink w:anchor={quoteattr(i['destination'][1:])}{tip}>{inner}</w:hyperlink>")
                else:
                    self.rels.append((f"rIdL{len(self.rels)}", "hyperlink", i["destination"], True))
                    out.append(f'<w:hyperlink r:id="{self.rels[-1][0]}"{tip}>{inner}</w:hyperlink>')
            elif kind == "bookmark":
                self.marks += 1
                out.append(f'<w:bookmarkStart w:id="{self.marks}" w:name={quoteattr(i["name"])}/><w:bookmarkEnd w:id="{self.marks}"/>')
            elif kind in ("footnote_reference", "footnote"):
                label = i.get("label") or f"inline-{len(self.number) + 1}"
                if kind == "footnote":
                    self.notes[label] = [{"type": "paragraph", "content": i["content"]}]
                n = self.number.setdefault(label, len(self.number) + 1)
                kind = "endnote" if label.startswith("endnote-") else "footnote"
                out.append(f'<w:r><w:{kind}Reference w:id="{n}"/></w:r>')
            elif kind == "hard_break":
                out.append("<w:r><w:br/></w:r>")
            elif kind == "image":
                out.append(self.image(i.get("destination", ""), i.get("alt", ""), i.get("title")))
            else:
                out.append(self.run(" " if kind == "soft_break" else M.render_inline(i), props))
        return "".join(out)

    def image(self, destination: str, alt: str, title: str | None = None) -> str:
        """A drawing in a run: a part of the package if the image's bytes are there, else a link."""
        found = self.pictures.add(destination)
        self.drawn += 1
        self.rels.append((f"rIdI{len(self.rels)}", "image", found[0].removeprefix("word/") if found else destination, not found))
        x, y = extent(found and found[1], PAGE_WIDTH, PAGE_HEIGHT)
        named = f'id="{self.drawn}" name="Picture {self.drawn}" descr={quoteattr(alt)}' + (f" title={quoteattr(title)}" if title is not None else "")
        fill = f'<pic:blipFill><a:blip r:{"embed" if found else "link"}="{self.rels[-1][0]}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{x}" cy="{y}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
        picture = f'<pic:pic xmlns:pic="{_PIC}"><pic:nvPicPr><pic:cNvPr {named}/><pic:cNvPicPr/></pic:nvPicPr>{fill}{shape}</pic:pic>'
        graphic = f'<a:graphic xmlns:a="{_A}"><a:graphicData uri="{_PIC}">{picture}</a:graphicData></a:graphic>'
        return f'<w:r><w:drawing><wp:inline xmlns:wp="{_WP}"><wp:extent cx="{x}" cy="{y}"/><wp:docPr {named}/>{graphic}</wp:inline></w:drawing></w:r>'

    def paragraph(self, body: str, style: str = "", extra: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"

    def blocks(self, items: list[dict], style: str = "") -> str:
        return "".join(self.block(b, style) for b in items)

    def block(self, b: dict, style: str = "") -> str:
        kind = b["type"]
        content = lambda: (self.run(b["text"], "") if b.get("text") else "") + self.inline(b.get("content", []))
        if kind == "heading":
            return self.paragraph(content(), f"Heading{b['level']}")
        if kind == "paragraph":
            return self.paragraph(content(), style)
        if kind == "list":
            return self.list(b, 0)
        if kind == "table":
            rows = b.get("cells") or [[[{"type": "text", "text": c}] for c in r] for r in b.get("rows", [])]
            side = {"left": "left", "right": "right", "center": "center"}
            sides = [side.get(a, "") for a in b.get("alignments", [])]
            cell = lambda k, c: f"<w:tc>{self.paragraph(self.inline(c), extra=f'<w:jc w:val={chr(34)}{sides[k]}{chr(34)}/>' if k < len(sides) and sides[k] else '')}</w:tc>"
            return "<w:tbl>" + "".join("<w:tr>" + "".join(cell(k, c) for k, c in enumerate(r)) + "</w:tr>" for r in rows) + "</w:tbl>"
        if kind == "code_block":
            style = "CodeBlock" + (f"-{b['info']}" if b.get("info") else "")
            self.code_styles.setdefault(style)
            return self.paragraph(self.run(b["code"], ""), escape(style, {'"': "&quot;"}))
        if kind == "quote":
            return self.blocks(b["blocks"], "Quote") if b.get("blocks") else self.paragraph(self.run(b.get("text") or "", ""), "Quote")
        if kind == "horizontal_rule":
            return self.paragraph("", "Rule")
        if kind == "math":
            return self.paragraph(self.run(b["text"], ""), "MathBlock")
        if kind == "footnote_definition":
            self.notes[b["label"]] = b["blocks"]
            return ""
        if kind == "image":
            return self.paragraph(self.image(f"data:image/{b['format']};base64,{b['data']}", b.get("alt", "")))
        return self.paragraph(self.run(M.render_block(b), ""))

    def list(self, b: dict, level: int, number: int | None = None) -> str:
        if level >= DEEPEST_LIST:
            raise DataError(f"a list is nested in more than {DEEPEST_LIST} levels")
        self.lists.append((b["ordered"], b.get("start") or 1))
        own, out = len(self.lists), []
        for item in b["items"]:
            first = True
            for child_ in item["blocks"] or [{"type": "paragraph", "content": []}]:
                if child_["type"] == "list":
                    out.append(self.list(child_, level + 1))
                elif first and child_["type"] == "paragraph":
                    out.append(self.paragraph(self.inline(child_["content"]), "", f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{own}"/></w:numPr>'))
                else:
                    out.append(self.block(child_))
                first = False
        return "".join(out)


def write(blocks: list[dict], assets: Mapping[str, bytes] | None = None) -> bytes:
    w = _Writer(assets)
    body = w.blocks(blocks)
    ns = f'xmlns:w="{_W}" xmlns:r="{_R}"'
    files: dict[str, str | bytes] = {}
    notes = {"footnote": [], "endnote": []}
    for label, n in list(w.number.items()):
        kind = "endnote" if label.startswith("endnote-") else "footnote"
        notes[kind].append(f'<w:{kind} w:id="{n}" w:label={quoteattr(label)}>{w.blocks(w.notes.get(label, []))}</w:{kind}>')
    rels = [*w.rels, ("rIdS", "styles", "styles.xml", False), ("rIdN", "numbering", "numbering.xml", False)]
    types = {"word/document.xml": "wordprocessingml.document.main", "word/styles.xml": "wordprocessingml.styles", "word/numbering.xml": "wordprocessingml.numbering"}
    for kind, own in notes.items():
        if own:
            files[f"word/{kind}s.xml"] = f"{_XML}<w:{kind}s {ns}>{''.join(own)}</w:{kind}s>"
            rels.append((f"rId{kind}", f"{kind}s", f"{kind}s.xml", False))
            types[f"word/{kind}s.xml"] = f"wordprocessingml.{kind}s"
    levels = lambda ordered, start: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{start if not k else 1}"/><w:numFmt w:val="{"decimal" if ordered else "bullet"}"/></w:lvl>' for k in range(DEEPEST_LIST))
    files["word/numbering.xml"] = f"{_XML}<w:numbering {ns}>" + "".join(f'<w:abstractNum w:abstractNumId="{k}">{"".join(f"""<w:lvl w:ilvl="{l}"><w:start w:val="{s}"/><w:numFmt w:val="{"decimal" if o else "bullet"}"/></w:lvl>""" for l in range(DEEPEST_LIST))}</w:abstractNum>' for k, (o, s) in enumerate(w.lists, 1)) + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(1, len(w.lists) + 1)) + "</w:numbering>"
    styles = [f"Heading{k}" for k in range(1, 7)] + ["Quote", *(escape(c, {'"': "&quot;"}) for c in w.code_styles), "Rule", "MathBlock"]
    files["word/styles.xml"] = f"{_XML}<w:styles {ns}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{re.sub(r"(?<=g)(?=[0-9])", " ", s)}"/></w:style>' for s in styles) + '<w:style w:type="character" w:styleId="Code"><w:name w:val="Code"/><w:rPr><w:rFonts w:ascii="Courier New"/></w:rPr></w:style><w:style w:type="character" w:styleId="Math"><w:name w:val="Math"/></w:style></w:styles>'
    files["word/document.xml"] = f"{_XML}<w:document {ns}><w:body>{body}</w:body></w:document>"
    files["word/_rels/document.xml.rels"] = _rels(rels)
    files["_rels/.rels"] = _rels([("rId1", "officeDocument", "word/document.xml", False)])
    files["[Content_Types].xml"] = _types(types)
    return package(files | w.pictures.files)


def roman(n: int) -> str:
    """A Roman number; numbers outside 1 to 3999 as they are."""
    if not 0 < n < 4000:
        return str(n)
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


class _Reader:
    def __init__(self, files: dict[str, bytes]) -> None:
        self.files = files
        self.rels = relationships(files, "word/document.xml")
        self.labels: dict[tuple[str, str], str] = {}
        self.kinds: dict[tuple[str, int], tuple[bool, int]] = {}
        self.endnote_format, self.endnotes = "lowerRoman", 1
        for part in ("word/settings.xml", "word/document.xml"):  # the document's own properties win
            for p in _xml(files[part]).iter() if part in files else ():
                if local(p) == "endnotePr":
                    self.endnote_format = attr(child(p, "numFmt"), "val") or self.endnote_format
                    self.endnotes = int(attr(child(p, "numStart"), "val") or self.endnotes)
        if "word/numbering.xml" in files:
            root = _xml(files["word/numbering.xml"])
            abstract = {attr(a, "abstractNumId"): {int(attr(l, "ilvl")): (attr(child(l, "numFmt"), "val") != "bullet", int(attr(child(l, "start"), "val") or 1)) for l in a if local(l) == "lvl"} for a in root if local(a) == "abstractNum"}
            for n in (n for n in root if local(n) == "num"):
                levels = dict(abstract.get(attr(child(n, "abstractNumId"), "val"), {}))
                for o in (o for o in n if local(o) == "lvlOverride"):  # an override's start wins
                    k, s = int(attr(o, "ilvl")), child(o, "startOverride")
                    levels[k] = (levels.get(k, (True, 1))[0], int(attr(s, "val"))) if s is not None else levels.get(k, (True, 1))
                self.kinds |= {(attr(n, "numId"), k): v for k, v in levels.items()}

    @staticmethod
    def on(props: ET.Element | None, name: str) -> bool:
        e = child(props, name)
        return e is not None and attr(e, "val") not in ("false", "0", "off", "none")

    def runs(self, e: ET.Element) -> list[dict]:
        """Inlines of a paragraph; adjacent runs of the same look are one."""
        out: list[dict] = []
        pending: tuple[tuple[str, ...], str] = ((), "")

        def flush() -> None:
            nonlocal pending
            marks, text = pending
            pending = ((), "")
            if not text:
                return
            if marks == ("math",):
                n = 2 if text.startswith("$$") else 1
                M._add(out, {"type": "math", "text": text[n:-n], "display": n == 2})
                return
            lead, core, trail = re.fullmatch(r"(\s*)(.*?)(\s*)", text, re.S).groups() if marks else ("", text, "")
            M._add(out, {"type": "text", "text": lead})
            if core:
                item: dict = {"type": "text", "text": core}
                for m in marks:
                    item = {"type": "code", "text": core} if m == "code" else {"type": m, "content": [item]}
                M._add(out, item)
            M._add(out, {"type": "text", "text": trail})

        for r in e:
            n = local(r)
            if n == "hyperlink":
                flush()
                target = "#" + attr(r, "anchor") if attr(r, "anchor") else self.rels.get(attr(r, "id") or "", "")
                inner = self.runs(r)
                title = {"title": attr(r, "tooltip")} if attr(r, "tooltip") is not None else {}
                for i in [{"type": "link", "destination": target, "content": inner} | title] if target else inner:
                    M._add(out, i)
            elif n == "bookmarkStart" and not (attr(r, "name") or "_").startswith("_"):
                flush()
                M._add(out, {"type": "bookmark", "name": attr(r, "name")})
            elif n in ("oMath", "oMathPara"):
                flush()
                M._add(out, {"type": "math", "text": latex(r), "display": n == "oMathPara"})
            elif n in ("ins", "smartTag", "sdt", "sdtContent"):
                flush()
                for i in self.runs(r):
                    M._add(out, i)
            elif n == "r":
                p = child(r, "rPr")
                style = attr(child(p, "rStyle"), "val") or ""
                script = attr(child(p, "vertAlign"), "val")
                marks = ("math",) if style == "Math" else tuple(m for m, ok in (("code", style == "Code"), ("superscript", script == "superscript"), ("subscript", script == "subscript"), ("emphasis", self.on(p, "i")), ("strong", self.on(p, "b")), ("strikethrough", self.on(p, "strike")), ("underline", self.on(p, "u"))) if ok)
                for c in r:
                    k = local(c)
                    if k in ("t", "tab", "noBreakHyphen"):
                        if pending[0] != marks or marks == ("math",):
                            flush()
                        pending = (marks, pending[1] + {"t": c.text or "", "tab": "\t", "noBreakHyphen": "-"}[k])
                    elif k in ("br", "cr"):
                        flush()
                        M._add(out, {"type": "hard_break"})
                    elif k in ("footnoteReference", "endnoteReference"):
                        flush()
                        M._add(out, {"type": "footnote_reference", "label": self.label(k[:-9], attr(c, "id") or "")})
                    elif k in ("drawing", "pict"):
                        flush()
                        blip = next((x for x in c.iter() if local(x) == "blip"), None)
                        part = self.rels.get(attr(blip, "embed") or attr(blip, "link") or "")
                        if part:
                            named = next((x for x in c.iter() if local(x) == "docPr"), None)
                            target = data_uri(self.files[part]) if part in self.files else part
                            title = {"title": attr(named, "title")} if attr(named, "title") is not None else {}
                            M._add(out, {"type": "image", "alt": attr(named, "descr") or "", "destination": target} | title)
        flush()
        return out

    def label(self, kind: str, note: str) -> str:
        if (kind, note) not in self.labels:
            part = f"word/{kind}s.xml"
            own = next((attr(x, "label") for x in (_xml(self.files[part]) if part in self.files else ()) if attr(x, "id") == note), None)
            self.labels[kind, note] = own or (note if kind == "footnote" else self.endnote())
        return self.labels[kind, note]

    def endnote(self) -> str:
        """The label of the next endnote that is used first: numbers, or Roman ones, from the document's start on."""
        n = self.endnotes
        self.endnotes += 1
        number = roman(n) if self.endnote_format.endswith("Roman") else str(n)
        return "endnote-" + (number.lower() if self.endnote_format == "lowerRoman" else number)

    def merged(self, e: ET.Element) -> dict | None:
        """A table with merged cells, as HTML; None for others."""
        spans: dict[tuple[int, int], list[int]] = {}  # by place of the first cell: columns and rows
        text: dict[tuple[int, int], str] = {}
        above: dict[int, tuple[int, int]] = {}  # by column: the first cell of a vertical merge that goes on
        for y, r in enumerate(r for r in e if local(r) == "tr"):
            x = 0
            for c in (c for c in r if local(c) == "tc"):
                width = int(attr(child(c, "tcPr", "gridSpan"), "val") or 1)
                merge = child(c, "tcPr", "vMerge")
                goes_on = merge is not None and attr(merge, "val") != "restart"
                if goes_on and x in above:
                    spans[above[x]][1] += 1
                else:
                    spans[y, x] = [width, 1]
                    text[y, x] = "<br>".join(M.render_inlines(self.runs(p)) for p in c if local(p) == "p")
                for k in range(x, x + width):
                    if merge is None:
                        above.pop(k, None)
                    elif not goes_on:
                        above[k] = (y, x)
                x += width
        if all(s == [1, 1] for s in spans.values()) and not any(local(c) == "vMerge" for c in e.iter()):
            return None
        out = ["<table>"]
        for y in sorted({y for y, _ in spans}):
            out.append("  <tr>")
            for at in sorted(k for k in spans if k[0] == y):
                more = "".join(f' {n}="{v}"' for n, v in zip(("colspan", "rowspan"), spans[at]) if v > 1)
                out.append(f"    <td{more}>{escape(text[at])}</td>")
            out.append("  </tr>")
        return {"type": "html", "html": "\n".join([*out, "</table>"])}

    def table(self, e: ET.Element) -> dict:
        whole = self.merged(e)
        if whole:
            return whole
        rows, sides = [], []
        for r in (r for r in e if local(r) == "tr"):
            row = []
            for c in (c for c in r if local(c) == "tc"):
                paragraphs = [p for p in c if local(p) == "p"]
                cell: list[dict] = []
                for k, p in enumerate(paragraphs):
                    cell += [{"type": "html", "html": "<br>"}] * bool(k) + self.runs(p)
                if not rows and paragraphs:
                    sides.append({"left": "left", "right": "right", "center": "center"}.get(attr(child(paragraphs[0], "pPr", "jc"), "val"), "none"))
                row += [cell] + [[]] * (int(attr(child(c, "tcPr", "gridSpan"), "val") or 1) - 1)
            rows.append(row)
        width = max(map(len, rows), default=0)
        block = {"type": "table", "cells": [r + [[]] * (width - len(r)) for r in rows]}
        return block | ({"alignments": sides} if any(s != "none" for s in sides) else {})

    def blocks(self, body: ET.Element) -> list[dict]:
        out: list[dict] = []
        open_: list[tuple[str, int, dict]] = []  # lists from the outermost in
        for e in body:
            n = local(e)
            if n in ("sdt", "sdtContent"):
                out += self.blocks(e)
                continue
            if n == "tbl":
                open_ = []
                out.append(self.table(e))
                continue
            if n != "p":
                continue
            style, number = attr(child(e, "pPr", "pStyle"), "val") or "", child(e, "pPr", "numPr")
            content = self.runs(e)
            if number is not None and attr(child(number, "numId"), "val") not in (None, "0"):
                self.item(out, open_, attr(child(number, "numId"), "val"), int(attr(child(number, "ilvl"), "val") or 0), content)
                continue
            open_ = []
            heading = re.fullmatch(r"[Hh]eading ?([1-9])", style)
            if heading:
                out.append({"type": "heading", "level": min(int(heading[1]), 6), "content": content})
            elif style == "Title":
                out.append({"type": "heading", "level": 1, "content": content})
            elif style == "Rule":
                out.append({"type": "horizontal_rule"})
            elif style.partition("-")[0] in ("CodeBlock", "MathBlock"):
                text, info = "".join("\n" if i["type"] == "hard_break" else M.plain([i]) for i in content), style.partition("-")[2]
                out.append({"type": "code_block", "code": text} | ({"info": info} if info else {}) if style != "MathBlock" else {"type": "math", "text": text})
            elif content:
                paragraph = {"type": "paragraph", "content": content}
                out.append({"type": "quote", "blocks": [paragraph]} if style == "Quote" else paragraph)
        return out

    def item(self, out: list[dict], open_: list, num: str, level: int, content: list[dict]) -> None:
        while open_ and (open_[-1][1] > level or open_[-1][1] == level and open_[-1][0] != num):
            open_.pop()
        if not open_ or open_[-1][1] < level:
            ordered, start = self.kinds.get((num, level), (num != "1", 1))
            block = {"type": "list", "ordered": ordered, **({"start": start} if ordered else {}), "items": []}
            (open_[-1][2]["items"][-1]["blocks"] if open_ and open_[-1][2]["items"] else out).append(block)
            open_.append((num, level, block))
        block = open_[-1][2]
        if content and content[0]["type"] == "text" and (t := re.match(r"\[([ x])\] ", content[0]["text"])):
            content[0]["text"] = content[0]["text"][4:]
            content.insert(0, {"type": "task_list_marker", "checked": t[1] == "x"})
        item: dict = {"blocks": [{"type": "paragraph", "content": content}]}
        if block["ordered"]:
            item = {"number": block["start"] + len(block["items"])} | item
        block["items"].append(item)


_TEXT_NOTE = re.compile(r"\s*\[([0-9]+|[ivxlcdm]+)\] ")


def textual_notes(blocks: list[dict]) -> list[dict]:
    """Notes written by hand: paragraphs `[1] text`, and `[1]` where other text refers to them.

    All such paragraphs leave the text; those that something refers to become footnotes at the end.
    """

    def label(b: dict) -> str | None:
        first = b.get("content") or [{}] if b["type"] == "paragraph" else [{}]
        m = _TEXT_NOTE.match(first[0].get("text", "")) if first[0].get("type") == "text" else None
        return m and m[1]

    def texts(x: object) -> str:
        if isinstance(x, dict):
            return x["text"] if x.get("type") == "text" else "".join(map(texts, x.values()))
        return "\0".join(map(texts, x)) if isinstance(x, list) else ""

    definitions = {}
    for b in blocks:
        if label(b):
            definitions.setdefault(label(b), b)
    if not definitions:
        return blocks
    body = [b for b in blocks if not label(b)]
    used = [n for n in definitions if f"[{n}]" in texts([b for b in blocks if label(b) != n])]

    def linked(x: object) -> object:
        if isinstance(x, list):
            out: list = []
            for i in x:
                if isinstance(i, dict) and i.get("type") == "text":
                    for k, part in enumerate(re.split(r"\[([^\[\]]+)\]", i["text"])):
                        if k % 2 and part in used:
                            out.append({"type": "footnote_reference", "label": part})
                        else:
                            M._add(out, {"type": "text", "text": f"[{part}]" if k % 2 else part})
                else:
                    out.append(linked(i))
            return out
        return {k: linked(v) for k, v in x.items()} if isinstance(x, dict) else x

    notes = []
    for n in used:
        content = [dict(i) for i in definitions[n]["content"]]
        content[0]["text"] = _TEXT_NOTE.sub("", content[0]["text"], count=1)
        notes.append({"type": "footnote_definition", "label": n, "blocks": [{"type": "paragraph", "content": [i for i in content if i.get("text") != ""]}]})
    return [*linked(body), *notes]


def read(data: bytes) -> list[dict]:
    files = parts(data)
    if "word/document.xml" not in files:
        raise DataError("the document part is missing")
    r = _Reader(files)
    body = child(_xml(files["word/document.xml"]), "body")
    blocks = with_formulas(textual_notes(r.blocks(body if body is not None else ET.Element("body"))))
    for (kind, note), label in list(r.labels.items()):  # only notes that something refers to
        part = f"word/{kind}s.xml"
        own = next((x for x in (_xml(files[part]) if part in files else ()) if attr(x, "id") == note), None)
        if own is not None and re.fullmatch("[1-9][0-9]*", note):
            blocks.append({"type": "footnote_definition", "label": label, "blocks": r.blocks(own)})
    return blocks
