"""Lossless edits of OpenDocument packages through Markdown.

Markdown made from a package can carry the package in a comment at its end. Unchanged Markdown gives the same bytes back;
changed words are put into the package's own content, so styles and other parts stay; changed structure is an error.
"""

from __future__ import annotations

import base64
import json
import re
from xml.etree import ElementTree as ET

from ..operators import markdown as M
from .packages import ODF_TYPE, local, package, parts
from .structured import DataError, cell_text, markdown_sheets

BEGIN, END = "<!-- docframe-package-v1:", " -->"


def attach(text: str, data: bytes, fmt: str) -> str:
    """text with the package it was made of."""
    held = {"format": fmt, "markdown": text, "package": base64.b64encode(data).decode()}
    return f"{text.rstrip()}\n\n{BEGIN}{base64.b64encode(json.dumps(held).encode()).decode()}{END}\n"


def split(text: str) -> tuple[str, dict | None]:
    """(text, what was attached). The comment must close, and nothing may follow it."""
    head, found, tail = text.rpartition(BEGIN)
    if not found:
        return text, None
    code, closed, rest = tail.partition(END)
    if not closed:
        raise DataError("the package comment is not closed")
    if rest.strip():
        raise DataError("the package comment must be the last block")
    try:
        return head.rstrip(), json.loads(base64.b64decode(code, validate=True))
    except ValueError as e:
        raise DataError(f"the package comment is broken: {e}") from None


def leaves(text: str, fmt: str) -> list[str]:
    """The pieces of text that an edit may change, in order."""
    if fmt == "ods":
        return [cell_text(c) for _, rows in sorted(markdown_sheets(text).items()) for r in rows for c in r]
    out: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, dict):
            if x.get("type") in ("text", "code") and x.get("text", "").strip():
                out.append(x["text"])
            elif x.get("type") == "code_block":
                out.append(x["code"])
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(M.parse(text))
    return out


def apply(text: str, held: dict, fmt: str) -> bytes:
    """The package with the edits of text."""
    if held["format"] != fmt:
        raise DataError(f"the attached package is {held['format']}, not {fmt}")
    data = base64.b64decode(held["package"])
    if text.rstrip() == held["markdown"].rstrip():
        return data
    old, new = leaves(held["markdown"], fmt), leaves(text, fmt)
    shape = lambda t: re.sub(r"[^\s|#>*_`\-\[\]()]+", "x", re.sub(r"\\.", "x", t))
    if len(old) != len(new) or len(shape(text.rstrip()).split("\n")) != len(shape(held["markdown"].rstrip()).split("\n")):
        raise DataError("the edit changes the document's structure; only words can be changed")
    files = parts(data)
    content = files["content.xml"]
    for prefix, uri in set(re.findall(rb'xmlns:([A-Za-z0-9]+)="([^"]+)"', content)):
        ET.register_namespace(prefix.decode(), uri.decode())
    root = ET.fromstring(content)
    places = _cells(root) if fmt == "ods" else _texts(root)
    at = 0
    for a, b in zip(old, new):
        if fmt == "ods" and not a and not b:
            continue
        while at < len(places) and places[at][0]().strip() != a.strip():
            at += 1
        if at == len(places):
            raise DataError("the edit can't be found in the package")
        if a != b:
            places[at][1](b)
        at += 1
    return package(files | {"content.xml": ET.tostring(root, encoding="utf-8", xml_declaration=True), "mimetype": ODF_TYPE[fmt]}, first="mimetype")


def _texts(root: ET.Element) -> list[tuple]:
    """(get, put) of each piece of text inside paragraphs and headings."""
    out: list[tuple] = []

    def walk(e: ET.Element, inside: bool) -> None:
        inside = inside or local(e) in ("p", "h")
        if inside and (e.text or "").strip():
            out.append((lambda: e.text or "", lambda v: setattr(e, "text", v)))
        for c in e:
            walk(c, inside)
            if inside and (c.tail or "").strip():
                out.append((lambda c=c: c.tail or "", lambda v, c=c: setattr(c, "tail", v)))

    walk(root, False)
    return out


def _cells(root: ET.Element) -> list[tuple]:
    """(get, put) of each cell, in the order of sheet names; a put keeps the cell's type."""
    out: list[tuple] = []
    tables = [t for t in root.iter() if local(t) == "table"]
    key = lambda e, name: next((k for k in e.attrib if k.rpartition("}")[2] == name), None)
    for t in sorted(tables, key=lambda t: t.attrib.get(key(t, "name") or "", "")):
        for c in (c for c in t.iter() if local(c) == "table-cell"):

            def get(c: ET.Element = c) -> str:
                return "\n".join("".join(p.itertext()) for p in c if local(p) == "p")

            def put(v: str, c: ET.Element = c) -> None:
                kind = c.attrib.get(key(c, "value-type") or "", "string")
                if kind == "boolean":
                    if v not in ("true", "false"):
                        raise DataError(f"{v} is not true or false")
                    c.set(key(c, "boolean-value"), v)
                elif kind in ("float", "percentage", "currency"):
                    try:
                        float(v)
                    except ValueError:
                        raise DataError(f"{v} is not a number") from None
                    c.set(key(c, "value"), v)
                own = [p for p in c if local(p) == "p"]
                for p, line in zip(own, v.split("\n")):
                    for x in list(p):
                        p.remove(x)
                    p.text = line

            out.append((get, put))
    return out
