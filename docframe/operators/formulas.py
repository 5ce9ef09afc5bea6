"""Formulas written as plain text, as LaTeX: roots, one fraction, symbols, and matrices line by line.

Only paragraphs below a heading about formulas are looked at, and of these only what has a label: `Area: (a+b)/(2)`, or a
label on a line of its own and the formula below it.
"""

from __future__ import annotations

import re

from . import markdown as M
from .equations import SYMBOLS

#: What a heading about formulas holds, in lower case.
HEADINGS = ("formula", "\u0444\u043e\u0440\u043c\u0443\u043b")


def _group(text: str, at: int) -> int:
    """Where the round bracket that opens at `at` is closed; -1 if none opens there or it stays open."""
    if text[at : at + 1] != "(":
        return -1
    depth = 0
    for k in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        if not depth:
            return k
    return -1


def latex_of_text(text: str) -> str:
    """Plain text of a formula as LaTeX."""
    text = text.replace("$", "")
    out, at = [], 0
    while at < len(text):
        if text[at] != "\u221a":
            out.append(text[at])
            at += 1
            continue
        stop = _group(text, at + 1)
        out.append("\\sqrt" + (f"{{{text[at + 2 : stop]}}}" if stop > 0 else ""))
        at = max(stop, at) + 1
    text = "".join(out)
    bare = text.strip()
    stop = _group(bare, 0)
    below = re.fullmatch(r"\s*/\s*\(([^(]*)\)", bare[stop + 1 :]) if stop > 0 else None
    if below:
        text = f"\\frac{{{bare[1:stop]}}}{{{below[1]}}}"
    for symbol, command in SYMBOLS.items():
        text = text.replace(symbol, command)
    return text


def is_formula(text: str) -> bool:
    """Whether a text has digits, and no letters but plain Latin ones."""
    return any(c in "0123456789" for c in text) and not any(c.isalpha() and not c.isascii() for c in text)


def _matrix(lines: list[str]) -> str | None:
    rows = [re.fullmatch(r"\[\s*(\S.*?)\s*\]", line.strip()) for line in lines]
    return None if len(rows) < 2 or not all(rows) else "\\begin{matrix} " + " \\\\ ".join(" & ".join(r[1].split()) for r in rows) + " \\end{matrix}"


def _converted(content: list[dict]) -> list[dict]:
    """Inlines of a paragraph, with its formula as math; others as they are."""
    if any(i["type"] not in ("text", "hard_break", "math") for i in content):
        return content
    lines: list[str] = [""]
    for i in content:
        if i["type"] == "math":
            return [j | {"text": latex_of_text(j["text"])} if j["type"] == "math" else j for j in content]
        if i["type"] == "hard_break":
            lines.append("")
        else:
            lines[-1] += i["text"]
    if len(lines) > 1 and lines[0].rstrip().endswith(":"):
        formula = _matrix(lines[1:]) or latex_of_text(" ".join(lines[1:]))
        return [{"type": "text", "text": lines[0]}, {"type": "hard_break"}, {"type": "math", "text": formula, "display": True}]
    label, colon, formula = lines[0].partition(": ")
    if len(lines) == 1 and colon and is_formula(formula):
        return [{"type": "text", "text": label + colon}, {"type": "math", "text": latex_of_text(formula), "display": False}]
    return content


def with_formulas(blocks: list[dict]) -> list[dict]:
    """A document's blocks, in which formulas written as text are math."""
    out, inside = [], False
    for b in blocks:
        if b["type"] == "heading":
            title = (M.plain(b.get("content", [])) or b.get("text") or "").lower()
            inside = any(h in title for h in HEADINGS)
        elif inside and b["type"] == "paragraph" and b.get("content"):
            b = b | {"content": _converted(b["content"])}
        out.append(b)
    return out
