"""Markdown to and from a typed tree of blocks and inlines.

Blocks and inlines are dicts with a `type`. The parser takes the usual block structure (headings, rules, fences, quotes,
lists, tables, math and footnote blocks, HTML blocks, paragraphs with soft and hard breaks) and inline syntax; emphasis
follows a stack of open marks. The renderer writes canonical Markdown: parsing that gives the same tree.
"""

from __future__ import annotations

import re

DEEPEST = 128
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})\s*(.*?)\s*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)])(?:( +)(.*)|$)")
_NOTE = re.compile(r"^\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML_BLOCK = re.compile(r"^ {0,3}<(?:!--|[!?]|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b)", re.I)
_INLINE_HTML = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s+[^<>]*?)?)\s*(/?)>")
_LINK_TAIL = re.compile(r"""\(\s*(?:<((?:\\.|[^<>\\\n])*)>|((?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*))(?:\s+"((?:\\.|[^"\\])*)"|\s+'((?:\\.|[^'\\])*)')?\s*\)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))""")
_WRAPS = {"u": "underline", "sup": "superscript", "sub": "subscript", "strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "s": "strikethrough", "del": "strikethrough"}


class MarkdownError(ValueError):
    """The text or tree can't be represented."""


def _unescape(text: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


# ---- inlines

#: Text without marks, as far as blanks don't end a line; and the end of a line with the blanks around it.
_PLAIN = re.compile(r"(?:[^\\\n `$\[!^<*_~]++| ++(?!\n))++")
_BREAK = re.compile(r"( *\n) *")


def _add(out: list[dict], item: dict) -> None:
    if item["type"] == "text":
        if not item["text"]:
            return
        if out and out[-1]["type"] == "text":
            out[-1]["text"] += item["text"]
            return
        item = dict(item)
    out.append(item)


def _closing(text: str, at: int) -> int:
    """Where the bracket that opens at `at` closes, or -1; escapes and code are passed over."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "`":
            run = len(text) - at - len(text[at:].lstrip("`"))
            stop = re.search(rf"(?<!`)`{{{run}}}(?!`)", text[at + run :])
            at += run + (stop.end() if stop else 0) - 1
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return at
        at += 1
    return -1


def parse_inlines(text: str, depth: int = 0) -> list[dict]:
    """Inlines of a block's text."""
    if depth > DEEPEST:
        raise MarkdownError(f"nesting exceeds {DEEPEST}")
    # frames: [mark, type, inlines]; the first is the result
    frames: list[list] = [["", "", []]]
    at = 0

    def put(item: dict) -> None:
        _add(frames[-1][2], item)

    def close(k: int) -> None:
        """Closes frame k; marks that opened after it stay text."""
        while len(frames) - 1 > k:
            mark, _, inner = frames.pop()
            put({"type": "text", "text": mark})
            for i in inner:
                put(i)
        _, kind, inner = frames.pop()
        put({"type": kind, "content": inner})

    while at < len(text):
        if m := _PLAIN.match(text, at):
            put({"type": "text", "text": m.group()})
            at = m.end()
            continue
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            if text[at + 1] == "\n":
                put({"type": "hard_break"})
                at += 2
                continue
            if re.match(r"[!-/:-@\[-`{-~]", text[at + 1]):
                put({"type": "text", "text": text[at + 1]})
                at += 2
                continue
        if run := _BREAK.match(text, at):
            put({"type": "hard_break" if len(run[1]) > 2 else "soft_break"})
            at = run.end()
            continue
        if c == "`":
            run = re.match(r"`+", text[at:]).group()
            stop = re.search(rf"(?<!`){run}(?!`)", text[at + len(run) :])
            if stop:
                code = text[at + len(run) : at + len(run) + stop.start()].replace("\n", " ")
                if code.startswith(" ") and code.endswith(" ") and code.strip():
                    code = code[1:-1]
                put({"type": "code", "text": code})
                at += len(run) + stop.end()
                continue
            put({"type": "text", "text": run})
            at += len(run)
            continue
        if c == "$" and (m := re.match(r"\$\$(.+?)\$\$|\$(?=\S)((?:\\.|[^$\\])+?)(?<=\S)\$(?!\d)", text[at:], re.S)):
            body = m[1] if m[1] is not None else m[2]
            script = re.fullmatch(r"([\^_])\{(.*)\}", body, re.S) if m[1] is None else None
            if script:
                put({"type": "superscript" if script[1] == "^" else "subscript", "content": parse_inlines(script[2], depth + 1)})
            else:
                put({"type": "math", "text": body, "display": m[1] is not None})
            at += m.end()
            continue
        if c in "[!^" and (c == "[" or text[at + 1 : at + 2] == "["):
            start = at + (c != "[")
            stop = _closing(text, start)
            if stop > 0:
                inner = text[start + 1 : stop]
                if c == "^":
                    put({"type": "footnote", "content": parse_inlines(inner, depth + 1)})
                    at = stop + 1
                    continue
                if c == "[" and re.fullmatch(r"\^[^\s\]]+", inner):
                    put({"type": "footnote_reference", "label": inner[1:]})
                    at = stop + 1
                    continue
                tail = _LINK_TAIL.match(text, stop + 1)
                if tail:
                    target = _unescape(tail[1] if tail[1] is not None else tail[2] or "")
                    title = tail[3] if tail[3] is not None else tail[4]
                    item: dict = {"type": "image", "alt": plain(parse_inlines(inner, depth + 1))} if c == "!" else {"type": "link"}
                    item["destination"] = target
                    if title is not None:
                        item["title"] = _unescape(title)
                    if c == "[":
                        item["content"] = parse_inlines(inner, depth + 1)
                    put(item)
                    at = tail.end()
                    continue
        if c == "<":
            if m := re.match(r"<((?:https?|mailto|tel):[^\s<>]+)>", text[at:]):
                put({"type": "link", "destination": m[1], "content": [{"type": "text", "text": m[1]}]})
                at += m.end()
                continue
            if m := _INLINE_HTML.match(text, at):
                end, name, rest = m[1], m[2].lower(), {k.lower(): a or b or d for k, a, b, d in _ATTRIBUTE.findall(m[3])}
                at = m.end()
                if name == "br":
                    put({"type": "hard_break"})
                elif name == "a" and not end and not rest.get("href") and (rest.get("id") or rest.get("name")):
                    put({"type": "bookmark", "name": rest.get("id") or rest.get("name")})
                    at += len(text[at:]) - len(text[at:].removeprefix("</a>"))
                elif name in _WRAPS or name == "code" or name == "a" and (end or rest.get("href")):
                    stop = re.compile(rf"</{name}\s*>", re.I).search(text, at) if not end else None
                    if stop:
                        inner = text[at : stop.start()]
                        if name == "code":
                            put({"type": "code", "text": inner})
                        elif name == "a":
                            put({"type": "link", "destination": rest["href"], "content": parse_inlines(inner, depth + 1)})
                        else:
                            put({"type": _WRAPS[name], "content": parse_inlines(inner, depth + 1)})
                        at = stop.end()
                    else:
                        put({"type": "html", "html": m.group()})
                elif name == "img" and rest.get("src"):
                    put({"type": "image", "alt": rest.get("alt") or "", "destination": rest["src"]})
                else:
                    put({"type": "html", "html": m.group()})
                continue
        if c in "*_~":
            run = re.match(re.escape(c) + "+", text[at:]).group()
            before, after = text[at - 1 : at] or " ", text[at + len(run) : at + len(run) + 1] or " "
            left = not after.isspace() and (after.isalnum() or before.isspace() or not before.isalnum())
            right = not before.isspace() and (before.isalnum() or after.isspace() or not after.isalnum())
            opens = left and (c != "_" or not right or not before.isalnum())
            closes = right and (c != "_" or not left or not after.isalnum())
            n = len(run)
            while n:
                mark = c * 2 if n >= 2 and (c != "~" or n == 2) else c
                if c == "~" and mark == "~":
                    put({"type": "text", "text": c * n})
                    break
                k = next((k for k in range(len(frames) - 1, 0, -1) if frames[k][0] == mark), 0) if closes else 0
                if not k and closes and mark == c * 2 and c != "~":
                    k = next((k for k in range(len(frames) - 1, 0, -1) if frames[k][0] == c), 0)
                    mark = c if k else mark
                if k and frames[k][2] or k and k < len(frames) - 1:
                    close(k)
                elif opens:
                    frames.append([mark, {"*": "emphasis", "**": "strong", "_": "emphasis", "__": "strong", "~~": "strikethrough"}[mark], []])
                else:
                    put({"type": "text", "text": mark})
                n -= len(mark)
            at += len(run)
            continue
        put({"type": "text", "text": c})
        at += 1
    while len(frames) > 1:
        mark, _, inner = frames.pop()
        put({"type": "text", "text": mark})
        for i in inner:
            put(i)
    return frames[0][2]


def plain(inlines: list[dict]) -> str:
    """Text of inlines: alternative texts for images, `[^label]` for references, a blank for breaks."""
    out = []
    for i in inlines:
        kind = i["type"]
        if kind in ("text", "code", "math"):
            out.append(i["text"])
        elif kind == "image":
            out.append(i.get("alt", ""))
        elif kind == "footnote_reference":
            out.append(f"[^{i['label']}]")
        elif kind in ("soft_break", "hard_break"):
            out.append(" ")
        elif "content" in i:
            out.append(plain(i["content"]))
    return "".join(out)


# ---- blocks


def row_cells(line: str) -> list[str]:
    """Cells of a table line, still escaped but for bars."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    cells, cell, k = [], "", 0
    while k < len(line):
        if line[k] == "\\" and k + 1 < len(line):
            cell += line[k + 1] if line[k + 1] == "|" else line[k : k + 2]
            k += 2
        elif line[k] == "|":
            cells.append(cell.strip())
            cell, k = "", k + 1
        else:
            cell, k = cell + line[k], k + 1
    if cell.strip() or not line.endswith("|"):
        cells.append(cell.strip())
    return cells


def _dedented(lines: list[str], width: int) -> list[str]:
    return [l[min(width, len(l) - len(l.lstrip(" "))) :] for l in lines]


def parse_blocks(lines: list[str], depth: int = 0) -> list[dict]:
    if depth > DEEPEST:
        raise MarkdownError(f"nesting exceeds {DEEPEST}")
    out: list[dict] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            body, k = [], at + 1
            while k < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}\s*$", lines[k]):
                body.append(lines[k])
                k += 1
            block = {"type": "code_block", "code": "\n".join(_dedented(body, len(m[1])))}
            if m[3]:
                block["info"] = m[3]
            out.append(block)
            at = k + 1
        elif line.strip().startswith("$$"):
            body, k = line.strip()[2:], at
            while not body.rstrip().endswith("$$") and k + 1 < len(lines):
                k += 1
                body += "\n" + lines[k]
            out.append({"type": "math", "text": body.rstrip().removesuffix("$$").strip("\n")})
            at = k + 1
        elif m := _HEADING.match(line):
            out.append({"type": "heading", "level": len(m[1]), "content": parse_inlines((m[2] or "").strip())})
            at += 1
        elif _RULE.match(line):
            out.append({"type": "horizontal_rule"})
            at += 1
        elif line.lstrip(" ").startswith(">") and len(line) - len(line.lstrip(" ")) < 4:
            body = []
            while at < len(lines) and lines[at].strip() and (lines[at].lstrip().startswith(">") or body and body[-1].strip() and not _starts(lines[at])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[at]))
                at += 1
            out.append({"type": "quote", "blocks": parse_blocks(body, depth + 1)})
        elif m := _NOTE.match(line):
            body, at = [m[2]], at + 1
            while at < len(lines) and (lines[at].startswith("    ") or not lines[at].strip() and any(l.strip() for l in lines[at:]) and next(l for l in lines[at:] if l.strip()).startswith("    ") or lines[at].strip() and body[-1].strip() and not _starts(lines[at])):
                body.append(lines[at][4:] if lines[at].startswith("    ") else lines[at])
                at += 1
            out.append({"type": "footnote_definition", "label": m[1], "blocks": parse_blocks(body, depth + 1)})
        elif _ITEM.match(line) and len(_ITEM.match(line)[1]) < 4:
            at = _parse_list(lines, at, out, depth)
        elif "|" in line and at + 1 < len(lines) and _SEPARATOR.match(lines[at + 1]) and "-" in lines[at + 1] and len(row_cells(line)) == len(row_cells(lines[at + 1])):
            marks = row_cells(lines[at + 1])
            sides = [("center" if c.endswith(":") else "left") if c.startswith(":") else "right" if c.endswith(":") else "none" for c in marks]
            rows, k = [row_cells(line)], at + 2
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                rows.append((row_cells(lines[k]) + [""] * len(marks))[: len(marks)])
                k += 1
            block = {"type": "table", "cells": [[parse_inlines(c) for c in r] for r in rows]}
            if any(s != "none" for s in sides):
                block["alignments"] = sides
            out.append(block)
            at = k
        elif line.startswith("    "):
            body = []
            while at < len(lines) and (lines[at].startswith("    ") or not lines[at].strip()):
                body.append(lines[at][4:])
                at += 1
            out.append({"type": "code_block", "code": "\n".join(body).rstrip("\n")})
        elif _HTML_BLOCK.match(line):
            body, comment = [], line.lstrip().startswith("<!--")
            while at < len(lines) and (comment or lines[at].strip()):
                body.append(lines[at])
                at += 1
                if comment and "-->" in body[-1]:
                    break
            out.append({"type": "html", "html": "\n".join(body)})
        else:
            body = [line.lstrip(" ")]
            at += 1
            level = 0
            while at < len(lines) and lines[at].strip() and not _starts(lines[at]):
                if m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[at]):
                    level = 1 if m[1][0] == "=" else 2
                    at += 1
                    break
                body.append(lines[at].lstrip(" "))
                at += 1
            content = parse_inlines("\n".join(body).rstrip(" "))
            out.append({"type": "heading", "level": level, "content": content} if level else {"type": "paragraph", "content": content})
    return out


def _starts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = _ITEM.match(line)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) and not re.match(r"^ {0,3}-+\s*$", line) or line.lstrip(" ").startswith(">") or line.strip().startswith("$$") or _NOTE.match(line) or item and len(item[1]) < 4 and item[4] and (not item[2][0].isdigit() or item[2] in ("1.", "1)")) or _HTML_BLOCK.match(line))


def _parse_list(lines: list[str], at: int, out: list[dict], depth: int) -> int:
    first = _ITEM.match(lines[at])
    kind, base = first[2][-1], len(first[1])
    ordered = kind in ".)"
    block: dict = {"type": "list", "ordered": ordered}
    if ordered:
        block["start"] = int(first[2][:-1])
    block["items"] = []
    while at < len(lines):
        m = _ITEM.match(lines[at])
        if not m or m[2][-1] != kind or len(m[1]) > base + 3 or _RULE.match(lines[at]):
            break
        width = len(m[1]) + len(m[2]) + min(len(m[3] or " "), 4)
        body, at = [m[4] or ""], at + 1
        while at < len(lines):
            line = lines[at]
            indent = len(line) - len(line.lstrip(" "))
            if not line.strip():
                following = next((l for l in lines[at:] if l.strip()), "")
                if len(following) - len(following.lstrip(" ")) < width:
                    break
                body.append("")
            elif indent >= width or indent >= base + 2 and _ITEM.match(line):
                body.append(line[min(indent, width) :])
            elif body[-1].strip() and not _starts(line) and not _ITEM.match(line):
                body.append(line.lstrip(" "))
            else:
                break
            at += 1
        item: dict = {"number": int(m[2][:-1])} if ordered else {}
        task = re.match(r"\[([ xX])\] +", body[0])
        if task:
            body[0] = body[0][task.end() :]
        item["blocks"] = parse_blocks(body, depth + 1)
        if task:
            marker = {"type": "task_list_marker", "checked": task[1] != " "}
            if item["blocks"] and item["blocks"][0]["type"] == "paragraph":
                item["blocks"][0]["content"].insert(0, marker)
            else:
                item["blocks"].insert(0, {"type": "paragraph", "content": [marker]})
        block["items"].append(item)
        following = next((k for k in range(at, len(lines)) if lines[k].strip()), len(lines))
        again = _ITEM.match(lines[following]) if following < len(lines) else None
        if again and again[2][-1] == kind and len(again[1]) <= base + 3 and not _RULE.match(lines[following]):
            at = following
    out.append(block)
    return at


def parse(text: str) -> list[dict]:
    """Blocks of a Markdown text."""
    return parse_blocks(text.replace("\r\n", "\n").expandtabs(4).split("\n"))


# ---- rendering


def _escaped(text: str) -> str:
    return re.sub(r"([\\*`\[\]~<_>])", r"\\\1", text)


def _fence(text: str, least: int) -> str:
    return "`" * (max([least, *map(len, re.findall("`+", text))]) + 1)


def _target(url: str) -> str:
    if any(c.isspace() or c in "<>" for c in url):
        return "<" + url.replace(">", "\\>") + ">"
    return url.replace("\\", "\\\\").replace(")", "\\)")


def _titled(i: dict) -> str:
    return "" if i.get("title") is None else ' "' + i["title"].replace("\\", "\\\\").replace('"', '\\"') + '"'


_AROUND = {"emphasis": ("*", "*"), "strong": ("**", "**"), "strikethrough": ("~~", "~~"), "underline": ("<u>", "</u>"), "superscript": ("$^{", "}$"), "subscript": ("$_{", "}$"), "footnote": ("^[", "]")}


def render_inline(i: dict) -> str:
    kind = i["type"]
    if kind == "text":
        return _escaped(i["text"])
    if kind in _AROUND:
        return render_inlines(i["content"]).join(_AROUND[kind])
    if kind == "code":
        t = i["text"]
        pad = " " if t and (t[0] == " " == t[-1] and t.strip(" ") or "`" in (t[0], t[-1])) else ""
        return pad.join([_fence(t, 0), t, _fence(t, 0)])
    if kind == "math":
        mark = "$$" if i.get("display") else "$"
        return mark + i["text"] + mark
    if kind == "link":
        return f"[{render_inlines(i['content'])}]({_target(i['destination'])}{_titled(i)})"
    if kind == "image":
        return f"![{_escaped(i.get('alt', ''))}]({_target(i.get('destination', ''))}{_titled(i)})"
    if kind == "bookmark":
        name = i["name"]
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            name = name.replace(a, b)
        return f'<a id="{name}"></a>'
    fixed = {"soft_break": " ", "hard_break": "  \n", "footnote_reference": f"[^{i.get('label')}]", "task_list_marker": "[x] " if i.get("checked") else "[ ] ", "html": i.get("html")}
    if kind not in fixed:
        raise MarkdownError(f"unknown inline {kind}")
    return fixed[kind]


def render_inlines(content: list[dict], text: str | None = None) -> str:
    return (text or "") + "".join(map(render_inline, content))


def _indented(text: str, first: str, rest: str) -> str:
    lines = text.split("\n") if text else []
    return "\n".join((first if not k else rest) + l if l or not k else "" for k, l in enumerate(lines)) if lines else first.rstrip()


def render_block(b: dict, indent: str = "") -> str:
    kind = b["type"]
    content = lambda: render_inlines(b.get("content", []), b.get("text"))
    if kind == "heading":
        return "#" * min(max(b["level"], 1), 6) + " " + content()
    if kind == "paragraph":
        return content()
    if kind == "list_item":
        return "    " * b.get("level", 0) + (f"{b.get('number') or 1}. " if b.get("ordered") else "- ") + content()
    if kind == "list":
        return _render_list(b, indent)
    if kind == "table":
        return render_table(b)
    if kind == "code_block":
        fence = _fence(b["code"], 2)
        return f"{fence}{b.get('info') or ''}\n{b['code']}\n{fence}"
    if kind == "math":
        return f"$$\n{b['text']}\n$$"
    if kind == "quote":
        body = "\n\n".join(map(render_block, b["blocks"])) if b.get("blocks") else b.get("text") or ""
        return "\n".join("> " + l if l else ">" for l in body.split("\n")) if body else ""
    if kind == "horizontal_rule":
        return "---"
    if kind == "image":
        return f"![{_escaped(b.get('alt', ''))}](data:image/{b['format']};base64,{b['data']})"
    if kind == "footnote_definition":
        head, blocks = f"[^{b['label']}]:", b.get("blocks", [])
        body = "\n\n".join(map(render_block, blocks))
        if not body:
            return head
        return _indented(body, head + " ", "    ") if blocks[0]["type"] == "paragraph" else head + "\n" + _indented(body, "    ", "    ")
    if kind == "html":
        return b["html"]
    raise MarkdownError(f"unknown block {kind}")


def _render_list(b: dict, indent: str) -> str:
    number, out, nested = b.get("start") or 1, [], indent + "    "
    for item in b["items"]:
        number = item.get("number", number)
        mark = indent + (f"{number}. " if b["ordered"] else "- ")
        number += 1
        parts, blocks = [], item["blocks"]
        if blocks and blocks[0]["type"] == "paragraph":
            parts.append(_indented(render_block(blocks[0]), mark, " " * len(mark)))
            blocks = blocks[1:]
        else:
            parts.append(mark.rstrip())
        for k, block in enumerate(blocks):
            child = render_block(block, nested) if block["type"] == "list" else _indented(render_block(block), nested, nested)
            tight = block["type"] == "list" or k == 0 and len(blocks) == len(item["blocks"])
            parts.append(("\n" if tight else "\n\n") + child)
        out.append("".join(parts))
    return "\n".join(out)


def render_table(b: dict) -> str:
    from .html import table_text

    if not b.get("cells"):
        return table_text(b["rows"]) if b.get("rows") else ""
    return table_text([[render_inlines(c) for c in r] for r in b["cells"]], [None if a == "none" else a for a in b.get("alignments", [])])


def check_depth(blocks: list[dict], depth: int = 0) -> None:
    if depth > DEEPEST:
        raise MarkdownError(f"nesting exceeds {DEEPEST}")
    for b in blocks:
        for inner in [b.get("blocks", []), b.get("content", []), *[i["blocks"] for i in b.get("items", [])], *[c for r in b.get("cells", []) for c in r]]:
            check_depth(inner, depth + 1)


def render(blocks: list[dict]) -> str:
    """Markdown of a tree: blocks parted by blank lines."""
    check_depth(blocks)
    body = "\n\n".join(filter(None, map(render_block, blocks)))
    return body + "\n" if body else ""


def tables_only(blocks: list[dict]) -> list[dict]:
    """Tables, and the lists, quotes and footnotes that hold them."""
    out = []
    for b in blocks:
        if b["type"] == "table":
            out.append(b)
        elif b["type"] == "list":
            items = [i | {"blocks": kept} for i in b["items"] if (kept := tables_only(i["blocks"]))]
            out += [b | {"items": items}] if items else []
        elif b["type"] in ("quote", "footnote_definition"):
            kept = tables_only(b.get("blocks", []))
            out += [b | {"blocks": kept}] if kept else []
    return out


def expand_footnotes(blocks: list[dict]) -> list[dict]:
    """Inline footnotes as numbered definitions at the end."""
    notes: list[dict] = []
    taken: set[str] = set()

    def labels(x: object) -> None:
        if isinstance(x, dict):
            if x.get("type") in ("footnote_definition", "footnote_reference"):
                taken.add(x["label"])
            for v in x.values():
                labels(v)
        elif isinstance(x, list):
            for v in x:
                labels(v)

    def walk(x: object) -> object:
        if isinstance(x, list):
            return [walk(v) for v in x]
        if not isinstance(x, dict):
            return x
        if x.get("type") == "footnote":
            n = len(notes) + 1
            while f"inline-{n}" in taken:
                n += 1
            taken.add(f"inline-{n}")
            notes.append({"type": "footnote_definition", "label": f"inline-{n}", "blocks": [{"type": "paragraph", "content": x["content"]}]})
            return {"type": "footnote_reference", "label": f"inline-{n}"}
        return {k: walk(v) for k, v in x.items()}

    labels(blocks)
    return [*walk(blocks), *notes]
