"""Document trees as HTML pages."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from . import markdown as M

_TAG = {"emphasis": "em", "strong": "strong", "strikethrough": "del", "underline": "u", "superscript": "sup", "subscript": "sub"}


def inline(i: dict) -> str:
    kind = i["type"]
    if kind == "text":
        return escape(i["text"])
    if kind in _TAG:
        return f"<{_TAG[kind]}>{inlines(i['content'])}</{_TAG[kind]}>"
    if kind == "code":
        return f"<code>{escape(i['text'])}</code>"
    if kind == "math":
        return f'<span class="math math-{"display" if i.get("display") else "inline"}">{escape(i["text"])}</span>'
    title = f" title={quoteattr(i['title'])}" if i.get("title") is not None else ""
    if kind == "link":
        return f"<a href={quoteattr(i['destination'])}{title}>{inlines(i['content'])}</a>"
    if kind == "image":
        return f"<img src={quoteattr(i.get('destination', ''))} alt={quoteattr(i.get('alt', ''))}{title} />"
    if kind == "footnote_reference":
        return f'<sup class="footnote-reference"><a href={quoteattr("#" + i["label"])}>{escape(i["label"])}</a></sup>'
    if kind == "bookmark":
        return f"<a id={quoteattr(i['name'])}></a>"
    if kind == "task_list_marker":
        return f'<input disabled="" type="checkbox"{" checked=" + chr(34) + chr(34) if i["checked"] else ""}/>\n'
    return {"soft_break": "\n", "hard_break": "<br />\n", "html": i.get("html", "")}.get(kind, "")


def inlines(items: list[dict]) -> str:
    return "".join(map(inline, items))


def block(b: dict) -> str:
    kind = b["type"]
    content = lambda: escape(b.get("text") or "") + inlines(b.get("content", []))
    if kind == "heading":
        return f"<h{b['level']}>{content()}</h{b['level']}>"
    if kind == "paragraph":
        return f"<p>{content()}</p>"
    if kind == "list":
        tag = "ol" if b["ordered"] else "ul"
        start = f' start="{b["start"]}"' if b["ordered"] and b.get("start", 1) != 1 else ""
        item = lambda i: "<li>" + "\n".join(inlines(x["content"]) if x["type"] == "paragraph" and len([p for p in i["blocks"] if p["type"] == "paragraph"]) < 2 else block(x) for x in i["blocks"]) + "</li>"
        return f"<{tag}{start}>\n" + "\n".join(map(item, b["items"])) + f"\n</{tag}>"
    if kind == "table":
        rows = b.get("cells") or [[[{"type": "text", "text": c}] for c in r] for r in b.get("rows", [])]
        sides = b.get("alignments", [])
        cell = lambda tag, k, c: f"<{tag}{f' style={chr(34)}text-align: {sides[k]}{chr(34)}' if k < len(sides) and sides[k] != 'none' else ''}>{inlines(c)}</{tag}>"
        line = lambda tag, r: "<tr>" + "".join(cell(tag, k, c) for k, c in enumerate(r)) + "</tr>"
        return f"<table><thead>{line('th', rows[0])}</thead><tbody>\n" + "\n".join(line("td", r) for r in rows[1:]) + "\n</tbody></table>"
    if kind == "code_block":
        info = f" class={quoteattr('language-' + b['info'].split()[0])}" if b.get("info") else ""
        return f"<pre><code{info}>{escape(b['code'])}\n</code></pre>"
    if kind == "math":
        return f'<p><span class="math math-display">{escape(b["text"])}</span></p>'
    if kind == "quote":
        return "<blockquote>\n" + ("\n".join(map(block, b["blocks"])) if b.get("blocks") else f"<p>{escape(b.get('text') or '')}</p>") + "\n</blockquote>"
    if kind == "horizontal_rule":
        return "<hr />"
    if kind == "footnote_definition":
        return f'<div class="footnote-definition" id={quoteattr(b["label"])}><sup class="footnote-definition-label">{escape(b["label"])}</sup>\n' + "\n".join(map(block, b["blocks"])) + "\n</div>"
    if kind == "html":
        return b["html"]
    return f"<p>{escape(M.render_block(b))}</p>"


def page(blocks: list[dict], css: str = "") -> str:
    """A page whose title is the first heading of level 1, or `Document`."""
    title = next((M.plain(b.get("content", [])) or b.get("text") or "" for b in blocks if b["type"] == "heading" and b["level"] == 1), "Document")
    style = f"<style>\n{css}</style>\n" if css else ""
    body = "\n".join(block(b) for b in M.expand_footnotes(blocks))
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n{style}</head>\n<body>\n{body}\n</body>\n</html>\n'
