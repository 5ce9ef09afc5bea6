"""Style themes: a sparse TOML file over defaults, checked field by field; written back as TOML and as CSS."""

from __future__ import annotations

import math
import re
import tomllib

from .text import PAGE_SIZES


class ThemeError(ValueError):
    """A theme that breaks a field's rule, or has an unknown field."""


#: Sections and fields with their rule and default.
FIELDS: dict[str, dict[str, tuple[str, object]]] = {
    "document": {"font_family": ("text", "Calibri"), "font_size_pt": ("positive", 11.0), "text_color": ("color", "#000000"), "paragraph_spacing_before_pt": ("size", 0.0), "paragraph_spacing_after_pt": ("size", 8.0), "line_height": ("positive", 1.2), "text_align": ("left center right justify", "left"), "first_line_indent_pt": ("size", 0.0)},
    "headings": {"font_family": ("text", "Calibri"), "color": ("color", "#1F4E79"), "level_colors": ("colors", None), "sizes_pt": ("sizes", [16.0, 14.0, 12.0, 11.0, 10.0, 9.0]), "spacing_before_pt": ("size", 10.0), "spacing_after_pt": ("size", 6.0), "bold": ("flag", True), "italic": ("flag", False)},
    "page": {"size": ("A3 A4 A5 Letter Legal", "A4"), "orientation": ("portrait landscape", "portrait"), "margin_top_pt": ("size", 42.0), "margin_right_pt": ("size", 42.0), "margin_bottom_pt": ("size", 42.0), "margin_left_pt": ("size", 42.0), "header_text": ("line", ""), "footer_text": ("line", ""), "header_footer_font_size_pt": ("positive", 9.0)},
    "links": {"color": ("color", "#0563C1"), "underline": ("flag", True)},
    "blockquote": {"text_color": ("color", "#404040"), "background": ("color or none", None), "border_color": ("color", "#B3B3B3"), "border_width_pt": ("size", 1.5), "indent_pt": ("size", 14.0), "italic": ("flag", False)},
    "lists": {"indent_pt": ("size", 18.0), "bullet": ("bullet", "•")},
    "code": {"font_family": ("text", "Consolas"), "font_size_pt": ("positive", 9.5), "text_color": ("color", "#333333"), "background": ("color", "#F6F8FA"), "inline_background": ("color or none", "#F6F8FA"), "padding_pt": ("size", 7.0)},
    "table": {"font_size_pt": ("positive", 9.5), "header_background": ("color", "#EBF0F6"), "header_color": ("color", "#000000"), "border_color": ("color", "#B4BCC6"), "border_width_pt": ("size", 0.5), "cell_padding_pt": ("size", 4.0), "stripe_background": ("color or none", None)},
    "horizontal_rule": {"color": ("color", "#B4BCC6"), "width_pt": ("size", 0.7)},
    "footnotes": {"font_size_pt": ("positive", 9.0)},
    "images": {"max_width_percent": ("percent", 100.0)},
}
#: Text must keep more than this between the margins.
LEAST_TEXT_PT = 72.0
Theme = dict[str, dict[str, object]]


def default() -> Theme:
    return resolve({})


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def _color(v: object) -> bool:
    return isinstance(v, str) and bool(re.fullmatch(r"\s*#[0-9A-Fa-f]{6}\s*", v))


def _checked(where: str, rule: str, v: object) -> object:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ThemeError(f"{where} {what}")

    if rule == "text":
        need(isinstance(v, str) and bool(v.strip()), "must not be empty")
    elif rule == "line":
        need(isinstance(v, str) and not re.search(r"[\x00-\x1f\x7f-\x9f]", v), "must be a single line of text")
    elif rule == "positive":
        need(_number(v) and v > 0, "must be positive")
    elif rule == "size":
        need(_number(v) and v >= 0, "must not be negative")
    elif rule == "percent":
        need(_number(v) and 1 <= v <= 100, "must be between 1 and 100")
    elif rule == "flag":
        need(isinstance(v, bool), "must be true or false")
    elif rule == "color or none":
        if isinstance(v, str) and v.strip().lower() == "none":
            return None
        need(_color(v), 'must use #RRGGBB or "none"')
    elif rule == "color":
        need(_color(v), "must use #RRGGBB")
    elif rule == "colors":
        need(isinstance(v, list) and len(v) == 6 and all(map(_color, v)), "must be six colours")
        return [c.strip().upper() for c in v]
    elif rule == "sizes":
        need(isinstance(v, list) and len(v) == 6 and all(_number(x) and x > 0 for x in v), "must be six positive numbers")
    elif rule == "bullet":
        need(isinstance(v, str) and 1 <= len(v.strip()) <= 4 and v.strip().isprintable(), "must be one to four printable characters")
    else:
        named = {n.lower(): n for n in rule.split()}
        need(isinstance(v, str) and v.strip().lower() in named, f"must be one of {rule}")
        return named[v.strip().lower()]
    return v.strip().upper() if rule.startswith("color") else v


def resolve(file: dict) -> Theme:
    """All fields: those of file where it has them, defaults elsewhere."""
    for section, fields in file.items():
        if section not in FIELDS or not isinstance(fields, dict):
            raise ThemeError(f"unknown section {section}")
        for key in fields:
            if key not in FIELDS[section]:
                raise ThemeError(f"unknown field {section}.{key}")
    theme = {s: {k: _checked(f"{s}.{k}", rule, file[s][k]) if k in file.get(s, {}) else standard for k, (rule, standard) in fields.items()} for s, fields in FIELDS.items()}
    if theme["headings"]["level_colors"] is None:
        theme["headings"]["level_colors"] = [theme["headings"]["color"]] * 6
    width, height = page_points(theme)
    page = theme["page"]
    if width - page["margin_left_pt"] - page["margin_right_pt"] <= LEAST_TEXT_PT or height - page["margin_top_pt"] - page["margin_bottom_pt"] <= LEAST_TEXT_PT:
        raise ThemeError("page margins leave no room for text")
    return theme


def load(text: str) -> Theme:
    try:
        return resolve(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ThemeError(str(e)) from None


def page_points(theme: Theme) -> tuple[float, float]:
    """Width and height of the page in points."""
    short, long_ = next((a, b) for n, a, b in PAGE_SIZES if n == theme["page"]["size"])
    return (short, long_) if theme["page"]["orientation"] == "portrait" else (long_, short)


def heading(theme: Theme, level: int) -> tuple[str, float]:
    """Colour and size of a heading level, from 1 to 6."""
    k = min(max(level, 1), 6) - 1
    return theme["headings"]["level_colors"][k], theme["headings"]["sizes_pt"][k]


def dump(theme: Theme) -> str:
    """A theme as TOML that load() reads back."""
    from ..sources.structured import dump as write

    return write({s: {k: "none" if v is None else v for k, v in fields.items()} for s, fields in theme.items()}, "toml")


def css(theme: Theme) -> str:
    """A theme as a style sheet for HTML pages."""
    d, h, p, q, c, t = (theme[s] for s in ("document", "headings", "page", "blockquote", "code", "table"))
    quoted = lambda x: '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rules = [
        ("body", f"font-family: {quoted(d['font_family'])}; font-size: {d['font_size_pt']}pt; color: {d['text_color']}; line-height: {d['line_height']}; margin: {p['margin_top_pt']}pt {p['margin_right_pt']}pt {p['margin_bottom_pt']}pt {p['margin_left_pt']}pt"),
        ("p", f"margin: {d['paragraph_spacing_before_pt']}pt 0 {d['paragraph_spacing_after_pt']}pt; text-align: {d['text_align']}; text-indent: {d['first_line_indent_pt']}pt"),
        *[(f"h{k}", f"font-family: {quoted(h['font_family'])}; color: {heading(theme, k)[0]}; font-size: {heading(theme, k)[1]}pt; margin: {h['spacing_before_pt']}pt 0 {h['spacing_after_pt']}pt; font-weight: {'bold' if h['bold'] else 'normal'}; font-style: {'italic' if h['italic'] else 'normal'}") for k in range(1, 7)],
        ("a", f"color: {theme['links']['color']}; text-decoration: {'underline' if theme['links']['underline'] else 'none'}"),
        ("blockquote", f"color: {q['text_color']}; border-left: {q['border_width_pt']}pt solid {q['border_color']}; padding-left: {q['indent_pt']}pt; font-style: {'italic' if q['italic'] else 'normal'}" + (f"; background: {q['background']}" if q["background"] else "")),
        ("ul, ol", f"padding-left: {theme['lists']['indent_pt']}pt"),
        ("ul", f"list-style-type: {quoted(theme['lists']['bullet'] + ' ')}"),
        ("pre", f"background: {c['background']}; padding: {c['padding_pt']}pt"),
        ("code", f"font-family: {quoted(c['font_family'])}; font-size: {c['font_size_pt']}pt; color: {c['text_color']}" + (f"; background: {c['inline_background']}" if c["inline_background"] else "")),
        ("table", f"border-collapse: collapse; font-size: {t['font_size_pt']}pt"),
        ("th, td", f"border: {t['border_width_pt']}pt solid {t['border_color']}; padding: {t['cell_padding_pt']}pt"),
        ("th", f"background: {t['header_background']}; color: {t['header_color']}"),
        *([("tbody tr:nth-child(even)", f"background: {t['stripe_background']}")] if t["stripe_background"] else []),
        ("hr", f"border: 0; border-top: {theme['horizontal_rule']['width_pt']}pt solid {theme['horizontal_rule']['color']}"),
        (".footnote-definition", f"font-size: {theme['footnotes']['font_size_pt']}pt"),
        ("img", f"max-width: {theme['images']['max_width_percent']}%"),
        ("@page", f"size: {page_points(theme)[0]}pt {page_points(theme)[1]}pt"),
    ]
    return "".join(f"{selector} {{ {body}; }}\n" for selector, body in rules)
