"""Office math elements as LaTeX."""

from __future__ import annotations

from xml.etree import ElementTree as ET

#: Symbols and their commands.
SYMBOLS = {"±": "\\pm", "≤": "\\le", "≥": "\\ge", "≠": "\\neq", "≈": "\\approx", "∞": "\\infty", "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "×": "\\times", "÷": "\\div", "⇒": "\\Rightarrow", "⇔": "\\Leftrightarrow", "→": "\\rightarrow", "←": "\\leftarrow", "↔": "\\leftrightarrow"}
#: Shapes of elements by the names of their parts.
SHAPES = {
    "sSup": "{e}^{{{sup}}}", "sSub": "{e}_{{{sub}}}", "sSubSup": "{e}_{{{sub}}}^{{{sup}}}", "sPre": "_{{{sub}}}^{{{sup}}}{e}", "limLow": "{e}_{{{lim}}}", "limUpp": "{e}^{{{lim}}}",
    "f": "\\frac{{{num}}}{{{den}}}", "acc": "\\hat{{{e}}}", "bar": "\\overline{{{e}}}",
}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


class _Parts(dict):
    """LaTeX of an element's parts by name; the first of a name counts, a missing one is empty."""

    def __init__(self, e: ET.Element) -> None:
        super().__init__()
        for c in e:
            self.setdefault(_name(c), latex(c))

    def __missing__(self, _: str) -> str:
        return ""


def _property(e: ET.Element, name: str, standard: str) -> str:
    for p in (c for c in e if _name(c).endswith("Pr")):
        for x in p.iter():
            if _name(x) == name:
                return next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == "val"), standard)
    return standard


def latex(e: ET.Element) -> str:
    """LaTeX of a math element and all in it."""
    kind = _name(e)
    if kind == "t":
        return "".join(SYMBOLS.get(c, c) for c in e.text or "")
    if kind.endswith("Pr"):
        return ""
    if kind in SHAPES:
        return SHAPES[kind].format_map(_Parts(e))
    parts = _Parts(e)
    if kind == "rad":
        return f"\\sqrt[{parts['deg']}]{{{parts['e']}}}" if parts["deg"] else f"\\sqrt{{{parts['e']}}}"
    if kind == "d":
        return f"\\left{_property(e, 'begChr', '(')}{parts['e']}\\right{_property(e, 'endChr', ')')}"
    if kind == "nary":
        sign = _property(e, "chr", "∫")
        sign = SYMBOLS[sign] if sign in "∑∏∫" else sign
        return sign + (f"_{{{parts['sub']}}}" if parts["sub"] else "") + (f"^{{{parts['sup']}}}" if parts["sup"] else "") + parts["e"]
    if kind == "m":
        rows = [" & ".join(latex(c) for c in r if _name(c) == "e") for r in e if _name(r) == "mr"]
        return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"
    return "".join(map(latex, e))
