import pytest

from docframe.operators import formulas as L
from docframe.operators import markdown as M
from docframe.plans import convert as V
from docframe.sources import packages, wordprocessing


@pytest.mark.parametrize("text,latex", [
    ("\u221a(x+1) \u2264 2", "\\sqrt{x+1} \\le 2"), ("\u221a2", "\\sqrt2"), ("\u221a((a)(b))", "\\sqrt{(a)(b)}"), ("(a+b) / (2)", "\\frac{a+b}{2}"), ("(a+b)/((2))", "(a+b)/((2))"),
    ("(a)+(b)", "(a)+(b)"), ("1 \u00d7 2 \u2192 3", "1 \\times 2 \\rightarrow 3"), ("$x$ 1", "x 1"),
])
def test_latex_of_text(text, latex):
    assert L.latex_of_text(text) == latex


def test_formulas_below_their_heading():
    given = "# Formulas\n\nRoot: \u221a(9) = 3\n\nName: Ada\n\nMatrix:  \n\\[1 2\\]  \n\\[3 4\\]\n\n# Other\n\nRoot: \u221a(9) = 3\n"
    want = "# Formulas\n\nRoot: $\\sqrt{9} = 3$\n\nName: Ada\n\nMatrix:  \n$$\\begin{matrix} 1 & 2 \\\\ 3 & 4 \\end{matrix}$$\n\n# Other\n\nRoot: \u221a(9) = 3\n"
    assert M.render(L.with_formulas(M.parse(given))) == want
    assert V.convert_bytes(V.convert_bytes(given.encode(), "markdown", "docx"), "docx", "markdown").decode() == want


@pytest.mark.parametrize("properties,labels", [("", ["i", "ii"]), ('<w:numFmt w:val="decimal"/><w:numStart w:val="4"/>', ["4", "5"]), ('<w:numFmt w:val="upperRoman"/><w:numStart w:val="9"/>', ["IX", "X"])])
def test_endnotes_are_numbered_as_they_are_used(properties, labels):
    ns = f'xmlns:w="{packages._W}"'
    use = lambda k: f'<w:p><w:r><w:t>x</w:t></w:r><w:r><w:endnoteReference w:id="{k}"/></w:r></w:p>'
    note = lambda k: f'<w:endnote w:id="{k}"><w:p><w:r><w:t>note {k}</w:t></w:r></w:p></w:endnote>'
    files = {
        "word/document.xml": f"<w:document {ns}><w:body>{use(7)}{use(3)}{use(7)}</w:body></w:document>",
        "word/endnotes.xml": f"<w:endnotes {ns}>{note(3)}{note(7)}</w:endnotes>",
        "word/settings.xml": f"<w:settings {ns}><w:endnotePr>{properties}</w:endnotePr></w:settings>",
    }
    text = M.render(wordprocessing.read(packages.package(files)))
    a, b = labels
    assert text == f"x[^endnote-{a}]\n\nx[^endnote-{b}]\n\nx[^endnote-{a}]\n\n[^endnote-{a}]: note 7\n\n[^endnote-{b}]: note 3\n"
