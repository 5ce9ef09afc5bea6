import json
from xml.etree import ElementTree as ET

import pytest

from docframe.__main__ import main
from docframe.functions import themes
from docframe.operators.equations import latex


def test_defaults_come_back():
    assert themes.load(themes.dump(themes.default())) == themes.default()


def test_overlay():
    t = themes.load('[headings]\ncolor = "#ff0000"\n[page]\nsize = "letter"\norientation = "landscape"\n[table]\nstripe_background = "none"\n')
    assert themes.heading(t, 9) == ("#FF0000", 9.0) and themes.page_points(t) == (792.0, 612.0) and t["document"]["font_family"] == "Calibri"
    assert "h1 { font-family: \"Calibri\"; color: #FF0000" in themes.css(t)


@pytest.mark.parametrize("text", ['[document]\nfont_size_pt = 0', '[document]\ntext_color = "red"', "[document]\nunknown = 1", "[nothing]\nx = 1", "[page]\nmargin_left_pt = 500", '[lists]\nbullet = "12345"', "[images]\nmax_width_percent = 101", "[headings]\nsizes_pt = [1, 2]", '[page]\nheader_text = "a\\nb"', '[document]\ntext_align = "middle"'])
def test_rules(text):
    with pytest.raises(themes.ThemeError):
        themes.load(text)


@pytest.mark.parametrize(
    "xml,expected",
    [
        ("<f><num><r><t>a</t></r></num><den><r><t>b</t></r></den></f>", "\\frac{a}{b}"),
        ("<rad><radPr/><deg/><e><t>x</t></e></rad>", "\\sqrt{x}"),
        ("<nary><naryPr><chr val='∑'/></naryPr><sub><t>i</t></sub><sup/><e><t>x≤1</t></e></nary>", "\\sum_{i}x\\le1"),
        ("<d><dPr><begChr val='['/></dPr><e><t>x</t></e></d>", "\\left[x\\right)"),
        ("<m><mr><e><t>1</t></e><e><t>2</t></e></mr><mr><e><t>3</t></e><e><t>4</t></e></mr></m>", "\\begin{matrix}1 & 2 \\\\ 3 & 4\\end{matrix}"),
        ("<sSubSup><e><t>x</t></e><sub><t>i</t></sub><sup><t>2</t></sup></sSubSup>", "x_{i}^{2}"),
    ],
)
def test_equations(xml, expected):
    assert latex(ET.fromstring(xml)) == expected


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}]))
    assert main(["convert", f"{tmp_path}/a.json", f"{tmp_path}/a.md"]) == 0
    assert (tmp_path / "a.md").read_text() == "# Sheet1\n\n| x |\n| --- |\n| 1 |"
    assert main(["convert", f"{tmp_path}/a.json", f"{tmp_path}/a.md"]) == 1 and "exists" in capsys.readouterr().err
    assert main(["style-template", f"{tmp_path}/t.toml"]) == 0 and main(["convert", f"{tmp_path}/a.md", f"{tmp_path}/a.html", "--style", f"{tmp_path}/t.toml"]) == 0
    assert "font-family" in (tmp_path / "a.html").read_text()
