"""Word-processing parts written by hand, as other programs write them."""

from docframe.operators import markdown as M
from docframe.sources import packages, wordprocessing

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def read(body, **parts):
    files = {"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>"}
    files |= {f"word/{k}.xml": f"<w:{k} {NS}>{v}</w:{k}>" for k, v in parts.items()}
    return M.render(wordprocessing.read(packages.package(files)))


def p(text, props="", run=""):
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r>{f"<w:rPr>{run}</w:rPr>" if run else ""}<w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def test_adjacent_runs_of_one_look_are_one():
    assert read('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b w:val="1"/></w:rPr><w:t xml:space="preserve">ld </w:t></w:r><w:r><w:rPr><w:b w:val="false"/></w:rPr><w:t>plain</w:t></w:r></w:p>') == "**bold** plain\n"


def test_lists_by_numbering():
    number = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="2"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num>'
    assert read(p("a", number(5)) + p("b", number(5)) + p("x", number(6)) + p("y", number(6)), numbering=numbering) == "- a\n- b\n\n3. x\n4. y\n"


def test_merged_cells_become_html():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    body = f'<w:tbl><w:tr>{cell("top", chr(60) + "w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell("side", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}</w:tr><w:tr>{cell("a")}{cell("b")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    assert read(body) == '<table>\n  <tr>\n    <td colspan="2">top</td>\n    <td rowspan="2">side</td>\n  </tr>\n  <tr>\n    <td>a</td>\n    <td>b</td>\n  </tr>\n</table>\n'


def test_notes_that_nothing_refers_to_are_left_out():
    notes = f'<w:footnote w:id="-1">{p("separator")}</w:footnote><w:footnote w:id="2">{p("used")}</w:footnote><w:footnote w:id="3">{p("unused")}</w:footnote>'
    assert read('<w:p><w:r><w:t>x</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>', footnotes=notes) == "x[^2]\n\n[^2]: used\n"


def test_notes_written_by_hand():
    assert read(p("See [1] and [x].") + p("[1] The note.") + p("[7] Nobody asks.")) == "See [^1] and \\[x\\].\n\n[^1]: The note.\n"


def test_equations_and_links():
    body = '<w:p xmlns:m="urn:m"><w:r><w:t xml:space="preserve">so </w:t></w:r><m:oMath><m:f><m:num><m:t>1</m:t></m:num><m:den><m:t>2</m:t></m:den></m:f></m:oMath><w:hyperlink w:anchor="spot"><w:r><w:t>there</w:t></w:r></w:hyperlink></w:p>'
    assert read(body) == "so $\\frac{1}{2}$[there](#spot)\n"
