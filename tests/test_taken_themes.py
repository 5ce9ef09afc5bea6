"""Themes taken from parts of packages that are written here by hand."""

import json

import pytest

from docframe.functions import themes
from docframe.operators import parts as P
from docframe.operators import taken_themes as K

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
FONTS = f'<a:theme {A}><a:themeElements><a:fontScheme name="x"><a:majorFont><a:latin typeface="Major"/></a:majorFont><a:minorFont><a:latin typeface="Minor"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'


def parts(spark, packages):
    return spark.createDataFrame([(k, n, x.encode()) for k, files in packages.items() for n, x in files.items()], "k string, part string, bytes binary")


def taken(spark, kind, packages):
    """Sparse themes by package."""
    rows = K.TAKEN[kind](parts(spark, packages), ["k"]).selectExpr("k", "to_json(theme) AS theme").collect()
    assert len(rows) == len(packages)
    out = {r["k"]: {s: f for s, f in json.loads(r["theme"]).items() if f} for r in rows}
    for theme in out.values():
        themes.resolve(theme)
    return out


def style(id_, inner="", up="", more=""):
    based = f'<w:basedOn w:val="{up}"/>' if up else ""
    return f'<w:style w:type="paragraph" w:styleId="{id_}" {more}>{based}{inner}</w:style>'


def word(styles, section=""):
    return {"word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/document.xml": f"<w:document {W}><w:body><w:p/>{section}</w:body></w:document>"}


def test_word(spark):
    defaults = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi"/><w:sz w:val="20"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="200" w:line="276" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults>'
    normal = style("Normal", '<w:name w:val="normal"/><w:pPr><w:jc w:val="both"/><w:ind w:left="99"/></w:pPr><w:rPr><w:color w:val="112233"/></w:rPr>', more='w:default="1"')
    base = style("Base", '<w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="30"/></w:rPr>', "Normal")
    h1 = style("T1", '<w:name w:val="heading 1"/><w:pPr><w:spacing w:before="240"/></w:pPr><w:rPr><w:rFonts w:asciiTheme="majorHAnsi"/><w:color w:val="auto"/></w:rPr>', "Base")
    h2 = style("Heading2", '<w:rPr><w:sz w:val="26"/><w:color w:val="ABCDEF"/></w:rPr>', "Gone")
    page = '<w:sectPr><w:pgSz w:w="15840" w:h="12240"/><w:pgMar w:top="720" w:left="1440"/></w:sectPr>'
    narrow = '<w:sectPr><w:pgSz w:w="8391" w:h="11906"/><w:pgMar w:left="5000" w:right="5000" w:top="20"/></w:sectPr><w:sectPr><w:pgSz w:w="1" w:h="1"/></w:sectPr>'
    got = taken(spark, "docx", {
        "a": word(defaults + normal + base + h1 + h2, page) | {"word/theme/theme1.xml": FONTS},
        "b": word("", narrow),
        "c": {"word/document.xml": f"<w:document {W}/>"},
        "d": word(style("x", '<w:name w:val="Normal"/><w:rPr><w:sz w:val="20"/></w:rPr><w:pPr><w:spacing w:line="300" w:lineRule="exact" w:before="-5"/></w:pPr>') + style("x", '<w:name w:val="Normal"/><w:rPr><w:sz w:val="24"/><w:rFonts w:ascii=" " w:hAnsi="Y"/></w:rPr><w:pPr><w:spacing w:line="360" w:lineRule="exact"/></w:pPr>')),
    })
    a = got["a"]
    assert a["document"] == {"font_family": "Minor", "font_size_pt": 10.0, "text_color": "#112233", "paragraph_spacing_after_pt": 10.0, "line_height": 1.15, "text_align": "justify", "first_line_indent_pt": 0.0}
    assert a["headings"]["font_family"] == "Major" and a["headings"]["color"] == "#112233" and a["headings"]["bold"] is True and a["headings"]["italic"] is False
    assert a["headings"]["sizes_pt"] == [15.0, 13.0, 12.0, 11.0, 10.0, 9.0] and a["headings"]["level_colors"] == ["#112233", "#ABCDEF"] + ["#1F4E79"] * 4
    assert a["headings"]["spacing_before_pt"] == 12.0 and a["page"] == {"size": "Letter", "orientation": "landscape", "margin_top_pt": 36.0, "margin_left_pt": 72.0}
    assert got["b"] == {"page": {"size": "A5", "orientation": "portrait"}} and got["c"] == {}
    assert got["d"]["document"] == {"font_size_pt": 12.0, "line_height": 1.5}


def test_word_styles_on_a_ring(spark):
    ring = style("a", up="b") + style("b", up="a")
    assert taken(spark, "docx", {"k": word(ring)})["k"] == {}
    with pytest.raises(Exception, match="styles based on themselves: Normal"):
        taken(spark, "docx", {"k": word(ring + style("Normal", up="a"))})


def book(rows, formats=6):
    fonts = "".join(f'<font><name val="F{k}"/><sz val="{10 + k}"/><color rgb="FF00000{k}"/></font>' for k in range(formats))
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF0000A{k}"/></patternFill></fill>' for k in range(formats))
    xfs = "".join(f'<xf fontId="{k}" fillId="{k}" borderId="{int(k == 1)}"><alignment horizontal="right"/></xf>' for k in range(formats))
    borders = '<border/><border><left style="thick"><color rgb="FF0000FF"/></left></border>'
    sheet = "".join(f'<row r="{n}"' + (f' s="{own}"' if own is not None else "") + ">" + "".join("<c/>" if s is None else f'<c s="{s}"><v>1</v></c>' for s in cells) + "</row>" for n, (own, cells) in enumerate(rows, 1))
    return {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="A" sheetId="1" r:id="rId2"/><sheet name="B" sheetId="2" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="rId1" Type="{KIND}/worksheet" Target="worksheets/b.xml"/><Relationship Id="rId2" Type="{KIND}/worksheet" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/worksheets/a.xml": f"<worksheet {S}><sheetData>{sheet}</sheetData></worksheet>",
        "xl/worksheets/b.xml": f'<worksheet {S}><sheetData><row><c s="5"/></row></sheetData></worksheet>',
        "xl/styles.xml": f"<styleSheet {S}><fonts>{fonts}</fonts><fills>{fills}</fills><borders>{borders}</borders><cellXfs>{xfs}</cellXfs></styleSheet>",
    }


def test_workbook(spark):
    rows = [(None, [1, 1, 2]), (None, []), (3, [None, None]), (None, [2, 3]), (None, [2, 2, 2]), (None, [4, 4]), (None, [3, 3]), (None, [5] * 90)]
    bare = book(rows)
    del bare["xl/styles.xml"]
    got = taken(spark, "xlsx", {"a": book(rows), "one": book([(None, [2])]), "none": book([]), "bare": bare})
    # below the first row: style 3 five times, style 2 four times; the row of style 5 is the seventh
    assert got["a"]["document"] == {"font_family": "F3", "font_size_pt": 13.0, "text_color": "#000003", "text_align": "right"}
    assert got["a"]["table"] == {"font_size_pt": 13.0, "header_background": "#0000A1", "header_color": "#000001", "border_color": "#0000FF", "border_width_pt": 1.5, "stripe_background": "#0000A2"}
    assert got["one"]["table"] == {"font_size_pt": 10.0, "header_background": "#0000A2", "header_color": "#000002"}
    assert got["none"]["document"]["font_family"] == "F0" and got["bare"] == {}
    with pytest.raises(Exception, match="missing cell format"):
        taken(spark, "xlsx", {"a": book(rows, 2)})


def sheet(rows, styles=""):
    spaces = " ".join(f'xmlns:{p}="urn:{p}"' for p in ("office", "style", "table", "text", "fo"))
    cell = lambda s, n: f'<table:table-cell table:style-name="{s}" table:number-columns-repeated="{n}"/>' if s else "<table:covered-table-cell/>"
    body = "".join("<table:table-row>" + "".join(cell(*c) for c in row) + "</table:table-row>" for row in rows)
    look = lambda name, up, inner: f'<style:style style:name="{name}" style:family="table-cell"' + (f' style:parent-style-name="{up}"' if up else "") + f">{inner}</style:style>"
    own = look("a", "base", '<style:table-cell-properties fo:background-color="#0000a1" fo:border-left="0.75pt solid #00ff00"/>') + look("b", "base", '<style:table-cell-properties fo:background-color="#0000a2"/>') + look("c", "gone", '<style:paragraph-properties fo:text-align="end"/>')
    default = '<style:default-style style:family="table-cell"><style:text-properties style:font-name="D" fo:font-size="10pt"/></style:default-style>'
    common = default + look("base", "", '<style:text-properties fo:font-size="12pt" fo:color="#111111"/>') + look("b", "", '<style:text-properties fo:color="#222222"/>') + '<style:style style:name="a" style:family="paragraph"><style:text-properties fo:color="#999999"/></style:style>'
    return {
        "content.xml": f"<office:document-content {spaces}><office:automatic-styles>{own}{styles}</office:automatic-styles><office:body><table:table>{body}</table:table></office:body></office:document-content>",
        "styles.xml": f"<office:document-styles {spaces}><office:styles>{common}</office:styles></office:document-styles>",
    }


def test_open_spreadsheet(spark):
    ring = '<style:style style:name="r" style:family="table-cell" style:parent-style-name="r"/>'
    rows = [[("a", 3), ("b", 1)], [], [("c", 5), ("b", 1)], [("b", 2), (None, 1)], [("b", 2), ("c", 9)]]
    got = taken(spark, "ods", {"a": sheet(rows), "one": sheet([[("b", 1)]]), "none": sheet([], ring)})
    assert got["a"]["document"] == {"font_family": "D", "font_size_pt": 10.0, "text_align": "right"}
    assert got["a"]["table"] == {"font_size_pt": 10.0, "header_background": "#0000A1", "header_color": "#111111", "border_color": "#00FF00", "border_width_pt": 0.75, "stripe_background": "#0000A2"}
    assert got["one"]["table"] == {"font_size_pt": 10.0, "header_background": "#0000A2", "header_color": "#222222"} and got["none"]["document"] == {"font_family": "D", "font_size_pt": 10.0}
    with pytest.raises(Exception, match="styles based on themselves: r"):
        taken(spark, "ods", {"a": sheet([[("r", 1)]], ring)})


def test_slides(spark):
    colors = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in {"dk1": "010101", "lt1": "fefefe", "accent1": "a10000", "accent3": "a30000", "hlink": "0000ff"}.items())
    theme = FONTS.replace("<a:themeElements>", f"<a:themeElements><a:clrScheme>{colors}</a:clrScheme>")
    main = {"ppt/presentation.xml": "<p/>"}
    got = taken(spark, "pptx", {"a": main | {"ppt/theme/theme1.xml": theme, "ppt/theme/theme2.xml": FONTS}, "b": main})
    assert got["a"]["document"] == {"font_family": "Minor", "text_color": "#010101"} and got["a"]["headings"]["font_family"] == "Major"
    assert got["a"]["headings"]["level_colors"] == ["#A10000", "#A10000", "#A30000", "#A10000", "#A10000", "#A10000"]
    assert got["a"]["links"] == {"color": "#0000FF"} and got["a"]["table"] == {"header_background": "#A10000", "header_color": "#FEFEFE"} and got["b"] == {}


def test_alike_workbooks(spark):
    """Workbooks whose parts but for the sheets are the same share what these say; one that differs has its own."""
    one, two, other = book([(None, [1]), (None, [0])]), book([(None, [1]), (None, [3])]), book([(None, [1]), (None, [0])])
    other["xl/styles.xml"] = other["xl/styles.xml"].replace('"F0"', '"G0"')
    packages = {"a": one, "b": two, "c": other}
    groups, common = P.alike(parts(spark, packages).where("part not like '%/worksheets/%'"), ["k"])
    of = {r["k"]: r["group"] for r in groups.collect()}
    assert of["a"] == of["b"] != of["c"]
    assert common.count() == 6 and common.where(f"group = '{of['a']}'").count() == 3
    got = taken(spark, "xlsx", packages)
    assert [got[k]["document"]["font_family"] for k in "abc"] == ["F0", "F3", "G0"]
