"""Zipped office packages: spreadsheets, text documents and slides, read into sheets, trees and slides and written from them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Mapping
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from ..operators import markdown as M
from .images import MIME, Parts, data_uri, extension, size
from .structured import Cell, DataError, Sheets, cell_text, number

MAX_ROWS, MAX_COLUMNS = (1 << 32) - 1, (1 << 16) - 1
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
ODF_TYPE = {k: f"application/vnd.oasis.opendocument.{v}" for k, v in {"odt": "text", "ods": "spreadsheet", "odp": "presentation"}.items()}


def parts(data: bytes) -> dict[str, bytes]:
    """Parts of a package by name."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    except (zipfile.BadZipFile, KeyError) as e:
        raise DataError(f"not a package: {e}") from None


def package(files: dict[str, str | bytes], first: str | None = None) -> bytes:
    """A package of parts; `first` is stored uncompressed in front."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files, key=lambda n: n != first):
            z.writestr(zipfile.ZipInfo(name), files[name], zipfile.ZIP_STORED if name == first else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _xml(part: bytes) -> ET.Element:
    try:
        return ET.fromstring(part)
    except ET.ParseError as e:
        raise DataError(f"broken XML: {e}") from None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attr(e: ET.Element | None, name: str) -> str | None:
    """An attribute by its local name."""
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        e = None if e is None else next((c for c in e if local(c) == n), None)
    return e


def inside(e: ET.Element | None) -> list[ET.Element]:
    return [] if e is None else list(e)


def resolve(base: str, target: str) -> str:
    """A part's name from a relationship target."""
    steps = [] if target.startswith("/") else base.split("/")[:-1]
    for s in target.split("/"):
        if s == "..":
            steps = steps[:-1]
        elif s not in ("", "."):
            steps.append(s)
    return "/".join(steps)


def relationships(files: dict[str, bytes], part: str) -> dict[str, str]:
    """Targets by relationship id; external ones stay as they are."""
    folder, _, name = part.rpartition("/")
    rels = files.get(f"{folder}/_rels/{name}.rels".lstrip("/"))
    return {} if rels is None else {r.get("Id"): r.get("Target") if r.get("TargetMode") == "External" else resolve(part, r.get("Target")) for r in _xml(rels)}


def _rels(items: list[tuple[str, str, str, bool]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_R}/{t}" Target={quoteattr(x)}{" TargetMode=" + chr(34) + "External" + chr(34) if ext else ""}/>' for i, t, x, ext in items)
    return f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def _types(overrides: dict[str, str]) -> str:
    images = "".join(f'<Default Extension="{e}" ContentType="{m}"/>' for e, m in MIME.items())
    body = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in overrides.items())
    return f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{images}{body}</Types>'


# ---- spreadsheets


def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _check(rows: list) -> None:
    if len(rows) > MAX_ROWS or any(len(r) > MAX_COLUMNS for r in rows):
        raise DataError("the sheet has more rows or columns than a workbook holds")


def write_xlsx(sheets: Sheets) -> bytes:
    """Typed cells; the first row is frozen if others follow; columns are as wide as their longest text, 8 to 40."""
    files: dict[str, str | bytes] = {}
    names = sorted(sheets)
    for n, name in enumerate(names, 1):
        rows = sheets[name]
        _check(rows)
        width = [max(8, min(40, max((len(cell_text(r[k])) for r in rows if k < len(r)), default=0))) for k in range(max(map(len, rows), default=0))]
        cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(width, 1))
        frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if len(rows) > 1 else ""
        body = []
        for y, row in enumerate(rows, 1):
            cells = []
            for x, c in enumerate(row):
                ref = f'r="{column_name(x)}{y}"'
                if isinstance(c, bool):
                    cells.append(f'<c {ref} t="b"><v>{int(c)}</v></c>')
                elif isinstance(c, (int, float)):
                    cells.append(f"<c {ref}><v>{cell_text(c)}</v></c>")
                elif c is not None:
                    cells.append(f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>')
            body.append(f'<row r="{y}">{"".join(cells)}</row>')
        files[f"xl/worksheets/sheet{n}.xml"] = f'{_XML}<worksheet xmlns="{_S}">{frozen}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(body)}</sheetData></worksheet>'
    files["xl/workbook.xml"] = f'{_XML}<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name={quoteattr(x)} sheetId="{n}" r:id="rId{n}"/>' for n, x in enumerate(names, 1)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = _rels([(f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml", False) for n in range(1, len(names) + 1)])
    files["_rels/.rels"] = _rels([("rId1", "officeDocument", "xl/workbook.xml", False)])
    files["[Content_Types].xml"] = _types({"xl/workbook.xml": "spreadsheetml.sheet.main"} | {f"xl/worksheets/sheet{n}.xml": "spreadsheetml.worksheet" for n in range(1, len(names) + 1)})
    return package(files)


def date_formats(styles_part: bytes) -> set[str]:
    """Numbers of the cell formats that show dates or times."""
    styles = _xml(styles_part)
    own = {f.get("numFmtId") for f in styles.iter() if local(f) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)}
    return {str(k) for k, x in enumerate(inside(child(styles, "cellXfs"))) if x.get("numFmtId") in own or x.get("numFmtId", "").isdigit() and (14 <= int(x.get("numFmtId")) <= 22 or 45 <= int(x.get("numFmtId")) <= 47)}


def xlsx_cell(c: ET.Element, shared: list[str], dates: set[str], text: Callable[[ET.Element], str]) -> Cell:
    """The value of a cell element."""
    v, kind = child(c, "v"), c.get("t", "n")
    value = v.text if v is not None else None
    if kind == "inlineStr":
        return text(c)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return value == "1"
    if kind == "str":
        return value
    if kind != "n" or c.get("s") in dates:
        raise DataError(f"cell {c.get('r')} can't be represented without data loss")
    return int(value) if re.fullmatch("-?[0-9]{1,18}", value) else number(float(value))


def read_xlsx(data: bytes) -> Sheets:
    """Typed cells of all sheets. Dates and errors can't be kept and are refused."""
    files = parts(data)
    if "xl/workbook.xml" not in files:
        raise DataError("the workbook part is missing")
    rels = relationships(files, "xl/workbook.xml")
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    shared = [text(s) for s in _xml(files["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in files else []
    dates = date_formats(files["xl/styles.xml"]) if "xl/styles.xml" in files else set()
    out: Sheets = {}
    for s in inside(child(_xml(files["xl/workbook.xml"]), "sheets")):
        rows: list[list] = []
        for row in inside(child(_xml(files[rels[attr(s, "id")]]), "sheetData")):
            y = int(row.get("r", len(rows) + 1))
            while len(rows) < y:
                rows.append([])
            for c in row:
                x = column_index(c.get("r")) if c.get("r") else len(rows[y - 1])
                cell = xlsx_cell(c, shared, dates, text)
                rows[y - 1] += [None] * (x + 1 - len(rows[y - 1]))
                rows[y - 1][x] = cell
        width = max(map(len, rows), default=0)
        out[s.get("name")] = [r + [None] * (width - len(r)) for r in rows]
    return out


# ---- OpenDocument

_ODF_NS = {"office": "office", "text": "text", "table": "table", "draw": "drawing", "style": "style", "svg": "svg-compatible", "fo": "xsl-fo-compatible", "presentation": "presentation"}
_ODF_XMLNS = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in _ODF_NS.items()) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'


def odf_package(kind: str, body: str, styles: str = "", files: dict[str, bytes] | None = None) -> bytes:
    pictures = "".join(f'<manifest:file-entry manifest:full-path="{n}" manifest:media-type="{MIME[extension(d)]}"/>' for n, d in (files or {}).items())
    content = f'{_XML}<office:document-content {_ODF_XMLNS} office:version="1.2"><office:automatic-styles>{styles}</office:automatic-styles><office:body>{body}</office:body></office:document-content>'
    manifest = f'{_XML}<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{ODF_TYPE[kind]}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/>{pictures}</manifest:manifest>'
    return package({"mimetype": ODF_TYPE[kind], "content.xml": content, "META-INF/manifest.xml": manifest, **(files or {})}, first="mimetype")


def odf_body(data: bytes, kind: str) -> tuple[ET.Element, ET.Element]:
    """(body's content, whole document) of a package of the expected kind."""
    files = parts(data)
    if files.get("mimetype", b"").decode().strip() != ODF_TYPE[kind] or "content.xml" not in files:
        raise DataError(f"not an {kind} package")
    root = _xml(files["content.xml"])
    body = child(root, "body")
    if body is None or not len(body):
        raise DataError("the document has no body")
    return body[0], root


def odf_image(destination: str, alt: str, pictures: Parts, title: str | None = None) -> str:
    """A frame with an image: a part of the package if its bytes are there, else a link."""
    found = pictures.add(destination)
    pixels = (size(found[1]) if found else None) or (640, 480)
    extent = " ".join(f'svg:{n}="{min(v, 640) / 96:.4f}in"' for n, v in zip(("width", "height"), pixels))
    name = f" draw:name={quoteattr(title)}" if title is not None else ""
    return f'<draw:frame text:anchor-type="as-char"{name} {extent}><draw:image xlink:type="simple" xlink:href={quoteattr(found[0] if found else destination)}/><svg:title>{escape(alt)}</svg:title></draw:frame>'


def odf_picture(frame: ET.Element, files: dict[str, bytes]) -> tuple[str, str] | None:
    """(alternative text, destination) of a frame's image."""
    image, title = child(frame, "image"), child(frame, "title")
    if image is None:
        return None
    target = attr(image, "href") or ""
    part = target.removeprefix("./")
    return (title.text if title is not None else "") or "", data_uri(files[part]) if part in files else target


def odf_text(e: ET.Element) -> str:
    """Text of a paragraph with its tabs, blanks and breaks."""
    out = [e.text or ""]
    for c in e:
        n = local(c)
        out.append({"s": " " * int(attr(c, "c") or 1), "tab": "\t", "line-break": "\n"}.get(n) or ("" if n in ("note", "annotation") else odf_text(c)))
        out.append(c.tail or "")
    return "".join(out)


def _odf_string(text: str) -> str:
    text = escape(text).replace("\t", "<text:tab/>").replace("\n", "<text:line-break/>")
    return re.sub("  +", lambda m: f' <text:s text:c="{len(m.group()) - 1}"/>', text)


def write_ods(sheets: Sheets) -> bytes:
    out = []
    for name, rows in sorted(sheets.items()):
        _check(rows)
        body = []
        for row in rows:
            cells = []
            for c in row:
                if c is None:
                    cells.append("<table:table-cell/>")
                    continue
                kind = f'boolean" office:boolean-value="{cell_text(c)}' if isinstance(c, bool) else f'float" office:value="{cell_text(c)}' if isinstance(c, (int, float)) else "string"
                cells.append(f'<table:table-cell office:value-type="{kind}">' + "".join(f"<text:p>{_odf_string(l)}</text:p>" for l in cell_text(c).split("\n")) + "</table:table-cell>")
            body.append(f"<table:table-row>{''.join(cells)}</table:table-row>")
        out.append(f"<table:table table:name={quoteattr(name)}>{''.join(body)}</table:table>")
    return odf_package("ods", f"<office:spreadsheet>{''.join(out)}</office:spreadsheet>")


def ods_row(r: ET.Element) -> list[Cell]:
    """The cells of a table row; blanks at its end are cut before runs are expanded."""
    runs: list[tuple[Cell, int]] = []
    for c in r:
        if local(c) not in ("table-cell", "covered-table-cell"):
            continue
        kind, value = attr(c, "value-type"), attr(c, "value")
        text = "\n".join(odf_text(p) for p in c if local(p) == "p")
        cell = number(float(value)) if kind in ("float", "currency", "percentage") and value else attr(c, "boolean-value") == "true" if kind == "boolean" else text.strip() if text or kind == "string" else None
        if isinstance(cell, float) and re.fullmatch("-?[0-9]+", value or ""):
            cell = int(value)
        runs.append((cell, int(attr(c, "number-columns-repeated") or 1)))
    while runs and runs[-1][0] is None:
        runs.pop()
    return [cell for cell, n in runs for _ in range(n)]


def read_ods(data: bytes) -> Sheets:
    out: Sheets = {}
    for t in odf_body(data, "ods")[0]:
        if local(t) != "table":
            continue
        rows: list[list] = []
        for r in (r for r in t.iter() if local(r) == "table-row"):
            row = ods_row(r)
            rows += [row] * (int(attr(r, "number-rows-repeated") or 1) if row else 1)
        while rows and not rows[-1]:
            rows.pop()
        width = max(map(len, rows), default=0)
        out[attr(t, "name") or "Sheet1"] = [r + [None] * (width - len(r)) for r in rows]
    return out


_ODT_MARKS = {"strong": ("B", 'fo:font-weight="bold"'), "emphasis": ("I", 'fo:font-style="italic"'), "strikethrough": ("S", 'style:text-line-through-style="solid"'), "underline": ("U", 'style:text-underline-style="solid"'), "superscript": ("Sup", 'style:text-position="super 58%"'), "subscript": ("Sub", 'style:text-position="sub 58%"'), "code": ("Code", 'style:font-name="Courier New"')}


_ODT_ALIGN = {"left": "start", "right": "end", "center": "center"}


def write_odt(blocks: list[dict], assets: Mapping[str, bytes] | None = None) -> bytes:
    pictures = Parts("Pictures", assets)
    styles = "".join(f'<style:style style:name="{n}" style:family="text"><style:text-properties {p}/></style:style>' for n, p in _ODT_MARKS.values())
    styles += "".join(f'<style:style style:name="{n}" style:family="paragraph"/>' for n in ("Code_20_Block", "Quote", "Rule", "Math", "Note_20_Continued"))
    styles += "".join(f'<style:style style:name="Cell_{n}" style:family="paragraph"><style:paragraph-properties fo:text-align="{p}"/></style:style>' for n, p in _ODT_ALIGN.items())
    styles += "".join(f'<style:style style:name="{n}" style:family="text"/>' for n in ("Math", "Note"))
    styles += '<text:list-style style:name="Bullet"><text:list-level-style-bullet text:level="1" text:bullet-char="-"/></text:list-style><text:list-style style:name="Number"><text:list-level-style-number text:level="1"/></text:list-style>'

    def inline(items: list[dict]) -> str:
        out = []
        for i in items:
            kind = i["type"]
            if kind in ("text", "code", "math"):
                t = _odf_string(i["text"] if kind != "math" else M.render_inline(i))
                out.append(f'<text:span text:style-name="{kind.title()}">{t}</text:span>' if kind != "text" else t)
            elif kind == "footnote_reference":
                out.append(f'<text:span text:style-name="Note">{_odf_string(i["label"])}</text:span>')
            elif kind in _ODT_MARKS:
                out.append(f'<text:span text:style-name="{_ODT_MARKS[kind][0]}">{inline(i["content"])}</text:span>')
            elif kind == "link":
                title = f" office:title={quoteattr(i['title'])}" if i.get("title") is not None else ""
                out.append(f'<text:a xlink:type="simple" xlink:href={quoteattr(i["destination"])}{title}>{inline(i["content"])}</text:a>')
            elif kind == "bookmark":
                out.append(f"<text:bookmark text:name={quoteattr(i['name'])}/>")
            elif kind == "hard_break":
                out.append("<text:line-break/>")
            elif kind == "image":
                out.append(odf_image(i.get("destination", ""), i.get("alt", ""), pictures, i.get("title")))
            else:
                out.append(_odf_string(" " if kind == "soft_break" else M.render_inline(i)))
        return "".join(out)

    def many(items: list[dict], style: str = "") -> str:
        return "".join(map(lambda b: one(b, style), items))

    def one(b: dict, style: str = "") -> str:
        kind, name = b["type"], f' text:style-name="{style}"' if style else ""
        content = lambda: _odf_string(b.get("text") or "") + inline(b.get("content", []))
        if kind == "heading":
            return f'<text:h text:outline-level="{b["level"]}">{content()}</text:h>'
        if kind == "list":
            items = "".join(f"<text:list-item{f' text:start-value={chr(34)}{i['number']}{chr(34)}' if 'number' in i else ''}>{many(i['blocks'])}</text:list-item>" for i in b["items"])
            return f'<text:list text:style-name="{"Number" if b["ordered"] else "Bullet"}">{items}</text:list>'
        if kind == "table":
            rows = b.get("cells") or [[[{"type": "text", "text": c}] for c in r] for r in b.get("rows", [])]
            sides = b.get("alignments", [])
            side = lambda k: f' text:style-name="Cell_{sides[k]}"' if k < len(sides) and sides[k] in _ODT_ALIGN else ""
            cell = lambda k, c: f'<table:table-cell office:value-type="string"><text:p{side(k)}>{inline(c)}</text:p></table:table-cell>'
            return "<table:table>" + "".join("<table:table-row>" + "".join(cell(k, c) for k, c in enumerate(r)) + "</table:table-row>" for r in rows) + "</table:table>"
        if kind == "code_block":
            info = "_" + _style_name(b["info"]) if b.get("info") else ""
            return f'<text:p text:style-name="Code_20_Block{info}">{_odf_string(b["code"])}</text:p>'
        if kind == "quote":
            return many(b.get("blocks", []), "Quote") if b.get("blocks") else f'<text:p text:style-name="Quote">{_odf_string(b.get("text") or "")}</text:p>'
        if kind == "horizontal_rule":
            return '<text:p text:style-name="Rule"/>'
        if kind == "math":
            return f'<text:p text:style-name="Math">{_odf_string(b["text"])}</text:p>'
        if kind == "footnote_definition":
            first, *more = [p for p in b["blocks"] if "content" in p] or [{"content": []}]
            rest = "".join(f'<text:p text:style-name="Note_20_Continued">{inline(p["content"])}</text:p>' for p in more)
            return f"<text:p>{_odf_string('[^' + b['label'] + ']: ')}{inline(first['content'])}</text:p>{rest}"
        if kind in ("paragraph", "list_item"):
            return f"<text:p{name}>{content()}</text:p>"
        if kind == "image":
            return f"<text:p>{odf_image(f'data:image/{b['format']};base64,{b['data']}', b.get('alt', ''), pictures)}</text:p>"
        return f"<text:p>{_odf_string(M.render_block(b))}</text:p>"

    body = many(blocks)
    return odf_package("odt", f"<office:text>{body}</office:text>", styles, pictures.files)


def _style_name(text: str) -> str:
    """A style's name, in which other signs than letters and digits are written as _xx_."""
    return "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in text)


def _style_text(name: str) -> str:
    return re.sub("_([0-9a-f]+)_", lambda m: chr(int(m[1], 16)), name)


def read_odt(data: bytes) -> list[dict]:
    body, root = odf_body(data, "odt")
    files = parts(data)
    marks: dict[str, list[str]] = {}
    for s in (s for s in root.iter() if local(s) == "style" and attr(s, "family") == "text"):
        p = child(s, "text-properties")
        own = [k for k, ok in (("strong", attr(p, "font-weight") == "bold"), ("emphasis", attr(p, "font-style") == "italic"), ("strikethrough", (attr(p, "text-line-through-style") or "none") != "none"), ("underline", (attr(p, "text-underline-style") or "none") != "none"), ("superscript", (attr(p, "text-position") or "").startswith("super")), ("subscript", (attr(p, "text-position") or "").startswith("sub "))) if ok]
        marks[attr(s, "name")] = ["code"] if (attr(p, "font-name") or "").startswith("Courier") else own

    def inline(e: ET.Element) -> list[dict]:
        out: list[dict] = []
        put = lambda i: M._add(out, i)
        put({"type": "text", "text": e.text or ""})
        for c in e:
            n = local(c)
            if n == "span":
                inner = inline(c)
                own = marks.get(attr(c, "style-name"), [])
                name, whole = attr(c, "style-name"), odf_text(c)
                if name == "Math" and whole.startswith("$"):
                    k = 2 if whole.startswith("$$") else 1
                    inner = [{"type": "math", "text": whole[k:-k], "display": k == 2}]
                elif name == "Note":
                    inner = [{"type": "footnote_reference", "label": whole}]
                elif own == ["code"]:
                    inner = [{"type": "code", "text": odf_text(c)}]
                else:
                    for m in reversed(own):
                        inner = [{"type": m, "content": inner}]
                for i in inner:
                    put(i)
            elif n == "a":
                put({"type": "link", "destination": attr(c, "href") or "", "content": inline(c)} | ({"title": attr(c, "title")} if attr(c, "title") is not None else {}))
            elif n in ("bookmark", "bookmark-start"):
                put({"type": "bookmark", "name": attr(c, "name") or ""})
            elif n == "line-break":
                put({"type": "hard_break"})
            elif n == "frame" and (found := odf_picture(c, files)):
                put({"type": "image", "alt": found[0], "destination": found[1]} | ({"title": attr(c, "name")} if attr(c, "name") else {}))
            elif n in ("s", "tab"):
                put({"type": "text", "text": " " * int(attr(c, "c") or 1) if n == "s" else "\t"})
            elif n not in ("note", "annotation", "bookmark-end"):
                for i in inline(c):
                    put(i)
            put({"type": "text", "text": c.tail or ""})
        return out

    by_side = {"start": "left", "left": "left", "end": "right", "right": "right", "center": "center"}
    aligned = {attr(s, "name"): by_side[side] for s in root.iter() if local(s) == "style" and (side := attr(child(s, "paragraph-properties"), "text-align")) in by_side}
    ordered = {attr(s, "name") for s in root.iter() if local(s) == "list-style" and any(local(c) == "list-level-style-number" for c in s)}

    def blocks(e: ET.Element, style: str = "") -> list[dict]:
        out: list[dict] = []
        for c in e:
            n, name = local(c), attr(c, "style-name") or ""
            if n == "h":
                out.append({"type": "heading", "level": int(attr(c, "outline-level") or 1), "content": inline(c)})
            elif n == "p" and name == "Rule":
                out.append({"type": "horizontal_rule"})
            elif n == "p" and name == "Math":
                out.append({"type": "math", "text": odf_text(c)})
            elif n == "p" and name.startswith("Code"):
                info = _style_text(name.removeprefix("Code_20_Block").removeprefix("_"))
                out.append({"type": "code_block", "code": odf_text(c)} | ({"info": info} if info and name.startswith("Code_20_Block") else {}))
            elif n == "p" and name == "Note_20_Continued" and out and out[-1]["type"] == "footnote_definition":
                out[-1]["blocks"].append({"type": "paragraph", "content": inline(c)})
            elif n == "p" and (odf_text(c).strip() or any(local(x) == "image" for x in c.iter())):
                content = inline(c)
                note = re.match(r"\[\^([^\]\s]+)\]: ?", content[0].get("text", "")) if content else None
                if note:
                    content[0]["text"] = content[0]["text"][note.end() :]
                    out.append({"type": "footnote_definition", "label": note[1], "blocks": [{"type": "paragraph", "content": [i for i in content if i.get("text") != ""]}]})
                else:
                    out.append({"type": "quote", "blocks": [{"type": "paragraph", "content": content}]} if name == "Quote" else {"type": "paragraph", "content": content})
            elif n == "list":
                number_of = name in ordered or style in ordered and not name
                items = []
                for k, i in enumerate((i for i in c if local(i) == "list-item"), 1):
                    items.append(({"number": int(attr(i, "start-value") or k)} if number_of else {}) | {"blocks": blocks(i, name or style)})
                for i in items:
                    first = i["blocks"][0]["content"] if i["blocks"] and i["blocks"][0]["type"] == "paragraph" else []
                    if first and first[0]["type"] == "text" and (t := re.match(r"\[([ x])\] ", first[0]["text"])):
                        first[0]["text"] = first[0]["text"][4:]
                        first.insert(0, {"type": "task_list_marker", "checked": t[1] == "x"})
                out.append({"type": "list", "ordered": number_of, **({"start": items[0]["number"]} if number_of and items else {}), "items": items})
            elif n == "table":
                rows = [[cell for cell in r if local(cell) == "table-cell"] for r in c.iter() if local(r) == "table-row"]
                first = [next((attr(p, "style-name") or "" for p in cell if local(p) == "p"), "") for cell in rows[0]] if rows else []
                sides = [aligned.get(f, "none") for f in first]
                block = {"type": "table", "cells": [[[x for p in cell if local(p) == "p" for x in inline(p)] for cell in r] for r in rows]}
                out.append(block | ({"alignments": sides} if any(x != "none" for x in sides) else {}))
            elif n in ("section", "list-header"):
                out += blocks(c)
        return out

    return blocks(body)
