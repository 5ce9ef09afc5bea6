"""Slides: Markdown to slides and back, and the presentation packages.

A slide is {"title", "blocks"}; a block is {"kind": text, image or table} with text and bulleted, alt and source, or rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import markdown as M
from ..operators.batches import pieces
from ..operators.html import table_text
from .images import Parts, data_uri, extent
from .packages import _A, _P, _R, _XML, _rels, _types, _xml, attr, child, inside, local, odf_body, odf_image, odf_package, odf_picture, odf_text, package, parts, relationships
from .structured import DataError, parse_table


def _plain(text: str) -> str:
    return M.plain(M.parse_inlines(text))


def of_markdown(text: str) -> list[dict]:
    """`# ` and `## ` lines start slides; runs of bar lines are tables; a line that is one image is an image."""
    slides: list[dict] = []
    lines = [l.strip() for l in text.splitlines()]
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line or line == "---":
            continue
        if m := re.match("##? (.*)", line):
            slides.append({"title": _plain(m[1]), "blocks": []})
            continue
        if not slides:
            slides.append({"title": "", "blocks": []})
        blocks = slides[-1]["blocks"]
        if line.startswith("|"):
            run = [line]
            while at < len(lines) and lines[at].startswith("|"):
                run.append(lines[at])
                at += 1
            rows = parse_table("\n".join(run))
            blocks += [{"kind": "table", "rows": [["\n".join(map(_plain, c.split("\n"))) for c in r] for r in rows]}] if rows else [_text(l) for l in run]
        elif len(i := M.parse_inlines(line)) == 1 and i[0]["type"] == "image":
            blocks.append({"kind": "image", "alt": i[0]["alt"], "source": i[0]["destination"]})
        else:
            blocks.append(_text(line))
    return slides or [{"title": "", "blocks": []}]


def rows_of_markdown(df: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """(keys, slide, title, block, kind, text) for each block of each document's slides, from 1; a null block if it has none."""
    own = [("slide", pa.int32()), ("title", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("text", pa.string())]
    given = df.where(F.col(markdown).isNotNull()).select(*keys, markdown)
    schema = T.StructType([*df.select(*keys).schema, *T._parse_datatype_string("slide int, title string, block int, kind string, text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, -1):
            out, owner = [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for n, slide in enumerate(of_markdown(text), 1):
                    for m, b in enumerate(slide["blocks"], 1) if slide["blocks"] else [(None, {})]:
                        whole = b.get("text") or b.get("alt") or "\n".join("|".join(r) for r in b.get("rows", []))
                        out.append((n, slide["title"], m, b.get("kind"), whole))
                        owner.append(k)
            made = [pa.array([o[j] for o in out], kind) for j, (_, kind) in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(owner, pa.int64())) for c in batch.columns[:-1]], *made], names=schema.names)

    return given.mapInArrow(run, schema)


def _text(line: str) -> dict:
    m = re.match(r"(?:[-*]|[0-9]+\.) (.*)", line)
    return {"kind": "text", "text": _plain(m[1] if m else line), "bulleted": bool(m)}


def to_markdown(slides: list[dict]) -> str:
    """`## title` or `## Slide N`, blocks after it, slides parted by rules."""
    out = []
    for n, s in enumerate(slides, 1):
        pieces, bullets = [f"## {s['title'].strip() or f'Slide {n}'}"], []
        for b in [*s["blocks"], {"kind": "end"}]:
            if b["kind"] == "text" and b["bulleted"]:
                bullets.append("- " + M._escaped(b["text"]))
                continue
            if bullets:
                pieces.append("\n".join(bullets))
                bullets = []
            if b["kind"] == "text":
                pieces.append(M._escaped(b["text"]))
            elif b["kind"] == "image":
                pieces.append(f"![{M._escaped(b['alt'])}]({M._target(b['source'])})")
            elif b["kind"] == "table":
                width = max(map(len, b["rows"]), default=0)
                pieces.append(table_text([r + [""] * (width - len(r)) for r in b["rows"]]))
        out.append("\n\n".join(pieces))
    return "\n\n---\n\n".join(out) + "\n"


def chart_rows(part: bytes) -> list[list[str]]:
    """A chart's cached points as a table: categories down, series across; a missing category is its number."""
    root = _xml(part)
    series = [s for s in root.iter() if local(s) == "ser"]

    def points(e: ET.Element | None) -> dict[int, str]:
        return {} if e is None else {int(attr(p, "idx") or 0): "".join(v.text or "" for v in p if local(v) == "v") for p in e.iter() if local(p) == "pt"}

    names, columns, categories = [], [], {}
    for k, s in enumerate(series, 1):
        names.append(next(iter(points(child(s, "tx")).values()), f"Series {k}"))
        categories = categories or points(child(s, "cat"))
        columns.append(points(child(s, "val")))
    last = max([*categories, *(i for c in columns for i in c)], default=-1)
    return [["", *names], *[[categories.get(i, str(i + 1)), *[c.get(i, "") for c in columns]] for i in range(last + 1)]] if series else []


def read_pptx(data: bytes) -> list[dict]:
    """Slides in the order of the presentation's list."""
    files = parts(data)
    if "ppt/presentation.xml" not in files:
        raise DataError("the presentation part is missing")
    rels = relationships(files, "ppt/presentation.xml")
    out = []
    for s in inside(child(_xml(files["ppt/presentation.xml"]), "sldIdLst")):
        ref = next((v for k, v in s.attrib.items() if k == f"{{{_R}}}id"), "")
        if rels.get(ref) not in files:
            raise DataError(f"slide {ref} has no part")
        out.append(_slide(files, rels[ref]))
    return out


def _slide(files: dict[str, bytes], name: str) -> dict:
    rels, slide = relationships(files, name), {"title": "", "blocks": []}
    text = lambda p: "".join("\n" if local(x) == "br" else x.text or "" for x in p.iter() if local(x) in ("t", "br"))
    tree = child(_xml(files[name]), "cSld", "spTree")
    for shape in [] if tree is None else tree:
        n = local(shape)
        if n == "sp":
            kind = next((attr(x, "type") for x in shape.iter() if local(x) == "ph"), None)
            paragraphs = [p for p in shape.iter() if local(p) == "p"]
            if kind in ("title", "ctrTitle") and not slide["title"]:
                slide["title"] = " ".join(filter(None, map(text, paragraphs)))
                continue
            for p in paragraphs:
                if text(p).strip():
                    bulleted = child(p, "pPr", "buChar") is not None or child(p, "pPr", "buAutoNum") is not None
                    slide["blocks"].append({"kind": "text", "text": text(p), "bulleted": bulleted})
        elif n == "pic":
            blip = next((x for x in shape.iter() if local(x) == "blip"), None)
            alt = next((attr(x, "descr") for x in shape.iter() if local(x) == "cNvPr"), None)
            part = rels.get(attr(blip, "embed") or attr(blip, "link") or "")
            if part in files or part and attr(blip, "link"):
                slide["blocks"].append({"kind": "image", "alt": alt or "", "source": data_uri(files[part]) if part in files else part})
        elif n == "graphicFrame":
            table = next((t for t in shape.iter() if local(t) == "tbl"), None)
            chart = next((attr(c, "id") for c in shape.iter() if local(c) == "chart"), None)
            if table is not None:
                slide["blocks"].append({"kind": "table", "rows": [["\n".join(text(p) for p in c.iter() if local(p) == "p") for c in r if local(c) == "tc"] for r in table if local(r) == "tr"]})
            elif chart and rels.get(chart) in files and (rows := chart_rows(files[rels[chart]])):
                slide["blocks"].append({"kind": "table", "rows": rows})
    return slide


#: Fixed values, in EMU: the slide, its margin, where content begins, heights of a line and of a table row, and the gap.
SLIDE_WIDTH, SLIDE_HEIGHT, MARGIN = 9_144_000, 6_858_000, 457_200
CONTENT_TOP, LINE_HEIGHT, ROW_HEIGHT, GAP = 1_600_200, 411_480, 370_840, 91_440
CONTENT_WIDTH = SLIDE_WIDTH - 2 * MARGIN
LINE_CHARACTERS = 80


def text_height(texts: list[str]) -> int:
    """Height of paragraphs of so many characters a line."""
    return max(sum(len(t) // LINE_CHARACTERS + 1 for t in texts), 1) * LINE_HEIGHT + 2 * GAP


def table_height(rows: list[list[str]]) -> int:
    """Height of a table: each row is as high as its cell of most lines."""
    return max(sum(max((max(len(c.splitlines()), 1) for c in r), default=1) * ROW_HEIGHT for r in rows), ROW_HEIGHT)


def image_extent(data: bytes | None, top: int) -> tuple[int, int]:
    """Width and height of an image at its own size, or smaller so that it fits what is left of the slide below top."""
    return extent(data, CONTENT_WIDTH, max(SLIDE_HEIGHT - top - MARGIN, SLIDE_HEIGHT // 4))


def _masters() -> dict[str, str]:
    """A theme, a master and one layout: what a presentation needs to open."""
    ns = f'xmlns:p="{_P}" xmlns:a="{_A}" xmlns:r="{_R}"'
    empty = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'

    def holder(k: int, kind: str, top: int, height: int) -> str:
        place = f'<a:xfrm><a:off x="{MARGIN}" y="{top}"/><a:ext cx="{CONTENT_WIDTH}" cy="{height}"/></a:xfrm>'
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="{kind} {k}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody><a:bodyPr/><a:lstStyle/><a:p/></p:txBody></p:sp>'

    tree = f'<p:cSld><p:spTree>{empty}{holder(2, "title", GAP, CONTENT_TOP - 2 * GAP)}{holder(3, "body", CONTENT_TOP, SLIDE_HEIGHT - CONTENT_TOP - MARGIN)}</p:spTree></p:cSld>'
    slots = ("bg1", "tx1", "bg2", "tx2", *(f"accent{k}" for k in range(1, 7)), "hlink", "folHlink")
    own = ("lt1", "dk1", "lt2", "dk2", *slots[4:])
    mapped = " ".join(f'{a}="{b}"' for a, b in zip(slots, own))
    colors = {"dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6"} | {s: "4472C4" for s in slots[4:]}
    scheme = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in colors.items())
    fonts = "".join(f'<a:{k}Font><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:{k}Font>' for k in ("major", "minor"))
    fill, line = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln w="6350"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>'
    effect = "<a:effectStyle><a:effectLst/></a:effectStyle>"
    formats = f'<a:fmtScheme name="Plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme>'
    return {
        "ppt/theme/theme1.xml": f'{_XML}<a:theme xmlns:a="{_A}" name="Plain"><a:themeElements><a:clrScheme name="Plain">{scheme}</a:clrScheme><a:fontScheme name="Plain">{fonts}</a:fontScheme>{formats}</a:themeElements></a:theme>',
        "ppt/slideMasters/slideMaster1.xml": f'{_XML}<p:sldMaster {ns}>{tree}<p:clrMap {mapped}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", False), ("rId2", "theme", "../theme/theme1.xml", False)]),
        "ppt/slideLayouts/slideLayout1.xml": f'{_XML}<p:sldLayout {ns} type="obj">{tree.replace("<p:cSld>", "<p:cSld name=" + chr(34) + "Title and content" + chr(34) + ">")}<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _rels([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml", False)]),
    }


def _properties(n: int) -> dict[str, str]:
    core, app = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties", "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
    return {
        "docProps/core.xml": f'{_XML}<cp:coreProperties xmlns:cp="{core}" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Presentation</dc:title></cp:coreProperties>',
        "docProps/app.xml": f'{_XML}<Properties xmlns="{app}"><Application>docframe</Application><Slides>{n}</Slides></Properties>',
    }


class _SlideWriter:
    """Shapes of one slide from the top down."""

    def __init__(self, pictures: Parts) -> None:
        self.pictures, self.shapes, self.top = pictures, [], CONTENT_TOP
        self.rels = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml", False)]

    def place(self, width: int, height: int, top: int | None = None) -> str:
        return f'<a:off x="{MARGIN}" y="{self.top if top is None else top}"/><a:ext cx="{width}" cy="{height}"/>'

    @staticmethod
    def paragraph(text: str, bulleted: bool = False) -> str:
        bullet = '<a:pPr marL="285750" indent="-285750"><a:buFont typeface="Arial"/><a:buChar char="\u2022"/></a:pPr>' if bulleted else '<a:pPr marL="0" indent="0"><a:buNone/></a:pPr>'
        return f"<a:p>{bullet}" + "<a:br/>".join(f'<a:r><a:rPr lang="en-US"/><a:t>{escape(t)}</a:t></a:r>' for t in text.split("\n")) + "</a:p>"

    def text(self, body: str, place: str, holder: str = "") -> None:
        k = len(self.shapes) + 2
        shape = f'<a:xfrm>{place}</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom>'
        box = "" if holder else ' txBox="1"'
        self.shapes.append(f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="Text {k}"/><p:cNvSpPr{box}/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{shape}</p:spPr><p:txBody><a:bodyPr wrap="square"><a:normAutofit/></a:bodyPr><a:lstStyle/>{body}</p:txBody></p:sp>')

    def add(self, b: dict) -> None:
        k = len(self.shapes) + 2
        if b["kind"] == "text":
            height = text_height([b["text"]])
            self.text(self.paragraph(b["text"], b["bulleted"]), self.place(CONTENT_WIDTH, height))
        elif b["kind"] == "image":
            found = self.pictures.add(b["source"])
            x, height = image_extent(found and found[1], self.top)
            self.rels.append((f"rId{len(self.rels) + 1}", "image", f"../media/{found[0].rpartition('/')[2]}" if found else b["source"], not found))
            fill = f'<p:blipFill><a:blip r:{"embed" if found else "link"}="{self.rels[-1][0]}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill>'
            shape = f'<p:spPr><a:xfrm>{self.place(x, height)}</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr>'
            self.shapes.append(f'<p:pic><p:nvPicPr><p:cNvPr id="{k}" name="Picture {k}" descr={quoteattr(b["alt"])}/><p:cNvPicPr/><p:nvPr/></p:nvPicPr>{fill}{shape}</p:pic>')
        else:
            width, height = max(map(len, b["rows"]), default=0) or 1, table_height(b["rows"])
            grid = f'<a:gridCol w="{CONTENT_WIDTH // width}"/>' * width
            cell = lambda c: f"<a:tc><a:txBody><a:bodyPr/><a:lstStyle/>{''.join(map(self.paragraph, c.split(chr(10))))}</a:txBody><a:tcPr/></a:tc>"
            rows = "".join(f'<a:tr h="{table_height([r])}">{"".join(map(cell, r + [""] * (width - len(r))))}</a:tr>' for r in b["rows"])
            table = f'<a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{grid}</a:tblGrid>{rows}</a:tbl>'
            frame = f'<p:nvGraphicFramePr><p:cNvPr id="{k}" name="Table {k}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm>{self.place(CONTENT_WIDTH, height)}</p:xfrm>'
            self.shapes.append(f'<p:graphicFrame>{frame}<a:graphic><a:graphicData uri="{_A.replace("main", "table")}">{table}</a:graphicData></a:graphic></p:graphicFrame>')
        self.top += height + GAP


def write_pptx(slides: list[dict], assets: Mapping[str, bytes] | None = None) -> bytes:
    """A presentation with a theme, a master, a layout, and blocks one below the other on each slide."""
    ns = f'xmlns:p="{_P}" xmlns:a="{_A}" xmlns:r="{_R}"'
    pictures, files = Parts("ppt/media", assets), _masters() | _properties(len(slides))
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    for n, s in enumerate(slides, 1):
        w = _SlideWriter(pictures)
        if s["title"]:
            w.text(w.paragraph(s["title"]), w.place(CONTENT_WIDTH, CONTENT_TOP - 2 * GAP, GAP), '<p:ph type="title"/>')
        for b in s["blocks"]:
            w.add(b)
        files[f"ppt/slides/slide{n}.xml"] = f"{_XML}<p:sld {ns}><p:cSld><p:spTree>{tree}{''.join(w.shapes)}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sld>"
        files[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels(w.rels)
    own = range(1, len(slides) + 1)
    ids = "".join(f'<p:sldId id="{255 + n}" r:id="rId{n + 1}"/>' for n in own)
    sizes = f'<p:sldSz cx="{SLIDE_WIDTH}" cy="{SLIDE_HEIGHT}"/><p:notesSz cx="{SLIDE_HEIGHT}" cy="{SLIDE_WIDTH}"/>'
    files["ppt/presentation.xml"] = f'{_XML}<p:presentation {ns}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst>{sizes}</p:presentation>'
    files["ppt/_rels/presentation.xml.rels"] = _rels([("rId1", "slideMaster", "slideMasters/slideMaster1.xml", False), *[(f"rId{n + 1}", "slide", f"slides/slide{n}.xml", False) for n in own]])
    files["_rels/.rels"] = _rels([("rId1", "officeDocument", "ppt/presentation.xml", False), ("rId2", "extended-properties", "docProps/app.xml", False)])
    types = {"ppt/presentation.xml": "presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "ppt/theme/theme1.xml": "theme", "docProps/app.xml": "extended-properties"}
    files["[Content_Types].xml"] = _types(types | {f"ppt/slides/slide{n}.xml": "presentationml.slide" for n in own}).replace("</Types>", '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>')
    core = '<Relationship Id="rId3" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>'
    files["_rels/.rels"] = files["_rels/.rels"].replace("</Relationships>", core)
    return package(files | pictures.files)


def write_odp(slides: list[dict], assets: Mapping[str, bytes] | None = None) -> bytes:
    pictures, pages = Parts("Pictures", assets), []
    for n, s in enumerate(slides, 1):
        out = [f'<draw:frame presentation:class="title"><draw:text-box><text:p>{escape(s["title"])}</text:p></draw:text-box></draw:frame>'] if s["title"] else []
        for b in s["blocks"]:
            if b["kind"] == "text":
                p = f"<text:p>{escape(b['text'])}</text:p>"
                out.append(f"<draw:frame><draw:text-box>{f'<text:list><text:list-item>{p}</text:list-item></text:list>' if b['bulleted'] else p}</draw:text-box></draw:frame>")
            elif b["kind"] == "image":
                out.append(odf_image(b["source"], b["alt"], pictures))
            else:
                rows = "".join("<table:table-row>" + "".join(f"<table:table-cell>{''.join(f'<text:p>{escape(l)}</text:p>' for l in c.split(chr(10)))}</table:table-cell>" for c in r) + "</table:table-row>" for r in b["rows"])
                out.append(f"<draw:frame><table:table>{rows}</table:table></draw:frame>")
        pages.append(f'<draw:page draw:name="page{n}">{"".join(out)}</draw:page>')
    return odf_package("odp", f"<office:presentation>{''.join(pages)}</office:presentation>", files=pictures.files)


def read_odp(data: bytes) -> list[dict]:
    out, files = [], parts(data)
    for page in (p for p in odf_body(data, "odp")[0] if local(p) == "page"):
        slide: dict = {"title": "", "blocks": []}
        for frame in page:
            table = next((t for t in frame.iter() if local(t) == "table"), None)
            picture = odf_picture(frame, files)
            if attr(frame, "class") == "title":
                slide["title"] = " ".join(odf_text(p) for p in frame.iter() if local(p) == "p")
            elif table is not None:
                slide["blocks"].append({"kind": "table", "rows": [["\n".join(odf_text(p) for p in c if local(p) == "p") for c in r if local(c) == "table-cell"] for r in table.iter() if local(r) == "table-row"]})
            elif picture:
                slide["blocks"].append({"kind": "image", "alt": picture[0], "source": picture[1]})
            else:
                bullets = {id(p) for l in frame.iter() if local(l) == "list" for p in l.iter() if local(p) == "p"}
                slide["blocks"] += [{"kind": "text", "text": odf_text(p), "bulleted": id(p) in bullets} for p in frame.iter() if local(p) == "p" and odf_text(p).strip()]
        out.append(slide)
    return out or [{"title": "", "blocks": []}]
