"""Rows of a sheet from a row on: the same as when the part is read from its start, and without parsing what comes before."""

import io
import zipfile

import pytest

from docframe.sources import packages
from docframe.sources import workbooks as W

PART = "xl/worksheets/sheet1.xml"


def _package(body: str) -> zipfile.ZipFile:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(PART, body)
    return zipfile.ZipFile(out)


def _rows(z, start):
    got = list(W._xlsx_rows(z, PART, start))
    return [*got[:1], *[r for r in got[1:] if r[0] >= start]]


CELL = '<c t="inlineStr"><is><t>{} &gt; &lt;row&gt;</t></is></c>'
BODIES = {
    "numbered": "".join(f'<row r="{k}">{CELL.format(k)}</row>' for k in range(1, 30001)),
    "without numbers": "".join(f"<row{' spans=' + chr(39) + 'a>b' + chr(39) if k % 7 == 0 else ''}>{CELL.format(k)}</row>" for k in range(1, 30001)),
    "gaps": "".join((f'<row hidden="1" r = "{3 * k}">' if k % 5 else "<row>") + f"{CELL.format(k)}</row>" if k % 11 else "<row/>" for k in range(1, 12001)),
    "comment": "<row r='1'/><!-- <row r='9000'> -->" + "".join(f'<row r="{k}">{CELL.format(k)}</row>' for k in range(2, 200)),
    "one": '<row r="1"/>',
    "none": "",
}


@pytest.mark.parametrize("name", BODIES)
@pytest.mark.parametrize("prefix", ["", "x:"])
def test_same_rows(name, prefix):
    body = BODIES[name].replace("<row", f"<{prefix}row").replace("</row", f"</{prefix}row")
    z = _package(f'<?xml version="1.0"?><{prefix}worksheet xmlns="m" xmlns:x="m"><{prefix}sheetData>{body}</{prefix}sheetData><sheetFormatPr/></{prefix}worksheet>')
    whole = list(W._xlsx_rows(z, PART))
    for start in (1, 2, 3, 150, 11_000, 29_999, 90_000):
        assert _rows(z, start) == [*whole[:1], *[r for r in whole[1:] if r[0] >= start]]
    if name in ("numbered", "gaps", "without numbers"):
        assert W._count(z, "xlsx", PART) == len(whole)


def test_only_the_range_is_parsed(monkeypatch):
    z = zipfile.ZipFile(io.BytesIO(packages.write_xlsx({"Sheet1": [["a"], *[[k] for k in range(5000)]]})))
    seen, cell = [], packages.xlsx_cell
    monkeypatch.setattr(packages, "xlsx_cell", lambda c, *rest: (seen.append(1), cell(c, *rest))[1])
    assert [c[0] for _, c in W._rows(z, "xlsx", PART, 4901)][:3] == ["a", 4899, 4900]
    assert len(seen) == 102
