import json
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.plans import convert as V
from docframe.sources import images, packages, slides, structured
from docframe.sources.slides import chart_rows
from tests.test_markdown import NOTED, WHOLE


def through(data, *formats, options=V.Options()):
    data = data if isinstance(data, bytes) else data.encode()
    for a, b in zip(formats, formats[1:]):
        data = V.convert_bytes(data, a, b, options)
    return data


PEOPLE = [{"name": "Ada", "score": -42, "active": True}, {"name": "042", "score": 3, "active": False}]


@pytest.mark.parametrize("fmt", ["xlsx", "ods", "yaml", "toml"])
def test_typed_data_comes_back(fmt):
    assert json.loads(through(json.dumps(PEOPLE), "json", fmt, "json")) == PEOPLE


def test_strings_that_look_like_others_stay_strings():
    data = [{"identifier": "042", "enabled": "true", "score": "3.14"}]
    for fmt in ("xlsx", "ods", "yaml", "toml"):
        assert json.loads(through(json.dumps(data), "json", fmt, "json")) == data


def test_two_sheets_through_eight_hops():
    data = {"First": [{"id": 1, "active": True, "name": "a"}], "Second": [{"score": 1.5, "name": "b"}]}
    assert json.loads(through(json.dumps(data), "json", "xlsx", "ods", "xlsx", "json", "toml", "yaml", "ods", "json")) == data


@pytest.mark.parametrize("value", [[None, 1], {"a": {"b": None, "c": 1.25}}, {"large": 18446744073709551615}, {structured.ENVELOPE: "x"}, "text", None])
def test_values_survive_toml(value):
    assert json.loads(through(json.dumps(value), "json", "toml", "yaml", "json")) == value


@settings(max_examples=40, deadline=None)
@given(st.lists(st.fixed_dictionaries({"score": st.integers(-(2**31), 2**31 - 1), "active": st.booleans()}), min_size=1, max_size=19))
def test_generated_rows_survive_workbooks(rows):
    assert json.loads(through(json.dumps(rows), "json", "xlsx", "json")) == rows


def test_csv_specials_survive():
    text = 'id,name,tags\n1,"a\nb",x|y\\z\n'
    assert through(text, "csv", "markdown", "csv").decode() == text
    assert through(text, "csv", "docx", "csv").decode().count("\n") == text.count("\n")


def test_csv_delimiter_and_text():
    o = V.Options(delimiter=V.parse_delimiter(";"))
    text = "ship;crew\nOrca;12\nKestrel, old;7\n"
    made = through(text, "csv", "markdown", options=o)
    assert made.decode() == "| ship | crew |\n| --- | --- |\n| Orca | 12 |\n| Kestrel, old | 7 |"
    assert through(made, "markdown", "csv", options=o).decode() == text


def test_ragged_csv_is_an_error():
    with pytest.raises(V.ConversionError) as e:
        through("a,b\n1\n", "csv", "json")
    assert e.value.code == "InvalidInput"


def png(width, height, shade=200):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress((b"\0" + bytes([shade, 9, 9]) * width) * height)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("fmt", ["docx", "odt", "json", "yaml", "toml"])
@pytest.mark.parametrize("held", [False, True])
def test_documents_come_back(fmt, held):
    whole = WHOLE.replace("photo/buoy.png", images.data_uri(png(3, 2))) if held else WHOLE
    assert through(whole, "markdown", fmt, "markdown").decode() == whole


def test_notes_inside_text_come_back_as_notes():
    made = through(NOTED, "markdown", "docx", "markdown").decode()
    assert "Seen[^inline-2]." in made and "[^inline-2]: by the **mate**" in made


@pytest.mark.parametrize("fmt,folder", [("docx", "word/media"), ("odt", "Pictures"), ("pptx", "ppt/media"), ("odp", "Pictures")])
def test_images_are_parts_of_packages(fmt, folder):
    a, b = png(3, 2), png(5, 4, 90)
    text = "# T\n\n![a](pic/a.png)\n\n![b](pic/b.png)\n\n![again](pic/c.png)\n\n![far](https://harbour.example/x.png)\n"
    data = through(text, "markdown", fmt, options=V.Options(assets={"pic/a.png": a, "pic/b.png": b, "pic/c.png": a}))
    parts = {n: d for n, d in packages.parts(data).items() if n.startswith(folder)}
    assert sorted(parts.values()) == sorted([a, b])  # equal images are one part
    back = through(data, fmt, "markdown").decode()
    for name, target in (("a", images.data_uri(a)), ("b", images.data_uri(b)), ("again", images.data_uri(a)), ("far", "https://harbour.example/x.png")):
        assert f"![{name}]({target})" in back


def test_pages_hold_their_images():
    data = png(2, 2)
    page = through("![x](x.png)\n", "markdown", "html", options=V.Options(assets={"x.png": data})).decode()
    assert f'src="{images.data_uri(data)}"' in page


def test_files_take_images_along(tmp_path):
    (tmp_path / "pic").mkdir()
    (tmp_path / "pic" / "a.png").write_bytes(png(3, 2))
    (tmp_path / "in.md").write_text("![a](pic/a.png) ![b](../secret.png) ![a](pic/a.png)\n")
    V.convert_file(str(tmp_path / "in.md"), str(tmp_path / "mid.docx"))
    V.convert_file(str(tmp_path / "mid.docx"), str(tmp_path / "out" / "back.md"))
    assert (tmp_path / "out" / "back.md").read_text() == "![a](image/image1.png) ![b](../secret.png) ![a](image/image1.png)\n"
    assert (tmp_path / "out" / "image" / "image1.png").read_bytes() == png(3, 2)


@pytest.mark.parametrize("source", ["docx", "odt", "json"])
def test_image_files_leave_text_alone(tmp_path, source):
    """Titles, words after an image and text that looks like one come back whole; bytes are equal."""
    a, b = png(3, 2), png(4, 4)
    text = f'# Pictures\n\nsee ![a]({images.data_uri(a)}) and more words here ![b]({images.data_uri(b)} "the title") end\n\n- ![a]({images.data_uri(a)})\n\n`{images.data_uri(b)} code` stays\n'
    (tmp_path / "in.md").write_text(text)
    V.convert_file(str(tmp_path / "in.md"), str(tmp_path / f"mid.{source}"))
    V.convert_file(str(tmp_path / f"mid.{source}"), str(tmp_path / "out" / "back.md"))
    want = text.replace(f"({images.data_uri(a)}", "(image/image1.png").replace(f"({images.data_uri(b)} ", "(image/image2.png ")
    assert (tmp_path / "out" / "back.md").read_text() == want
    assert [(tmp_path / "out" / "image" / f"image{k}.png").read_bytes() for k in (1, 2)] == [a, b]


@pytest.mark.parametrize("target", ["json", "yaml", "toml"])
def test_structured_files_hold_their_images(tmp_path, target):
    data = png(5, 2)
    (tmp_path / "in.md").write_text(f'x ![a]({images.data_uri(data)} "t") y\n\nnext\n')
    V.convert_file(str(tmp_path / "in.md"), str(tmp_path / "mid.docx"))
    V.convert_file(str(tmp_path / "mid.docx"), str(tmp_path / f"out.{target}"))
    assert not (tmp_path / "image").exists() and images.data_uri(data) in str(structured.load((tmp_path / f"out.{target}").read_text(), target))
    V.convert_file(str(tmp_path / f"out.{target}"), str(tmp_path / "back.md"))
    assert (tmp_path / "back.md").read_text() == 'x ![a](image/image1.png "t") y\n\nnext\n'


def test_image_sizes():
    assert images.size(png(7, 5)) == (7, 5) and images.size(b"GIF89a\x04\x00\x03\x00") == (4, 3) and images.size(b"junk") is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x09\x00\x08\x01\x01\x11\x00"
    assert images.size(jpeg) == (8, 9) and images.extension(jpeg) == "jpg"
    assert images.extent(png(10, 20), 9525 * 5, 9525 * 5) == (round(9525 * 2.5), 9525 * 5) and images.extent(png(2, 1), 10**9, 10**9) == (19050, 9525)


def test_presentations_have_what_they_need_to_open():
    data = through("# One\n\ntext\n\n# Two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n", "markdown", "pptx")
    files = packages.parts(data)
    need = ["[Content_Types].xml", "_rels/.rels", "docProps/app.xml", "docProps/core.xml", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "ppt/theme/theme1.xml"]
    need += [f"ppt/slide{k}s/{x}slide{k}1.xml{y}" for k in ("Master", "Layout") for x, y in (("", ""), ("_rels/", ".rels"))]
    need += [f"ppt/slides/{x}slide{n}.xml{y}" for n in (1, 2) for x, y in (("", ""), ("_rels/", ".rels"))]
    assert set(need) <= set(files)
    for name in files:  # every relationship leads to a part, and every part has a type
        if name.endswith(".rels"):
            base = name.replace("_rels/", "").removesuffix(".rels")
            for target in packages.relationships(files, base).values():
                assert target in files, (name, target)
    types = files["[Content_Types].xml"].decode()
    assert all(f'PartName="/{n}"' in types for n in files if n.endswith(".xml") and n != "[Content_Types].xml")


def test_slide_geometry():
    assert slides.text_height(["x"]) == slides.LINE_HEIGHT + 2 * slides.GAP and slides.text_height(["x" * 160, "y"]) == 4 * slides.LINE_HEIGHT + 2 * slides.GAP
    assert slides.table_height([["a\nb", "c"], ["d"]]) == 3 * slides.ROW_HEIGHT and slides.table_height([]) == slides.ROW_HEIGHT
    assert slides.image_extent(png(3, 2), 0) == (28575, 19050)
    width, height = slides.image_extent(png(4000, 100), slides.CONTENT_TOP)
    assert width == slides.CONTENT_WIDTH and height == round(100 * 9525 * slides.CONTENT_WIDTH / (4000 * 9525))


@pytest.mark.parametrize("fmt", ["pptx", "odp"])
def test_slides_are_stable(fmt):
    text = "# Title\n\nText\n\n- bullet\n\n| a | b |\n| --- | --- |\n| 1\\|2 | x |\n"
    once = through(text, "markdown", fmt, "markdown")
    assert through(once, "markdown", fmt, "markdown") == once and b"1\\|2" in once


def test_chart_points_become_a_table():
    c = 'xmlns:c="urn:c"'
    points = lambda *v: "".join(f'<c:pt idx="{k}"><c:v>{x}</c:v></c:pt>' for k, x in v)
    xml = f"<c:chart {c}><c:ser><c:tx>{points((0, 'Sales'))}</c:tx><c:cat>{points((0, 'Q1'))}</c:cat><c:val>{points((0, 1), (1, 2))}</c:val></c:ser></c:chart>"
    assert chart_rows(xml.encode()) == [["", "Sales"], ["Q1", "1"], ["2", "2"]]


def test_every_pair_has_a_plan():
    for a in V.DIRECT:
        for b in V.DIRECT:
            if a == b:
                with pytest.raises(V.ConversionError):
                    V.plan(a, b)
            else:
                stages = V.plan(a, b)
                assert stages[0] == a and stages[-1] == b
    assert V.plan("docx", "pptx") == ["docx", "markdown", "pptx"] and V.plan("doc", "csv") == ["doc", "docx", "csv"]


def test_every_supported_pair_runs():
    held = {"markdown": NOTED.encode()} | {f: through(NOTED, "markdown", f) for f in V.DIRECT if V.supported("markdown", f)}
    for a, data in held.items():
        for b in V.DIRECT:
            if V.supported(a, b):
                assert V.convert_bytes(data, a, b)


def test_no_table_is_not_implemented():
    with pytest.raises(V.ConversionError) as e:
        through("# only text\n", "markdown", "csv")
    assert e.value.code == "NotImplemented"


def test_dates_are_refused():
    data = packages.write_xlsx({"S": [["d"], [1]]})
    files = packages.parts(data)
    sheet = files["xl/worksheets/sheet1.xml"].replace(b'<c r="A2">', b'<c r="A2" t="d">')
    with pytest.raises(structured.DataError, match="data loss"):
        packages.read_xlsx(packages.package(files | {"xl/worksheets/sheet1.xml": sheet}))


def test_too_wide_sheets_are_refused():
    with pytest.raises(structured.DataError):
        packages.write_xlsx({"S": [[None] * 65_537]})


def test_files(tmp_path):
    source, out = tmp_path / "a.json", tmp_path / "deep" / "a.yaml"
    source.write_text(json.dumps(PEOPLE))
    V.convert_file(str(source), str(out))
    assert out.exists()
    with pytest.raises(V.ConversionError) as e:
        V.convert_file(str(source), str(out))
    assert e.value.code == "OutputExists"
    with pytest.raises(V.ConversionError):
        V.convert_file(str(source), str(source), V.Options(overwrite=True))


def test_columns_and_globs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.csv").write_text("x,y\n1\n")
    rows = {r["name"]: r for r in V.convert_files(spark, f"{tmp_path}/*.csv", "csv", "json").collect()}
    assert json.loads(rows["a.json"]["converted"]) == [{"x": "1"}] and rows["b.json"]["error"]["code"] == "InvalidInput"


def test_stream_of_files(spark, tmp_path):
    from docframe.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x\n1\n")
    q = files.write(files.arriving(spark, str(tmp_path / "in"), "csv", "markdown"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["converted"] == "| x |\n| --- |\n| 1 |"
