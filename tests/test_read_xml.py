"""Parts of packages as structs of a shape, and lookups and themes that are read so."""

import pytest

from docframe.operators import parts as P
from docframe.operators import taken_themes as K

SHAPE = "struct<_n: int, item: array<struct<_id: string, _size: double, on: struct<_val: string>>>, last: struct<_val: string>>"


def test_read_xml(spark):
    xml = "<a:r xmlns:a='u' a:n='7'><a:item b:id='x' xmlns:b='v' size='1.5'><on/></a:item><other><item/></other><item id=' y ' size='z'/><last val='1'/><last val='2'/></a:r>"
    rows = [(k, data) for k, data in enumerate([xml.encode(), b"<r n='99999999999'/>", b"<r>", None, xml.encode()])]
    got = {r["k"]: r["x"] and r["x"].asDict(True) for r in P.read_xml(spark.createDataFrame(rows, "k int, bytes binary"), ["k"], SHAPE).collect()}
    full = {"n": 7, "item": [{"_id": "x", "_size": 1.5, "on": {"_val": None}}, {"_id": " y ", "_size": None, "on": None}], "last": {"_val": "2"}}
    full["_n"] = full.pop("n")
    assert got == {0: full, 1: {"_n": None, "item": None, "last": None}, 2: None, 3: None, 4: full}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [lambda p: P.numbering(p, ["k"])[1], lambda p: P.cell_formats(p, ["k"]), lambda p: P.theme_colors(p, ["k"]), lambda p: P.relationships(p, ["k"]), lambda p: K.theme_fonts(p, ["k"], "t")])
def test_no_parser_by_row(spark, made):
    """from_xml takes milliseconds a part, so lookups over a million parts never end with it."""
    parts = spark.createDataFrame([(1, "a/numbering.xml", b"<x/>")], "k int, part string, bytes binary")
    assert "xml" not in _plan(made(parts)).lower().replace("run(", "").replace(".xml", "").replace("[.]xml", "")


def test_walked():
    """Chains of any length, one that ends nowhere, and rings: each style has the nearest value above it, its own first."""
    styles = [{"id": f"s{k}", "up": f"s{k - 1}", "a": k if k % 1000 == 0 else None, "b": None} for k in range(5000)]
    styles += [{"id": n, "up": up, "a": a, "b": b} for n, up, a, b in (("x", "y", None, 1), ("y", "z", 2, None), ("z", "x", 3, None), ("t", "x", None, None), ("u", "gone", None, 5))]
    got = {s["id"]: (s["open"], s["a"], s["b"]) for s in K._walked(styles, ["a", "b"])}
    assert all(got[f"s{k}"] == (False, k // 1000 * 1000, None) for k in range(5000))
    assert {k: got[k] for k in "xyztu"} == {"x": (True, 2, 1), "y": (True, 2, 1), "z": (True, 3, 1), "t": (True, 2, 1), "u": (False, None, 5)}


def test_first_cells(spark):
    """Only the first rows with cells are kept, whatever their order of ends; repeats count, and rows lend their style."""
    rows = "".join(f"<r s='{k}'>" + ("" if k == 1 else "<c/><c s='9' n='3'/><c s='9' n='x'/>") + "</r>" for k in range(40))
    parts = spark.createDataFrame([(1, "a.xml", f"<t>{rows}</t>".encode()), (2, "b.xml", b"<t><r/></t>")], "k int, part string, bytes binary")
    got = sorted(map(tuple, P.first_cells(parts, ["k"], 3, ("c",), "s", "n", 100).collect()), key=str)
    assert got == [(1, row, s, of_row, n) for row, of_row in ((1, "0"), (2, "2"), (3, "3")) for s, n in (("9", 4), (None, 1))]
    assert P.elements(parts, ["k"], ("c",)).count() == 39 * 3


def test_children_once(spark):
    """Parts are read once for both sides of the join."""
    parts = spark.createDataFrame([(1, "a.xml", b"<t><c r='A1'><v>5</v></c><c r='A2'/></t>")], "k int, part string, bytes binary")
    found = P.children(P.elements(parts, ["k"]), ["k"], "c", "v")
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["parent_attributes"], r["text"]) for r in found.collect()] == [({"r": "A1"}, "5")]


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_definitions_and_first_cells_of_large_parts(spark, monkeypatch, most):
    """Parts read element by element give what those whose tree is held whole do."""
    monkeypatch.setattr(P, "WHOLE_BYTES", most)
    style = "<x:style x:name='a' x:family='f'><x:t x:size='1'><x:t x:size='9'/></x:t><x:c x:fill='2' x:other='3'/><x:t x:color='4'/></x:style>"
    rows = "<x:r/><x:r s='q'><y/><x:c s='p'/></x:r><x:r><x:c/><x:c s='p' n='3'/></x:r><x:r><x:c s='z'/></x:r>"
    xml = f"<x:root xmlns:x='urn:x'><x:late><x:style x:name='b'/></x:late>{style}<x:t x:size='7'/>{rows}</x:root>"
    parts = spark.createDataFrame([(1, "a.xml", xml.encode()), (2, "a.xml", xml.encode()), (3, "a.xml", b"<r/>")], "k int, part string, bytes binary")
    got = sorted(map(tuple, P.definitions(parts, ["k"], ("style",), ("name", "gone"), {"t": ("size", "color"), "c": ("fill",)}).collect()))
    want = [("a.xml", 2, "style", "b", None, None, None, None), ("a.xml", 3, "style", "a", None, "1", "4", "2")]
    assert got == [(k, *w) for k in (1, 2) for w in want]
    cells = sorted(map(tuple, P.first_cells(parts, ["k"], 2, ("c",), "s", "n", 100).where("k = 2 and row > 0").collect()), key=str)
    assert (2, 1, None, None, 1) in cells and (2, 2, "p", "q", 1) in cells
    with pytest.raises(Exception, match="a.xml: "):
        P.definitions(spark.createDataFrame([(1, "a.xml", b"<r><s>")], parts.schema), ["k"], ("s",), (), {}).collect()


def test_alike_packages_and_merged_definitions(spark):
    """Packages with the same styles are walked once and keep their own keys; a later definition takes the place of what it says."""
    rows = [(k, n, i, u, a, b) for k in range(600) for n, i, u, a, b in [(0, "x", None, "1", None), (1, "y", "x", None, "2"), (2, "x", None, None, str(k % 3)), (3, None, "y", "d", None)]]
    got = K._with_ancestors(spark.createDataFrame(rows, "k int, at int, id string, up string, a string, b string"), ["k"], ["a", "b"], merged=True).collect()
    assert sorted(((r["k"], r["id"] or "", r["a"], r["b"]) for r in got)) == sorted(x for k in range(600) for x in [(k, "", "d", None), (k, "x", "1", str(k % 3)), (k, "y", "1", "2")])
