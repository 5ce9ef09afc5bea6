"""Packages as rows, lookups with policies, styles, ragged records, and ordered work over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import inheritance as I
from docframe.operators import ordered as O
from docframe.operators import parts as P
from docframe.operators import relational as R
from docframe.sources import packages


@pytest.fixture(scope="module")
def many_ranges(spark):
    """Ranges of few rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_and_elements(spark):
    rows = [(1, packages.write_xlsx({"A": [["x"], [1]]})), (2, b"no package"), (3, None)]
    parts = P.package_parts(spark.createDataFrame(rows, "k long, content binary"), ["k"])
    assert {(r["k"], r["error"] is None) for r in parts.collect()} == {(1, True), (2, False), (3, False)}
    nodes = {(r["name"], r["element"], r["parent"], r["text"]): r["attributes"] for r in P.elements(parts, ["k"]).where("part like '%sheet1.xml'").collect()}
    assert nodes["worksheet", 0, None, None] == {}
    ((_, _, cell, _),) = [k for k in nodes if k[0] == "v" and k[3] == "1"]
    assert [v for k, v in nodes.items() if k[:2] == ("c", cell)] == [{"r": "A2"}]
    broken = spark.createDataFrame([(1, "a.xml", b"<a><b></a>")], "k long, part string, bytes binary")
    with pytest.raises(Exception, match="a.xml"):
        P.elements(broken, ["k"]).collect()


def test_relationships(spark):
    xml = b'<r:Relationships xmlns:r="x"><r:Relationship Id="a" Type="t/image" Target="../media/i.png"/><r:Relationship Id="b" Type="t/link" Target="http://e/../x" TargetMode="External"/><r:Relationship Id="c" Type="t/x" Target="/abs/./y.xml"/></r:Relationships>'
    parts = spark.createDataFrame([(1, "ppt/slides/_rels/s1.xml.rels", xml), (1, "ppt/slides/s1.xml", b"<x/>")], "k long, part string, bytes binary")
    got = [tuple(r)[1:] for r in P.relationships(parts, ["k"]).orderBy("rel_id").collect()]
    assert got == [("ppt/slides/s1.xml", "a", "image", "ppt/media/i.png", False), ("ppt/slides/s1.xml", "b", "link", "http://e/../x", True), ("ppt/slides/s1.xml", "c", "x", "abs/y.xml", False)]


def test_numbering(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"""<w:numbering {w}><w:abstractNum w:abstractNumId="10"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
      <w:abstractNum w:abstractNumId="20"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum>
      <w:num w:numId="42"><w:abstractNumId w:val="10"/></w:num><w:num w:numId="99"><w:abstractNumId w:val="20"/></w:num>
      <w:num w:numId="7"><w:abstractNumId w:val="20"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num><w:num w:numId="8"><w:abstractNumId w:val="77"/></w:num></w:numbering>"""
    parts = spark.createDataFrame([(1, "word/numbering.xml", xml.encode())], "k long, part string, bytes binary")
    items = spark.createDataFrame([(1, n, v) for n, v in (("42", 0), ("99", 0), ("99", 1), ("7", 0), ("7", 1), ("8", 0), ("nope", 0), ("99", 5), (None, 0))], "k long, num_id string, level int")
    got = {(r["num_id"], r["level"]): (r["format"], r["start"]) for r in P.list_levels(items, ["k"], *P.numbering(parts, ["k"])).collect()}
    assert got == {("42", 0): ("bullet", None), ("99", 0): ("decimal", 3), ("99", 1): ("lowerRoman", 1), ("7", 0): ("decimal", 5), ("7", 1): ("lowerRoman", 1), ("8", 0): (None, None), ("nope", 0): (None, None), ("99", 5): (None, None), (None, 0): (None, None)}


def test_policies(spark):
    refs = spark.createDataFrame([("a", "image"), ("x", "image"), ("x", "chart"), ("b", "slide")], "id string, kind string")
    targets = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, part string")
    got = P.resolved(refs, targets, ["id"], "kind", {"image": "drop", "chart": "keep", "slide": "error"})
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "image", "A"), ("b", "slide", "B"), ("x", "chart", None)]
    with pytest.raises(Exception, match="missing image x"):
        P.resolved(refs, targets, ["id"], "kind", {"image": "error"}).select(F.lit(1)).collect()
    with pytest.raises(ValueError, match="no policy maybe"):
        P.resolved(refs, targets, ["id"], "kind", {"image": "maybe"})


def _styles(spark, fonts="<font><sz val='10'/><name val='F'/><color theme='1' tint='-0.5'/></font>", xf="<xf fontId='0' fillId='0' borderId='0'/>"):
    xml = f"<styleSheet xmlns='s'><fonts>{fonts}</fonts><fills><fill><patternFill/></fill></fills><borders><border><left/></border></borders><cellXfs>{xf}</cellXfs></styleSheet>"
    theme = "<a:theme xmlns:a='a'><a:themeElements><a:clrScheme><a:dk1><a:srgbClr val='c08040'/></a:dk1></a:clrScheme></a:themeElements></a:theme>"
    parts = [(1, "xl/styles.xml", xml.encode()), (1, "xl/theme/theme1.xml", theme.encode())]
    return P.cell_formats(spark.createDataFrame(parts, "k long, part string, bytes binary"), ["k"])


def test_cell_formats(spark):
    assert _styles(spark).collect()[0].asDict() == {"k": 1, "style": 0, "font": "F", "size": 10.0, "bold": False, "italic": False, "color": "#604020", "fill": None, "border": None, "border_color": None, "align": None}
    with pytest.raises(Exception, match="missing font 1 4"):
        _styles(spark, xf="<xf fontId='4'/>").collect()
    with pytest.raises(Exception, match="tint must be"):
        _styles(spark, fonts="<font><color rgb='FF000000' tint='2'/></font>").collect()
    cells = spark.createDataFrame([(1, 1, 3)], "k long, sheet_row int, style int")
    with pytest.raises(Exception, match="missing cell format 1 3"):
        P.styled_cells(cells, cells.limit(0), _styles(spark), ["k"]).collect()


def test_ragged(spark):
    rows = [(1, '{"b": 1, "a": "x"}'), (2, '{"c": {"d": [1]}, "a": 1.5}'), (3, "{}"), (4, '{"a": true, "e": null, "b": 1e300}')]
    df = spark.createDataFrame(rows, "n long, j string").select("n", F.parse_json("j").alias("v"), F.lit("x").alias("key"))
    got = {(r["n"], r["place"], r["key"]): (r["kind"], r["text"]) for r in P.ragged_union(df.drop("key"), ["n"], "v").collect()}
    assert len(got) == 16 and {k[1:] for k in got} == {(1, "a"), (2, "b"), (3, "c"), (4, "e")}
    assert {k: v for k, v in got.items() if v[0] != "empty"} == {
        (1, 1, "a"): ("string", "x"), (1, 2, "b"): ("integer", "1"), (2, 1, "a"): ("float", "1.5"), (2, 3, "c"): ("string", '{"d":[1]}'), (4, 1, "a"): ("boolean", "true"), (4, 2, "b"): ("float", "1.0E300"),
    }
    with pytest.raises(Exception, match="rows must be objects"):
        P.ragged_union(spark.sql("SELECT 1L AS n, parse_json('[1]') AS v"), ["n"], "v").collect()


def _nearest(levels):
    return [max((j for j in range(k) if levels[j] is not None and levels[k] is not None and levels[j] < levels[k]), default=None) for k in range(len(levels))]


@pytest.mark.parametrize("seed", range(3))
def test_outlines_of_any_level(many_ranges, seed):
    rng = random.Random(seed)
    docs = {d: [rng.choice([None, rng.randrange(-3, 40)]) if rng.random() < 0.1 else rng.randrange(0, 12) for _ in range(n)] for d, n in ((0, 200), (1, 3), (None, 40))}
    docs[2] = [9, 10, 11]
    rows = [(d, k, lv, "t") for d, levels in docs.items() for k, lv in enumerate(levels)]
    df = many_ranges.createDataFrame(rows, "doc int, pos int, level int, parent_text string")
    got = {(r["doc"], r["pos"]): r["parent"] for r in O.outline_parents(df, ["doc"], "pos", "level").collect()}
    assert got == {(d, k): p for d, levels in docs.items() for k, p in enumerate(_nearest(levels))}
    numbers = {(r["doc"], r["pos"]): r["number"] for r in O.list_numbers(df, ["doc"], "pos", "level").collect()}
    for d, levels in docs.items():
        up = _nearest(levels)
        for k in range(len(levels)):
            assert numbers[d, k] == sum(levels[j] == levels[k] and up[j] == up[k] for j in range(k + 1))


def test_sums_and_last_values_over_ranges(many_ranges):
    rng = random.Random(1)
    rows = [(rng.choice([1, None, 2]), k, rng.choice([None, None, k]), rng.randrange(5)) for k in range(300)]
    df = many_ranges.createDataFrame(rows, "g int, k int, v int, n int")
    last = {r["k"]: r["last"] for r in O.last_known(df, ["g"], "k", F.col("v"), "last").collect()}
    total = {r["k"]: r["total"] for r in O.sum_before(df, ["g"], "k", F.col("n"), "total").collect()}
    for g, k, _, _ in rows:
        own = [r for r in rows if r[0] == g and r[1] <= k]
        assert last[k] == next((r[2] for r in reversed(own) if r[2] is not None), None)
        assert total[k] == sum(r[3] for r in own[:-1])


def _resolve(styles):
    out = {}
    for s in styles:
        seen, at, size = [], s, None
        while at in styles and at not in seen:
            seen.append(at)
            size = styles[at][1] if size is None else size
            at = styles[at][0]
        out[s] = (size, len(seen) - 1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_inheritance_with_rings_and_tails(spark, seed):
    rng = random.Random(seed)
    n = 60
    styles = {k: (rng.randrange(n + 5) if rng.random() < 0.9 else None, rng.choice([None, None, k])) for k in range(n)}
    df = spark.createDataFrame([(k, p, s) for k, (p, s) in styles.items()], "style int, parent int, size int")
    assert {r["style"]: (r["size"], r["depth"]) for r in I.inherited(df, ["size"]).collect()} == _resolve(styles)


def test_long_chain_and_defaults(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id AS style", "if(id = 0, null, id - 1) AS parent", "if(id % 1000 = 500, id, null) AS size", "cast(null AS string) AS font")
    rows = {r["style"]: tuple(r)[1:] for r in I.cascaded(df, ["size", "font"], {"font": F.lit("Body")}).where("style % 1777 = 0 or style > 19990").collect()}
    assert all(v == ((k - 500) // 1000 * 1000 + 500 if k >= 500 else None, "Body", k) for k, v in rows.items())


def test_merged_cells_of_the_format(spark):
    """A wide cell, a tall one, a merge that a plain cell ends, and a continued cell with nothing above."""
    rows = [(0, 0, 2, None), (0, 1, 1, "restart"), (1, 0, 1, "restart"), (1, 1, 1, "continue"), (1, 2, 1, "continue"), (2, 0, 1, "continue"), (2, 1, 2, None), (3, 0, 1, "continue"), (3, 1, 1, "continue"), (3, 2, 1, "continue")]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc int, r int, c int, span int, merge string")
    got = {(r["r"], r["c"]): (r["column"], r["colspan"], r["rowspan"]) for r in O.merged_cells(df, ["doc"], "r", "c", "span", "merge").collect()}
    assert got == {(0, 0): (0, 2, 1), (0, 1): (2, 1, 2), (1, 0): (0, 1, 3), (1, 1): (1, 1, 1), (2, 1): (1, 2, 1), (3, 1): (1, 1, 1), (3, 2): (2, 1, 1)}


def test_runs_and_diff_of_nothing(spark):
    runs = spark.createDataFrame([], "doc int, k int, repeat int, cells array<struct<value:string,repeat:int>>")
    assert O.expand_runs(runs, ["doc"], "k").collect() == []
    one = spark.createDataFrame([(1, 5, "a")], "doc int, k int, t string")
    assert [tuple(r) for r in O.positional_diff(one, one.limit(0), ["doc"], "k", "t").collect()] == [(1, 1, "a", None, "removed", True)]


def test_ranges_need_no_rows(spark):
    assert R.ranged(spark.createDataFrame([], "k int"), ["k"]).collect() == []
