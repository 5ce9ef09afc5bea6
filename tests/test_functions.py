import pytest
from pyspark.sql import functions as F

from docframe.functions import cells as C
from docframe.functions import text as X
from docframe.operators import inheritance as I
from docframe.operators import ordered as O
from docframe.operators import relational as R
from docframe.operators import tables as T

CASES = [
    (X.strip_tags, "a<b>c</b> &lt;x&gt; <open", "ac <x> "),
    (X.heading_anchor, " Über  uns -- 2! ## ", "über-uns-2"),
    (X.heading_anchor, "!!", None),
    (X.slugify, "A  b_c--D!", "a-b_c-d"),
    (X.link_destination, "a b>", "<a b\\>>"),
    (X.link_destination, "a)\\", "a\\)\\\\"),
    (X.code_fence, "a ```` b", "`````"),
    (X.markdown_unescape, "\\*a\\_\\x", "*a_\\x"),
    (X.collapse_whitespace, "a  \n b", "a b"),
    (X.textual_list_item, "1.2.3. deep", "        3. deep"),
    (X.textual_list_item, "1) x", "1. x"),
    (X.textual_list_item, "1. plain", None),
    (X.textual_list_item, "*1. x*", "1. *x*"),
    (X.pageref_target, "x pageref _Toc1 \\h", "_Toc1"),
    (X.file_format, "a.XLSM", "xlsx"),
    (X.file_format, "a.tsv", None),
    (X.xml_attribute_escape, "<'\"&>", "&lt;&apos;&quot;&amp;&gt;"),
    (X.base64_text, "x" * 80, "eHh4" * 26 + "eHg="),
    (C.json_kind, " 12 ", "integer"),
    (C.json_kind, "1e2", "float"),
    (C.json_kind, '{"a": 1}', "string"),
    (R.resolve_part, "/ppt/./slides/../media/a.png", "ppt/media/a.png"),
]


@pytest.mark.parametrize("function,given,expected", CASES)
def test_text(spark, function, given, expected):
    assert spark.createDataFrame([(given,)], "x string").select(function(F.col("x"))).first()[0] == expected


@pytest.mark.parametrize("value,text", [(3.0, "3"), (1e20, "1E20"), (0.5, "0.5"), (-2.0, "-2"), (1.25e-5, "0.0000125")])
def test_float_text(spark, value, text):
    got = spark.createDataFrame([(value,)], "x double").select(C.float_text(F.col("x"))).first()[0]
    assert got == text or value == 1e20 and got.startswith("1" + "0" * 20)


def test_roman(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 4, 1994, 3999, 4000)], "n int").select(X.roman_number(F.col("n"))).collect()]
    assert got == ["0", "iv", "mcmxciv", "mmmcmxcix", "4000"]


def test_row_cells(spark):
    got = spark.createDataFrame([("| a\\|b | c\\\\ | d<br>e ||",)], "x string").select(T.row_cells(F.col("x"))).first()[0]
    assert got == ["a|b", "c\\", "d\ne"]


def test_inheritance_ends_in_cycles(spark):
    styles = spark.createDataFrame([("a", "b", None), ("b", "a", 7), ("c", None, 1)], "style string, parent string, size int")
    got = {r["style"]: r["size"] for r in I.inherited(styles, ["size"]).collect()}
    assert got == {"a": 7, "b": 7, "c": 1}


def test_list_numbers_reset(spark):
    items = spark.createDataFrame([(1, k, l) for k, l in enumerate([0, 1, 1, 0, 1])], "doc int, pos int, level int")
    assert [r["number"] for r in O.list_numbers(items, ["doc"], "pos", "level").orderBy("pos").collect()] == [1, 1, 2, 2, 1]
