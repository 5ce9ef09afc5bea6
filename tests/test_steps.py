"""Documents that go through several formats in one pass, and tables in documents of bounded size."""

import json
import time

import duckdb
import pytest

from docframe.operators import markdown as M
from docframe.plans import convert as V
from docframe.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def test_one_pass(spark):
    df = spark.createDataFrame([(1, "# A\n\ntext\n"), (2, None), (3, "plain\n")], "k int, text string")
    steps = V.convert_steps(df, "text", ["markdown", "odt", "json", "markdown"], {2: "tree", 3: "back"})
    now = df
    for a, b, name in (("markdown", "odt", "x"), ("odt", "json", "tree")):
        now = V.convert_column(now, "text" if name == "x" else "x", a, b, output=name).drop("error")
    assert {r["k"]: r["tree"] for r in steps.collect()} == {r["k"]: r["tree"] for r in now.collect()}
    assert {r["k"]: r["back"] for r in steps.collect()} == {1: "# A\n\ntext\n", 2: None, 3: "plain\n"}
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    bad = V.convert_steps(spark.createDataFrame([("{",)], "text string"), "text", ["json", "yaml", "json"], {1: "a", 2: "b"}).collect()[0]
    assert bad["a"] is None and bad["b"] is None and bad["error"]["code"] == "InvalidInput"


@pytest.mark.parametrize("name", ["slides_odp", "document_chain", "markdown_odt_roundtrip"])
def test_round_trips_use_one_worker(spark, name):
    assert Q.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_volumes(spark, monkeypatch):
    """A nation's customers in documents of three rows are the same rows as in one document."""
    monkeypatch.setattr(Q, "VOLUME_ROWS", 3)
    df = Q.QUERIES["cells_through_json"](spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{DATA}/customer.parquet'")
    want = con.sql(Q.SQL["cells_through_json"]).select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize(("name", "workers"), [("package_elements", 1), ("package_parts", 1), ("package_relationships", 2)])
def test_packages_use_one_worker(spark, name, workers):
    """Packages are made, opened and parsed in one Python worker a task, which is what bounds an executor's memory."""
    assert Q.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == workers


@pytest.mark.parametrize("name", ["flagship", "markdown_nodes", "markdown_plain_text"])
def test_pages_use_one_worker(spark, name):
    """Pages become Markdown, trees and rows in one Python worker a task."""
    assert Q.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def _page(spark, tmp_path, html):
    spark.createDataFrame([(1, "u", "<p>fine</p>"), (2, "u", html)], "page_id int, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["document_chain", "markdown_docx_roundtrip", "markdown_html_roundtrip", "markdown_odt_roundtrip", "markdown_yaml_roundtrip", "slides_odp"])
def test_failed_page_is_no_result(spark, tmp_path, name):
    """A page that has no Markdown was null before and after its way, and so counted as kept."""
    folder = _page(spark, tmp_path, '<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr></table>')
    with pytest.raises(Exception, match="html to json: InvalidInput: colspan=2"):
        Q.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", ["document_chain", "markdown_docx_roundtrip", "markdown_odt_roundtrip"])
def test_failed_step_is_no_loss(spark, tmp_path, name):
    """A page whose package can't be read again counted as one that lost something."""
    with pytest.raises(Exception, match="InvalidInput"):
        Q.QUERIES[name](spark, _page(spark, tmp_path, "<p>a\x01b</p>")).collect()


def test_missing_page_is_kept(spark, tmp_path):
    rows = Q.QUERIES["markdown_yaml_roundtrip"](spark, _page(spark, tmp_path, None)).collect()
    assert {r["page_id"]: r["same"] for r in rows} == {1: True, 2: True}


def test_next_line_stays_in_yaml():
    """The writer in Python folded U+0085 into a blank."""
    text = '["a\\u0085", {"b\\u0085c": "\\ud83d\\ude00 \\u0085"}]'
    assert json.loads(V.convert_bytes(V.convert_bytes(text.encode(), "json", "yaml"), "yaml", "json")) == json.loads(text)


@pytest.mark.parametrize("name", ["document_chain", "markdown_yaml_roundtrip"])
def test_pages_are_spread(spark, name):
    """A table of pages in one group of rows went through all formats in one task."""
    assert Q.QUERIES[name](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_long_paragraph_takes_no_square():
    """Each blank copied what followed it."""
    seconds = []
    for n in (20_000, 200_000):
        began = time.process_time()
        assert M.parse_inlines("word " * n) == [{"type": "text", "text": "word " * n}]
        seconds.append(time.process_time() - began)
    assert seconds[1] < 30 * max(seconds[0], 0.01)
