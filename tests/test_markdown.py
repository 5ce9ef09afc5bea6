import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.operators import markdown as M
from docframe.operators import nodes as N
from docframe.sources import structured as S

#: One of everything that a tree can hold, in the form that rendering gives.
WHOLE = """# Harbour log

Tide **high**, wind *north*, ~~fog~~, <u>calm</u>, `knots`, [chart](https://harbour.example/map "the chart").

Area in m$^{2}$ and CO$_{2}$ levels[^depth]. Mark <a id="pier"></a>pier and ![buoy](photo/buoy.png "a buoy").

- [x] moor
    - check ropes
- [ ] refuel

3. First watch
4. Second watch

| **Ship** | Crew |
| :--- | ---: |
| Orca | 12 |

```python
speed = 7
```

> Keep left.

---

$$
E = mc^2
$$

[^depth]: Measured at noon.

    Twice.
"""
#: The same with a note inside the text, which formats without such notes put at the end.
NOTED = WHOLE.replace("> Keep left.\n", "> Keep left.\n\nSeen^[by the **mate**].\n")


@pytest.mark.parametrize("text", [WHOLE, NOTED, "5. five\n6. six\n\n- outer\n    - inner\n", "a\\*b \\[c\\]\n", "- a\n\n    b\n", "> > deep\n"])
def test_parse_and_render_are_inverse(text):
    assert M.render(M.parse(text)) == text


def test_lists_keep_numbers():
    block = M.parse("5. five\n6. six\n")[0]
    assert block["start"] == 5 and [i["number"] for i in block["items"]] == [5, 6]


def test_notes_in_fences_stay_code():
    code, paragraph = M.parse("~~~text\nkeep ^[this] as it is\n~~~\n\nSeen^[by the *crew*] today.\n")
    assert code["code"] == "keep ^[this] as it is" and any(i["type"] == "footnote" for i in paragraph["content"])


def test_depth_is_bounded():
    with pytest.raises(M.MarkdownError, match="nesting exceeds"):
        M.parse("> " * 130 + "deep\n")


def test_legacy_text_comes_before_content():
    assert M.render([{"type": "paragraph", "text": "Old *words* ", "content": [{"type": "text", "text": "and new"}]}]) == "Old *words* and new\n"


def test_tables_only():
    assert M.render(M.tables_only(M.parse(WHOLE))) == "| **Ship** | Crew |\n| :--- | ---: |\n| Orca | 12 |\n"
    assert M.tables_only(M.parse("- x\n\n> | a |\n> | --- |\n> | b |\n"))[0]["type"] == "quote"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cc", "Zl", "Zp", "Zs"]), max_size=8), min_size=2, max_size=2), min_size=1, max_size=4))
def test_table_text_and_parse_are_inverse(rows):
    from docframe.operators.html import table_text

    rows = [[c.replace("<br>", "") for c in r] for r in [["h", "k"], *rows]]
    assert S.parse_table(table_text(rows)) == rows


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(whitelist_categories=["Lu", "Ll", "Nd"], whitelist_characters="*_`[]~<>\\ "), min_size=1, max_size=30))
def test_escaped_text_comes_back(text):
    text = " ".join(text.split()) or "x"
    assert M.plain(M.parse_inlines(M._escaped(text))) == text


def test_ragged_tables_are_errors():
    with pytest.raises(S.DataError, match="row 3 has 3 cells; expected 2"):
        S.parse_table("| a | b |\n| --- | --- |\n| 1 | 2 | 3 |")


def test_node_rows(spark):
    df = spark.createDataFrame([(1, NOTED), (2, None)], "id int, markdown string")
    nodes = N.of_markdown(df, ["id"])
    kinds = {(r["scope"], r["kind"]) for r in nodes.collect()}
    assert {("block", "table"), ("table_cell", "table_cell"), ("inline", "footnote"), ("list_item", "list_item")} <= kinds
    kept = {r["kind"] for r in N.tables_only(nodes, ["id"]).where("scope = 'block'").collect()}
    assert kept == {"table"}
