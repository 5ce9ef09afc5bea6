"""Main text of pages: planted templates, broken markup, and the given pages against what their source says."""

import html
import re

import pytest

from docframe.llm import articles

from .helpers import words

P1 = "The council met on Tuesday, and after a long debate it voted to keep the old bridge open until spring."
P2 = "Engineers had warned that the piers were weak; still, most members said, the detour would cost far more."
P3 = "Short end."
BODY = f"<h1>Bridge stays</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = f"Bridge stays\n\n{P1}\n\n{P2}\n\n{P3}"
LINKS = "".join(f"<li><a href='/{k}'>Section number {k} of this site</a></li>" for k in range(9))
AD = "Buy two, get one free, today only: our best shoes, our best hats, all colours, all sizes, and free delivery too."

TEMPLATES = {
    "article": f"<body><header><div>Daily Post, since 1900, all the news, every day</div></header><nav><ul>{LINKS}</ul></nav><article>{BODY}</article><aside><p>{AD}</p></aside><footer><p>All rights reserved, 2024. Terms, privacy, contact.</p></footer>",
    "main": f"<body><div class='top-bar'>{AD}</div><main><div class='ad-slot'>{AD}</div>{BODY}<form><label>Your mail</label><input></form></main>",
    "divs": f"<body><div id='wrap'><div id='menu'><ul>{LINKS}</ul></div><div id='content'>{BODY}</div><div id='sidebar'><p>{AD}</p></div><div class='footer'>Imprint, contact, and so on.</div></div>",
    "plain divs": f"<body><div><ul>{LINKS}</ul></div><div class='x1'>{BODY}</div>",
    "comments": f"<body><article>{BODY}<section id='comments'><h2>12 comments</h2><p>{AD}</p><article class='comment'><p>{AD}</p></article></section></article>",
    "comments after": f"<body><article>{BODY}</article><div class='comment-list'><p>{AD}</p><p>{P2}</p></div>",
    "notice": f"<body><div class='cookie-notice' role='dialog'><p>{AD} {AD}</p></div><div class='post'>{BODY}</div>",
    "open nav": f"<body><nav><ul>{LINKS}<article>{BODY}</article>",
    "menu inside": f"<body><article><ul>{LINKS}</ul>{BODY}</article>",
    "hidden": f"<body><article><p hidden>{AD}</p><p style='display: none'>{AD}</p><div aria-hidden='true'>{AD}</div>{BODY}<script>if (a < b) document.write('<p>x</p>')</script><style>p > b {{}}</style><!-- <p>{AD}</p> --></article>",
    "table": f"<body><table><tr><td><ul>{LINKS}</ul></td><td>{BODY}</td></tr></table>",
    "header inside": f"<body><article><header><h1>Bridge stays</h1></header><p>{P1}</p><p>{P2}</p><p>{P3}</p><footer>Filed under: towns</footer></article>",
    "teasers": f"<body><main>{BODY}</main><div><article><h3>Other news</h3><p>Read more here.</p></article></div>",
    "attributes": f"<body data-x=\"a > b\"><article title='1 > 0'>{BODY}</article><footer class=x>{AD}",
}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates(name):
    assert articles.main_text(f"<!DOCTYPE html><html><head><title>Bridge stays - Daily Post</title></head>{TEMPLATES[name]}") == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<html></html>", ""),
        ("<nav><a href=x>One, two, three.</a></nav><footer>Text, and more.</footer>", ""),
        ("just text, no tags.", "just text, no tags."),
        ("<article><p>a &lt;b&gt; &amp;amp; &#228;&eacute;&copy &nbsp;x</p></article>", "a <b> &amp; äé© x"),
        ("<article><p> one\n\ttwo  <b>three</b>four </p>  <p></p></article>", "one two threefour"),
        ("<article><p><b>one<br><p>two</article>", "one\n\ntwo"),
        ("<article><p>one<br>two</p>", "one two"),
        ("<article><ul><li>first, yes<li>second</ul><table><tr><td>a<td>b</table>", "first, yes\n\nsecond\n\na\n\nb"),
        ("<article><p>cut off, in a tag <a hre", "cut off, in a tag"),
        ("<article><p>before</p><!-- never closed <p>after</p>", "before"),
        ("<article><p>before</p><script>never closed <p>after</p>", "before"),
        ("<article><p>a < b and 5 > 3</p></article>", "a < b and 5 > 3"),
        ("</p></div><article>x</b></article></article>", "x"),
    ],
)
def test_markup(page, want):
    assert articles.main_text(page) == want


def test_deep_and_long():
    import random

    text = words(random.Random(1), 50_000)
    assert articles.main_text(f"<article>{'<div>' * 3000}<p>{text}</p>") == text
    many = [f"{words(random.Random(k), 5)}, {k}." for k in range(5000)]
    assert articles.main_text("<main>" + "".join(f"<p>{m}" for m in many)) == "\n\n".join(many)
    assert articles.main_text("<p a='" + "<" * 20_000) == ""


def test_paths():
    page = articles._Page(f"<body><ul>{LINKS}</ul><div>{BODY}</div>")
    content = articles.content_paths(page)
    chosen = {t.text for t in page.texts if t.node.path in content}
    assert {P1, P2} <= chosen and not any("Section" in t for t in chosen)


def _source(page):
    """What the given pages' one template says, by its own marks."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", "\n"))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: _source(r["html"]) for r in pages.collect()}
    rows = articles.articles(pages, ["page_id", "url"]).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want and len(rows) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None, "k"), (2, "u", "", "k"), (3, "u", TEMPLATES["article"], "k"), (3, "u", TEMPLATES["article"], "k"), (None, None, "<p>x, y.</p>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in articles.articles(df, ["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (3, WANT, len(WANT)), (3, WANT, len(WANT)), (None, "x, y.", 5)], key=str)
    assert articles.articles(df.limit(0), ["page_id", "url"]).columns == ["page_id", "url", "text", "n_chars"]
    assert articles.articles(df.limit(0), ["page_id"]).collect() == []
