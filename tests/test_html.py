import pytest

from docframe.operators import html as H

CASES = [
    ("<title>T</title><h2>A</h2><p>x<br>y</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table><hr>", "## A\n\nx  \ny\n\n| a |\n| --- |\n| 1 |\n\n---\n"),
    ('<p title="é">Visible text</p>', "Visible text\n"),
    ("<script>var a = '</script>';</script><p>Preserved</p>", "Preserved\n"),
    ("<div>lost</div><p>kept</p><p>never closed", "kept\n"),
    ("<ol start=3><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "    - b\n3. a\n4. c\n"),
    ("<p>&amp;lt; &#65;&#x42; &middot;</p>", "&lt; AB &middot;\n"),
    ('<p><a href="a b(1)">x</a> <a href="">y</a><a id="n"></a></p>', '[x](<a b(1)>) y<a id="n"></a>\n'),
    ("<ul><li><input type=checkbox checked>done</li></ul>", "- [x] done\n"),
    ('<pre><code class="language-py">a *b*</code></pre>', "```py\na *b*\n```\n"),
    ("<blockquote><p>a<br>b</p></blockquote>", "> a  \n> b\n"),
    ('<p>x<sup class="footnote-reference"><a href="#n">1</a></sup></p><div class="footnote-definition" id="n"><p>note</p></div>', "x[^n]\n\n[^n]: note"),
    ("", ""),
    ("<h1>One</h1><h6>Six</h6>", "# One\n\n###### Six\n"),
    ("<p>a<em>b</em><strong>c</strong><i>d</i><b>e</b></p>", "a*b***c***d***e**\n"),
    ("<p><del>x</del> <s>y</s> <u>z</u></p>", "~~x~~ ~~y~~ <u>z</u>\n"),
    ("<p>H<sub>2</sub>O x<sup>2</sup></p>", "H$_{2}$O x$^{2}$\n"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n    - c\n- b\n"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b\n"),
    ("<ul><li>a<ol start='5'><li>n</li></ol></li></ul>", "    5. n\n- a\n"),
    ("<ul><li><p>x</p><p>y</p></li></ul>", "- xy\n"),
    ('<ul><li><input type="checkbox"/>t</li></ul>', "- [ ] t\n"),
    ("<p>a<br/>b<br>c</p>", "a  \nb  \nc\n"),
    ("<p>a   b\n c</p>", "a b c\n"),
    ("<p>  lead</p>", "lead\n"),
    ("<hr/><p>x</p>", "---\n\nx\n"),
    ("<pre>a\n  b</pre>", "```\na\n  b\n```\n"),
    ("<pre><code>x &lt; y</code></pre>", "```\nx < y\n```\n"),
    ("<blockquote><p>q1</p><p>q2</p></blockquote>", "> q1\n\n> q2\n"),
    ("<blockquote><blockquote><p>deep</p></blockquote></blockquote>", "> > deep\n"),
    ("<table><tr><th>h|1</th><th>h2</th></tr><tr><td>a</td><td></td></tr></table>", "| h\\|1 | h2 |\n| --- | --- |\n| a |  |\n"),
    ("<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table>", "| a |\n| --- |\n| 1 |\n| 2 |\n"),
    ("<p><img src='a b.png' alt='x'></p>", "![x](<a b.png>)\n"),
    ("<p><a name='n'>t</a></p>", '<a id="n"></a>t\n'),
    ("<p>&copy;&mdash;&hellip;&unknown;</p>", "\u00a9\u2014\u2026&unknown;\n"),
    ("<!-- c --><p>x<!-- d -->y</p>", "xy\n"),
    ("<!DOCTYPE html><p>x</p>", "x\n"),
    ("<p>a*b_c[d]</p>", "a\\*b\\_c\\[d\\]\n"),
    ("<h2>a <em>b</em></h2>", "## a *b*\n"),
    ("<ul><li></li><li>x</li></ul>", "- x\n"),
    ("<P>UPPER</P><p>x</P>", "UPPER\n\nx\n"),
    ("<div>lost<p>in div</p>lost</div>", "in div\n"),
    ("<style>p{}</style><p>s</p>", "s\n"),
    ('<p><span class="math math-inline">x^2</span></p>', "$x^2$\n"),
]


@pytest.mark.parametrize("source,expected", CASES)
def test_markdown(source, expected):
    assert H.to_markdown(source) == expected


@pytest.mark.parametrize("source", ["<!-- open", "<script>open", "<style>open", "<table><tr><td colspan=2>x</td></tr></table>"])
def test_errors(source):
    with pytest.raises(H.HtmlError):
        H.to_markdown(source)


def test_rows_carry_errors(spark):
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, "<!-- open"), (3, None)], "id int, html string")
    assert sorted(map(tuple, H.markdown_of(df, ["id"]).select("id", "markdown", "error").collect())) == [(1, "a\n", None), (2, None, "a comment at 0 is not closed"), (3, None, None)]


def test_any_number_of_open_blocks():
    assert H.to_markdown("<p>lost" * 5000 + "<p>kept</p>") == "kept\n"
    assert H.to_markdown("<ul><li>a" * 300 + "</li></ul>" * 300).startswith("    " * 299 + "- a\n")
    with pytest.raises(H.HtmlError, match="nesting"):
        H.to_markdown("<p>" + "<b>" * 5000 + "x</p>")
