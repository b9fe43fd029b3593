import pytest
from pyspark.sql import functions as F

from tidemill.functions import markup as M

PAGE = """<!doctype html><html><head><title>T &amp; U</title><script>var t="</p>";</script></head><body id=main>
<p class="a b">one<p class="b" lang="en-GB">two <b>bold</b><ul><li>x<li data-k="v1">y<li>z</ul><!-- c --><br><div><p>in</p></div></body></html>"""


@pytest.mark.parametrize(("selector", "want"), [
    ("p", ["one", "two bold", "in"]), ("p.a.b", ["one"]), ("#main > p", ["one", "two bold"]), ("body p.b b", ["bold"]), ("p + p", ["two bold"]), ("p ~ ul li:nth-child(2)", ["y"]),
    ("li:first-child, li:last-child", ["x", "z"]), ("[lang|=en]", ["two bold"]), ("[data-k^=v]", ["y"]), ("[data-k$='1']", ["y"]), ("[class~=a]", ["one"]), ("li:not([data-k])", ["x", "z"]),
    ("li:nth-child(odd)", ["x", "z"]), ("li:nth-last-child(1)", ["z"]), (":is(title, b)", ["T & U", "bold"]), ("p:nth-of-type(2)", ["two bold"]), ("div *", ["in"]), ("b:only-child", ["bold"]),
])
def test_selectors(selector, want):
    assert [n.text().strip() for n in M.Selector(selector).all(M.parse_html(PAGE))] == want


def test_columns(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    rows = {r.id: r for r in df.select("id", M.html_text(F.col("html")).alias("t"), M.query_selector_all(F.col("html"), "li").alias("li"), M.rewrite_html(F.col("html"), "p.a", "remove").alias("w")).collect()}
    assert "var t" in rows[1].t and " c " not in rows[1].t and rows[2].t is None
    assert [x.text for x in rows[1].li] == ["x", "y", "z"] and rows[1].li[1].attrs == {"data-k": "v1"} and rows[3].li == []
    assert "one" not in rows[1].w and "two" in rows[1].w


XML = '<r xmlns:n="u"><a k="1"><b>x</b><b>y</b></a><n:a k="2"><b>z</b></n:a></r>'


@pytest.mark.parametrize(("path", "want"), [
    ("/r/a/b", ["x", "y", "z"]), ("//b", ["x", "y", "z"]), ("/r/a[@k='2']/b", ["z"]), ("/r/a[2]", ["z"]), ("/r/*/@k", ["1", "2"]), ("//b[1]", ["x", "z"]), ("/r/a[b='y']/@k", ["1"]), ("//b/parent::a/@k", ["1", "2"]), ("//a/following-sibling::a", ["z"]), ("/r/a/b/text()", ["x", "y", "z"]), ("/r/a/b/..", ["xy", "z"]),
])
def test_paths(path, want):
    assert M.xpath_select(XML, path) == want
