"""Pages as Markdown, by fixed pages."""

import pytest

from recordlens.functions.markdown import convert, pages_markdown

PAGES = [
    ("<h1>Harbour <b>news</b></h1><p>One&nbsp;&amp; two<br>three</p><!-- gone --><script>x < 1</script>", "# Harbour **news**\n\nOne & two\nthree"),
    ("<ul><li>a<ul><li>b<ol><li>c</li></ol></li><li>d</li></ul></li><li>e</ul>after", "- a\n  - b\n    - c\n  - d\n- e\n\nafter"),
    ("<ul><li>one<li>two <i>too</i></ul>", "- one\n- two *too*"),
    ("<table><tr><th>k</th><th>v</th></tr><tr><td>a <b>b</b></td><td><table><tr><td>x</td><td>y</td></tr></table></td></tr></table>", "| k | v |\n| a **b** | | x | y | |"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "| 1 | 2 |\n| 3 |"),
    ('See <a href="/a?b=1&amp;c">the <em>page</em></a>, <a href="/n"></a> and <a name="x">no link</a>.', "See [the *page*](/a?b=1&c), [/n](/n) and no link."),
    ('<p>Run <code>ls -l</code>:</p><pre>if x:\n    y()\n\n&lt;z&gt;</pre>', "Run `ls -l`:\n\n```\nif x:\n    y()\n\n<z>\n```"),
    ('<img src="a.png" alt=" A  cat "><img src="b.png">', "![A cat]![image]"),
    ("<b> spaced </b>word<b></b><i>\n</i>", "**spaced** word"),
    ("<div><div><p>a</p></div></div><noscript>no</noscript><template><p>t</p></template><p>b", "a\n\nb"),
    ("<p>unclosed <b>bold <i>both</p><p>next", "unclosed **bold *both\n\nnext***"),
    ("</b></li>stray</table>", "stray"),
    ("a < b &lt;c&gt; &#169; &unknown;", "a < b <c> © &unknown;"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html, want", PAGES)
def test_pages(html, want):
    assert convert(html)[0] == want


def test_without_links():
    assert convert('<a href="/x">y</a> z', keep_links=False)[0] == "y z"


def test_title_links_and_assets(spark):
    html = '<html><head><title> The\n page </title><link href="s.css"><script src="j.js"></script></head><body><a href="/1">one</a><noscript><a href="/2">two</a></noscript><img src="i.png"><a href="/3"><b>th</b>ree</a></body></html>'
    r = pages_markdown(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].markdown, [tuple(x) for x in r[0].links], r[0].assets) == ("The page", "[one](/1)![image][**th**ree](/3)", [("/1", "one"), ("/3", "**th**ree")], ["s.css", "j.js", "i.png"])
    assert (r[1].title, r[1].markdown, r[1].links, r[1].assets) == (None, "", [], [])


def test_deep_and_long_pages():
    assert convert("<div>" * 5000 + "x" + "</div>" * 5000)[0] == "x"
    assert convert("<p>word word</p>" * 50_000)[0].count("word word") == 50_000
    assert convert("<b>" * 1500 + "x")[0].count("x") == 1


def test_title_source(spark):
    html = ["<title> a &lt; b&amp;&amp \n c</title>", "<head><script><title>no</title></script>\n<TITLE class='x'>\nyes &quot;</TITLE ></head><svg><title>later</title></svg>", "<title>open", "<title></title><title>second</title>", None]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1)
    got = [r.title_source for r in pages_markdown(rows).orderBy("page_id").collect()]
    assert got == ["a &lt; b&amp;&amp c", "yes &quot;", None, "", None]
