"""Main text of pages of many shapes; importance of merged elements."""

import html
import math
import re

import pytest
from fixtures import SMALL, none_of
from pyspark.sql import functions as F

from ticketscope.llm import extraction
from ticketscope.llm.extraction import main_text

SHAPES = {
    "<p>a  b\n c</p><p>d&amp;e&nbsp;f &lt;g&gt; &#233;</p>": "a b c\nd&e f <g> é",
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><article><h1>T</h1><p>x<p>y<b>z<br>w</article><footer>f</footer>": "T\nx\nyz w",
    "<nav>n</nav><header>site</header><main><p>m</p><aside>s</aside></main><div>late</div>": "m",
    "<article><header><h1>Title</h1><p>By me</p></header><p>x</p><section class='comments'><p>reader</p></section></article>": "Title\nx",
    "<article><p>x</p><div id='comments'><article class='comment'><p>c</p></article></div></article>": "x",
    "<div class='post-header'><h1>T</h1></div><div class='entry-content'><p>x</p></div><div class='sidebar-left'>s</div><div class='cookie-notice'>c</div>": "T\nx",
    "<body class='has-sidebar'><div class=ad>a</div><p>x</p><form><p>f</p><input></form><div role='navigation'>n</div>": "x",
    "<p>x <a href='y>z'>link</a></p><!-- > <p>no</p> --><p hidden>h</p><p style='display: none'>d</p><div aria-hidden='true'>i</div>": "x link",
    "<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>": "one\ntwo\na b\nc",
    "plain < text & more": "plain < text & more",
    "<article></article><main> </main><p>x</p>": "x",
    "<p>x</p><script>never closed": "x",
    "<p>x</p><!-- never closed <p>y</p>": "x",
    "<a title=\"open>x</a> y": "x y",
    "<ARTICLE><P>Upper</P></ARTICLE><DIV>no</DIV>": "Upper",
    "</div></p>x</b>": "x",
    "<article><p>A story</p><section id='social-history'><p>Of the town and its people</p></section></article>": "A story\nOf the town and its people",
    "<article><p>How to</p><div class='login-tutorial'><p>First open the page and then sign in</p></div></article>": "How to\nFirst open the page and then sign in",
    "<body><form id='aspnetForm'><div id='top'><a href='/'>Home page</a></div><div id='text'><p>The whole story of the day</p></div></form></body>": "Home page\nThe whole story of the day",
    "<article><p>A story told at some length</p><div class='post-notice'><p>Read our terms</p></div><div class='discussion'><div class='entry'><p>Nice</p></div><div class='entry'><p>Bad</p></div></div></article>": "A story told at some length",
    "<article><p>Methods and results</p><section id='discussion'><h2>Discussion</h2><p>It works</p></section></article>": "Methods and results\nDiscussion\nIt works",
    "<p>Text of the page, long</p><div class='social-stuff'><a href='/f'>Follow</a> <a href='/s'>Send it</a></div><form><p>Your name</p></form>": "Text of the page, long",
    "": "",
}


@pytest.mark.parametrize("page", SHAPES)
def test_shapes(page):
    assert main_text(page) == SHAPES[page]


def test_null_and_deep_and_long():
    assert main_text(None) == ""
    assert main_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert main_text("<p>word</p>" * 50000).count("\n") == 49999
    assert main_text("<" * 100000 + "x").endswith("x") and main_text("<a " + "b" * 100000) != None  # noqa: E711


def test_given_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in extraction.extracted(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def site(n, host="site.example"):
    return [(i, f"https://{host}/{i}", f"<div class='top'>Welcome to the site</div><div class='x'><p>Unique text {i} of page {i * 7}</p></div><div class='low'><p>Always the same</p></div>") for i in range(n)]


def test_branches_alike_all_over_a_site_go(spark):
    rows = site(8) + site(2, "small.example") + [(50, None, "<div>a</div>"), (51, "no host", "<div>a</div>"), (52, None, None), (None, "https://site.example/x", site(8)[0][2]), site(8)[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "key": F.lit(1), "host": F.lit("h")})
    found = extraction.extracted(pages)
    assert found.columns == ["page_id", "url", "html", "key", "host", "text"]
    texts = sorted(((r.page_id, r.url, r.text) for r in found.collect()), key=repr)
    assert len(texts) == len(rows)
    for page_id, url, text in texts:
        if url and "site.example" in url:
            assert text == f"Unique text {page_id or 0} of page {(page_id or 0) * 7}"
        elif url and "small" in url:
            assert text.count("\n") == 2
    assert extraction.extracted(none_of(pages)).count() == 0


def test_copies_of_an_article_stay(spark):
    page = "<div class='top'>Welcome</div><article><div><p>The same article</p></div></article>"
    pages = spark.createDataFrame([(i, "https://a.example/", page) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in extraction.extracted(pages).collect()} == {"The same article"}


def test_importance(spark):
    rows = [("h", 1, a, b) for a, b in ((1, 1), (1, 2), (1, 3), (2, 3))] + [("h", 2, 5, 5)] * 4 + [("h", 3, 7, 7)]
    nodes = spark.createDataFrame(rows, "host string, node long, layout long, content long")
    found = {r.node: r for r in extraction.style_tree(nodes).collect()}
    layouts = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(4)
    texts = -(2 * 0.25 * math.log(0.25) + 0.5 * math.log(0.5)) / math.log(4)
    assert found[1].importance == pytest.approx((1 - 0.9**2) * layouts + 0.9**2 * texts)
    assert found[2].importance == pytest.approx(0) and found[3].importance == 1 and found[1].layouts == 2


def test_copies_of_a_plain_page_stay(spark):
    one = "<div class='top'>Welcome</div><div id='post-123'><p>The same story, told at some length</p></div>"
    other = "<div class='top'>Welcome</div><div id='post-{0}'><p>Another story numbered {0}</p></div>"
    common = "<div class='top'>Welcome</div><div class='post'><p>{0}</p></div>"
    rows = [(f"https://a.example/{i}", one) for i in range(6)] + [(f"https://a.example/o{i}", other.format(i)) for i in range(5)]
    rows += [(f"https://b.example/{i}", common.format("The same story, told at some length")) for i in range(30)]
    rows += [(f"https://b.example/o{i}", common.format(f"Another story numbered {i}")) for i in range(5)]
    rows += [("https://c.example/", one)] * 9
    pages = spark.createDataFrame(rows, "url string, html string")
    texts = {(r.url, r.text.split("\n")[-1], r.text.count("\n")) for r in extraction.extracted(pages).collect()}
    story = "The same story, told at some length"
    assert texts == (
        {(f"https://a.example/{i}", story, 0) for i in range(6)} | {(f"https://a.example/o{i}", f"Another story numbered {i}", 0) for i in range(5)}
        | {(f"https://b.example/{i}", story, 0) for i in range(30)} | {(f"https://b.example/o{i}", f"Another story numbered {i}", 0) for i in range(5)}
        | {("https://c.example/", story, 1)}
    )


@pytest.mark.parametrize("tag", ["article", "main"])
def test_boxes_alike_inside_an_article_go_and_copies_stay(spark, tag):
    box = "<div class='box'><p>Written by the team</p></div>"
    page = f"<div class='top'>Welcome</div><{tag}><h1>Title</h1><div class='body'><p>{{}}</p></div>{box}</{tag}>"
    stories = [f"A story of its own, numbered {i}" for i in range(6)]
    rows = [(f"https://a.example/{i}", page.format(x)) for i, x in enumerate([*stories, *[stories[0]] * 20])]
    rows += [(f"https://b.example/{i}", page.format(stories[0])) for i in range(20)]
    pages = spark.createDataFrame(rows, "url string, html string")
    found = {r.url: r.text for r in extraction.extracted(pages).collect()}
    assert all(found[f"https://a.example/{i}"] == "Title\n" + (stories[i] if i < 6 else stories[0]) for i in range(26))
    assert {found[f"https://b.example/{i}"] for i in range(20)} == {f"Title\n{stories[0]}\nWritten by the team"}


def test_boilerplate_with_neutral_names_goes_and_every_article_stays(spark):
    """Thirty pages a host, no name that says anything, no article element: only the tree can tell."""
    page = (
        "<div class='a'><ul><li>One</li><li>Two</li></ul></div><div class='b'><h1>Title {0}</h1><p>Body of story {0} on {1}</p><p>And its end {0}</p></div>"
        "<div class='c'><div class='d'>Seen {0} times</div><div class='e'><p>Made by the team</p></div></div><div class='f'><p>All rights with us</p></div>"
    )
    rows = [(f"https://{h}.example/{i}", page.format(f"{h}{i}", i * i)) for h in ("one", "two") for i in range(30)]
    found = {r.url: r.text for r in extraction.extracted(spark.createDataFrame(rows, "url string, html string")).collect()}
    for h in ("one", "two"):
        for i in range(30):
            assert found[f"https://{h}.example/{i}"] == f"Title {h}{i}\nBody of story {h}{i} on {i * i}\nAnd its end {h}{i}\nSeen {h}{i} times"
