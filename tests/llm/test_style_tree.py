from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ballast.llm.style_tree import host_of, low_nodes, main_text, parse, text_of
from ballast.sources.tables import table

def text(html):
    """Of a page whose host has no others: only names decide."""
    return text_of(html, frozenset(b.node for b in parse(html).blocks if b.decided == 0))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<b>b</b>c</p><p>d", "abc d"),
        ("<article><h1>T &amp; U</h1><p><b>x<br><p>y&nbsp;z</article><footer>f</footer>", "T & U x y z"),
        ("<nav>menu</nav><p>one</p><script>var a='<p>no</p>'</script><style>p{}</style><p>two", "one two"),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ('<div class="ad">x</div><div id="comments"><p>c</p></div><aside>s</aside><div class="head-line">kept</div>', "kept"),
        ('<p>before <span class="ad">buy</span> after</p>', "before after"),
        ("<header>site</header><main><header><h1>T</h1></header><p>x</p><form><p>f</p></form></main><p>late</p>", "T x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("a < b and c > d &lt;p&gt; &#233; &am", "a < b and c > d <p> é &am"),
        ('<p title="a > b">x</p><p title=\'"\'>y</p><p title="open>z</p>', "x y z"),
        ("<head><title>t</title><p>body without a tag", "body without a tag"),
        ("<textarea>no</textarea><select><option>a<option>b</select><button>go</button>yes", "yes"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("a&am<b>p;</b> &lt<i>b</i>", "a&amp; <b"),
        ("</div></p>x</b><p", "x"),
        ("<p>wo<img src=a>rd <input>one<embed></p><p>a<br>b<hr>c", "word one a b c"),
        ('<article><p>see <span class="form-of">plural of word</span> here</p></article>', "see plural of word here"),
        ('<article>The <a class="share-price" href="x">price</a> rose<span class="ad">buy</span></article>', "The price rose"),
    ],
)
def test_text_of_one_page(html, want):
    assert text(html) == want


def test_hosts():
    assert host_of("https://User@WWW.Example.org:8080/a?b#c") == "www.example.org"
    assert host_of("//h/x") == "h" and host_of("no url") == "" and host_of(None) == ""


def test_long_and_deep_pages():
    assert len(text("<div>" * 3000 + "x" * 500_000)) == 500_000
    assert text("<" * 50_000) == "<" * 50_000
    assert text('<p "' * 20_000 + ">x") == "x"


def site(host, n):
    menu = "<div><ul><li>Home</li><li>News</li></ul></div>"
    foot = "<div><p>All rights reserved. Contact us.</p></div>"
    body = "".join
    return [(i, f"http://{host}/{i}", body(["<html><body>", menu, f"<div><section><p>Story {i} tells of {i * i} things.</p><p>It ends at {i}.</p></section></div>", foot])) for i in range(n)]


def test_template_of_a_host_goes_and_its_stories_stay(spark):
    rows = site("one.example", 30) + [(100 + i, u, h) for i, u, h in site("few.example", 2)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Story 7 tells of 49 things. It ends at 7."
    assert got[101] == "Home News Story 1 tells of 1 things. It ends at 1. All rights reserved. Contact us."


def test_quoted_articles_stay(spark):
    page = "<html><body><nav>x</nav><article><h1>Same</h1><p>The same text on all pages.</p></article><footer>y</footer>"
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in main_text(df).collect()} == {"Same The same text on all pages."}


def test_defined_results(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://h/", "<p>x"), (3, "http://h/", "<p>x"), (3, "http://h/", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("low", F.lit(1))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "", "", 0), (None, "http://h/", "x", 1), (3, "http://h/", "x", 1), (3, "http://h/", "x", 1)], key=repr)
    assert main_text(df.limit(0)).collect() == []


def test_articles_of_the_test_pages(spark, data):
    df = table(spark, data, "pages")
    got = {r.page_id: r for r in main_text(df).collect()}
    for r in df.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        want = text("<article>" + inner)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and want
        assert "track(" not in want


def test_blocks_know_their_place():
    page = parse('<body><div class="B a"><p>x</p></div></body>')
    assert [(b.path, b.text) for b in page.blocks] == [("/body/div.a.b/p", "x")]
    assert page.styles["/body"] == ["div"]


def test_main_elements_are_a_prior(spark):
    note = "<section><p>Read our terms before you go on.</p></section>"
    teaser = "<article><p>Subscribers read more.</p></article>"
    story = lambda i: f"<p>Story {i} tells of {i * i} things.</p>"
    inside = [(i, f"http://in.example/{i}", f"<body><article>{story(i)}{note}</article></body>") for i in range(40)]
    beside = [(100 + i, f"http://by.example/{i}", f"<body><div>{story(i)}</div><div class='x'><p>All rights reserved.</p></div>{teaser}</body>") for i in range(40)]
    few = [(200 + i, f"http://few.example/{i}", f"<body><div>{story(i)}</div><article>{story(i + 1)}{note}</article></body>") for i in range(5)]
    df = spark.createDataFrame(inside + beside + few, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[i] == got[100 + i] == f"Story {i} tells of {i * i} things." for i in range(40))
    assert got[201] == "Story 2 tells of 4 things. Read our terms before you go on."


def test_pages_of_a_host_weigh_without_a_step(spark):
    """Template without names goes from four pages on, on every host by itself; expected texts are written down, not parsed."""
    rows = [(100 * n + i, u, h) for n in range(1, 8) for i, u, h in site(f"h{n}.example", n)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page_id, found in got.items():
        n, i = divmod(page_id, 100)
        story = f"Story {i} tells of {i * i} things. It ends at {i}."
        assert found == (story if n >= 4 else f"Home News {story} All rights reserved. Contact us.")


def test_entropy_decides_rows_on_many_hosts(spark):
    """Unnamed boxes of each host's own wording, in and beside articles: without the low nodes they would all be in the text."""
    box = lambda h: f"<section><p>House rules number {h}.</p></section>"
    page = lambda h, i: f"<body><div class='x{h}'><p>Site {h}</p></div><article><p>On {h} day {i} came {i * 7 + h}.</p>{box(h)}</article></body>"
    rows = [(h * 100 + i, f"https://host{h}.example/{i}", page(h, i)) for h in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got == {h * 100 + i: f"On {h} day {i} came {i * 7 + h}." for h in range(12) for i in range(20)}
    off = {i: text_of(page, frozenset()) for i, _, page in rows}
    assert all(off[i] != t for i, t in got.items())


def test_only_undecided_nodes_are_shipped(spark, data):
    named = "<nav><p>a</p></nav><div class='ad'>b</div>"
    rows = [(i, "http://h.example/", f"<body>{named}<article><p>Text {i}.</p></article></body>") for i in range(30)]
    low = low_nodes(spark.createDataFrame(rows, "page_id long, url string, html string").select("url", "html"))
    assert low.count() == 0
