import html
import re

import pytest

from tripleloom.llm import html_consensus as H

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page"><main class="content"><article class="post-12"><h2>Head &amp; line</h2><!-- no <p>this</p> --><p>One <b>two</b>
 three&nbsp;four<br>five<p>Six &eacute; &#8364;<ul><li>seven<li>eight</ul><table><tr><td>a<td>b<tr><td>c</table>
<div class="advert">Buy</div><form><input value="x">Name</form><blockquote>nine</blockquote></article>
<section id="comments" class="comments"><article class="comment"><p>Nice post! Nice post! Nice post!</p></article></section></main>
<aside class="sidebar">Side</aside></div><footer>&copy; me</footer></body></html>"""


def test_a_page_with_everything():
    assert H.main_text(FULL, ">div>main.content>article.post-#") == "Head & line\nOne two three four five\nSix é €\nseven\neight\na b\nc\nnine"
    assert H.main_text(FULL, None) == H.main_text(FULL, ">nowhere")


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<div>a</p>b</div>c", "a\nb\nc"), ("<p>a < b</p>", "a < b"),
        ("<p>x<script>1</script>y", "xy"), ("<script>never closed <p>a", ""), ("<!-- open <p>a", ""), ("<p>a<span>b</i>c</p>", "abc"),
        ('<p title="a>b">c</p>', "c"), ('<p title="a>b>c', "b>c"), ("<div hidden><p>a</p></div><p>b", "b"), ("<nav>a</nav>", ""),
        ("<P>A\t\n B</P>", "A B"), ("<div style='display: none'>a</div>b", "b"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ],
)
def test_odd_pages(source, text):
    assert H.main_text(source, "") == text


def test_host_majority_decides(spark):
    body = "<div class='{c}'><p>" + "word " * 60 + "</p></div><div class='x'><p>{x}</p></div>"
    pages = [(i, "http://A.com/p%d" % i, body.format(c="story", x="other " * 10)) for i in range(5)]
    pages += [(5, "https://a.com:80/q", "<div class='story'><p>short</p></div><div class='x'><p>" + "teaser " * 60 + "</p></div>")]
    pages += [(6, None, "<p>alone</p>"), (7, "odd", None), (7, "odd", None), (None, "http://b.com", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df = df.withColumn("main_text", df.url).withColumn("voted_path", df.url)
    out = H.extract_main_text(df)
    assert out.count() == len(pages) and sorted(out.columns) == sorted(df.columns)
    rows = {r.page_id: r.main_text for r in out.collect()}
    assert rows[5] == "short" and rows[0] == ("word " * 60).strip() and rows[6] == "alone" and rows[7] == "" and rows[None] == ""
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_equal_votes_take_the_smallest_path(spark):
    df = spark.createDataFrame([(1, "http://h/1", "<div class=b>same text</div>"), (2, "http://h/2", "<div class=a>same text</div>")], "page_id long, url string, html string")
    votes = {r.voted_host: r.voted_path for r in H.host_paths(df).collect()}
    assert votes["h"] in ("", ">div.a")


def test_query_on_given_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op9_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "<p>" + "word " * 99 + "end</p>"
SEEN = "word " * 99 + "end"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<article><h1>T</h1><p>lead</p><div class='content'>{LONG}</div><p>last</p></article><div>teaser</div>", f"T\nlead\n{SEEN}\nlast"),
        (f"<article><h1>T</h1><div><p>lead</p><section>{LONG}</section></div></article>", f"T\nlead\n{SEEN}"),
        (f"<div>site</div><h1>T</h1><p>lead</p><div class='content'>{LONG}</div><div>teaser</div>", f"T\nlead\n{SEEN}"),
        (f"<div><div><h1>T</h1></div><div class='content'>{LONG}</div><div>teaser</div></div>", f"T\n{SEEN}"),
        (f"<div><h1>Site</h1></div><div class='content'>{LONG}</div>", SEEN),
        (f"<main><h1>T</h1><article>{LONG}</article></main>", f"T\n{SEEN}"),
    ],
)
def test_titles_and_leads_around_the_winner(source, text):
    assert H.main_text(source, None) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><h2 id='related-work'>Related</h2><p>a</p></article>", "Related\na"),
        ("<article><section id='discussion'><h2 id='comments-on-x'>On x</h2><p>a</p></section></article>", "On x\na"),
        ("<article><h2><span id='discussion'>Talk</span></h2><p>a</p></article>", "Talk\na"),
        ("<main><p>a</p><section class='comments'><p>b</p></section><section id='comments'><p>c</p></section></main>", "a"),
        ("<div id='discussion'><p>b</p></div><p>a</p>", "a"),
        ("<p>a <noscript>x</noscript><button>y</button><svg><text>z</text></svg><span hidden>u</span><span class='ad'>v</span> b</p>", "a b"),
        ("<noscript>x<p>y</p></noscript><p>a</p>", "a"), ("<p>a <noscript>x<div>y</div></noscript></p>", "a"),
        ("<p>a <span class='ad'>x</span></p><p>b", "a\nb"),
    ],
)
def test_noise_by_name_and_inside_blocks(source, text):
    assert H.main_text(source, "") == text
    assert H.main_text(source, None) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<form id='aspnetForm'><article><h1>T</h1>{LONG}</article></form>", f"T\n{SEEN}"), (f"<form><div>{LONG}</div><input></form><p>x</p>", SEEN),
        (f"<div class='main with-sidebar'>{LONG}</div>", SEEN), (f"<div class='post social-post'>{LONG}<p>b</p></div>", f"{SEEN}\nb"),
        (f"<div class='layout-has-menu'><div class='story'>{LONG}</div><div class='menu'>m</div></div>", SEEN), (f"<div class='notice-board'>{LONG}</div>", SEEN),
        (f"<article><header><h1>Title</h1><p>by me</p></header>{LONG}</article>", f"Title\n{SEEN}"), (f"<header><h1>Site</h1></header><article>{LONG}</article>", SEEN),
        (f"<h1>T</h1><div class='a'>{LONG}</div><div class='b'>{LONG}</div><div class='c'><a href='x'>{'more ' * 60}</a></div>", f"T\n{SEEN}\n{SEEN}"),
        (f"<div class='story'><p>short</p></div><div class='comment-list'>{LONG}</div>", "short"),
        (f"<div class='text'>{LONG}</div><div class='newsletter-box'><p>Sign up</p></div>", SEEN), (f"<div class='sidebar'>{LONG}</div>", SEEN),
    ],
)
def test_names_make_noise_by_evidence(source, text):
    assert H.main_text(source, None) == text


DEEP = 50_000


@pytest.mark.parametrize(
    "source",
    ["<div>" * DEEP + "a" + "</div>" * DEEP, "<div class='x'><p>a</p>" * (DEEP // 2), "<p><table><tr><td>" + "<div id='a1'>" * DEEP + "a", "<span class='s'>" * DEEP + "a",
     "<!" * 400_000, "<a <b " * 150_000, "<ul>" + "<li><b>" * DEEP, "<!--" * 200_000, "<h1>t</h1><div>a</div>" * (DEEP // 4), "</p></div>" * DEEP, "<td>a" * DEEP],
    ids=range(11),
)
def test_deep_and_broken_pages_take_linear_time(source):
    import tracemalloc
    from time import process_time

    start = process_time()
    H.main_text(source, None)
    assert process_time() - start < 6  # about two seconds on a free core
    tracemalloc.start()
    H.main_text(source[: len(source) // 2], None)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
