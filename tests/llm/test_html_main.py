import html
import itertools
import random
import re
import time

import pytest

from vitrine.llm import html_main


def brute_region(scores):
    best = max(((sum(scores[a:b]), a, b) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0))
    return best[0]


def test_scan_finds_the_best_region():
    r = random.Random(1)
    for _ in range(300):
        s = [r.choice([-2, -1, 0, 1, 2, 3]) for _ in range(r.randrange(12))]
        a, b = html_main.best_region(s)
        assert sum(s[a:b]) == max(0, brute_region(s))


@pytest.fixture(scope="module")
def weights(spark):
    return html_main.learned(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_like_the_marked_article(spark, weights):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", inner)
        want = " ".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks) if x)
        assert html_main.main_text(r.html, weights) == want


PAGE = """<!doctype html><html><head><title>T</title><style>p{a:b}</style></head><body>
<header><h1>Site name</h1></header><nav class="menu"><ul><li><a href="/">Home and more</a></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site, a lot of them, really.</p></div>
<aside class=sidebar><p>Side text of many many words that goes on and on.</p></aside>
<main><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld  para&shy;graph with <a href="x">a link</a> inside it.
<div class='ad-slot ad'><p>Buy this now, it is cheap and good!</p></div>
<p>Second&nbsp;paragraph &lt;tag&gt; of the text 3 < 4 ok.</p><ul><li>Item one<li>Item two</ul>
<script>var x = "<p>no</p>";</script><form><label>Mail</label><input name=m></form><!-- <p>hidden</p> -->
</article><section id="comments"><p>Reader comment one is long and rude, and goes on.</p></section></main>
<footer><p>All rights reserved by someone.</p></footer></body></html>"""


def test_a_page_with_everything(weights):
    for w in (weights, html_main.Weights()):
        assert html_main.main_text(PAGE, w) == (
            "Title & more First bold para\xadgraph with a link inside it. "
            "Second paragraph <tag> of the text 3 < 4 ok. Item one Item two")


def test_odd_pages(spark):
    odd = [None, "", "   ", "<p>", "no tags at all", "<", "<a", "<p class=\"x>unclosed quote", "<!-- open", "<script>x",
           "<div class=ad>never closed <p>then text of the page", "</p></div>", "&amp;&lt;b&gt;", "<p>x" * 20_000,
           "<" * 50_000, "<a '" * 20_000]
    df = spark.createDataFrame([(i if i % 3 else None, None if i % 2 else "u", h, "z") for i, h in enumerate(odd)],
                               "page_id long, url string, html string, text string")
    rows = html_main.extract(df).collect()
    assert len(rows) == len(odd) and all(r.n_chars == len(r.text) for r in rows)
    w = html_main.Weights()
    assert [html_main.main_text(h, w) for h in odd[:5]] == ["", "", "", "", "no tags at all"]
    assert html_main.main_text(odd[10], w) == "then text of the page" and html_main.main_text(odd[12], w) == "&<b>"
    assert html_main.extract(df.limit(0)).count() == 0


BODY = "".join(f"<p>Sentence number {i} of the text says a few words about a thing.</p>" for i in range(30))
WRAPPERS = ["layout no-sidebar", "page-template", "has-header", "site with-footer", "post-template", "search-layout", "modal-open",
            "comments", "no-comments sidebar", "menu"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_are_not_left_out(weights, name):
    want = " ".join(f"Sentence number {i} of the text says a few words about a thing." for i in range(30))
    side = '<aside class="sidebar"><p>Read more of this and that here.</p></aside>'
    for page in (f'<body><div class="{name}">{BODY}</div></body>', f'<body><div class="{name}"><article>{BODY}</article>{side}</div></body>',
                 f'<body class="{name}"><nav><a href="/">Home</a></nav><article>{BODY}</article></body>'):
        for w in (weights, html_main.Weights()):
            assert html_main.main_text(page, w) == want


def test_linear_time():
    w = html_main.Weights()
    for page in ("<nav>" * 100_000, "<script " * 100_000, '<a href="x ' * 100_000, "<div class='a" * 100_000, "<!-" * 100_000,
                 "<nav>x</nav" * 50_000, "<" * 100_000, "<p>x<!-- " * 100_000, "<i>" * 100_000 + "x" + "</b>" * 100_000):
        start = time.perf_counter()
        html_main.main_text(page, w)
        assert time.perf_counter() - start < 2, page[:20]


def test_what_is_never_closed_takes_the_rest():
    w = html_main.Weights()
    assert html_main.main_text("<p>text of words</p><script>var x = 1 > 0; more", w) == "text of words"
    assert html_main.main_text("<p>text of words</p><!-- a <b> c", w) == "text of words"
    assert html_main.main_text("<p>text of words</p> and <!-- a", w) == "text of words and"
    assert html_main.main_text("<p>text 3 < 4 of words", w) == "text 3 < 4 of words"
