"""Cuts against all labellings, and pages of several builds."""

import itertools
import random

import pytest

from deckloom.llm import article


def test_cut_is_least():
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randint(1, 9)
        gains = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def cost(kept):
            own = sum(g for g, k in zip(gains, kept) if g > 0 and not k) - sum(g for g, k in zip(gains, kept) if g < 0 and k)
            return own + sum(c for a, b, c in edges if kept[a] != kept[b])

        assert cost(article.minimum_cut(gains, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


PAGES = {
    "semantic": ("""<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
        <nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><main><article><header><h1>A title &amp; more</h1></header>
        <p>First paragraph of  the\n story.<p>Second <b>o</b>ne<br>here &lt;b&gt;.<aside>Read also this</aside><ul><li>point</li></ul>
        <form>Name <input> <button>Go</button></form></article><section class="comments"><article><p>I liked it very much indeed.</p>
        </article></section></main><footer>&copy; 2020</footer><script>if (a<b) { "</p>" }</script>""",
                 "A title & more First paragraph of the story. Second one here <b>. point"),
    "divs": ("""<div id="topNav"><a href=x>One</a> | <a href=y>Two</a></div><div class="cookie-notice">We use cookies on this site.</div>
        <div class="post-content"><h2>Heading</h2><div>Some text of the story, long enough to be read.</div><div class="ad_slot">Buy now</div>
        <div>More text of the story.</div></div><div class='sidebar'>About us</div>""",
             "Heading Some text of the story, long enough to be read. More text of the story."),
    "plain": ("<p>Only one paragraph stands here.</p>", "Only one paragraph stands here."),
    "unclosed": ("<article><h1>Head<p>One<p>Two <i>three", "Head One Two three"),
    "hidden": ("<article><p>Seen words</p><p hidden>Not seen</p><noscript>No</noscript><!-- <p>gone</p> --></article>", "Seen words"),
    "space": ("<article><p>\u00a0 a&nbsp;&#32;b\t</p></article>", "a b"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, text = PAGES[name]
    assert article.article_text(html) == text


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!-- x", "<script>x", "</p></div>", '<a href="x>y', "<nav>a</nav>", "<" * 5000])
def test_broken_and_empty(html):
    assert isinstance(article.article_text(html), str)


def test_long_page_is_kept_whole():
    html = "<body><article>" + "<p>some words</p><div class=ad>x</div>" * 8000 + "</article>"
    assert article.article_text(html) == " ".join(["some words"] * 8000)


def test_pages(spark):
    rows = [(1, PAGES["plain"][0], "a"), (1, PAGES["plain"][0], "a"), (None, None, None)]
    found = article.extract_articles(spark.createDataFrame(rows, "page_id bigint, html string, _row string"))
    assert found.columns == ["page_id", "html", "_row", "main_text"]
    assert sorted(r.main_text for r in found.collect()) == ["", PAGES["plain"][1], PAGES["plain"][1]]
    assert article.extract_articles(spark.createDataFrame([], "page_id bigint, html string")).collect() == []
