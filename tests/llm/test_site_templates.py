"""Site templates on a large host: what a few of many articles share is their own text."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pixkin.llm import html_text

SHARED = "<ul><li>first step</li><li>second step</li></ul>"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_a_list_that_few_articles_of_a_large_host_share_stays(spark, broadcast):
    box = "<div>Read all of our stories</div>"
    pages = [(i, f"http://large.example/{i}", f"<body><article><p>own text {i}</p>{SHARED if i < 8 else ''}{box}</article></body>") for i in range(120)]
    pages += [(500 + i, f"http://small.example/{i}", f"<body><article><p>small text {i}</p>{box}</article></body>") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df, broadcast=broadcast).collect()}
    want = {i: f"own text {i}" + (" first step second step" if i < 8 else "") for i in range(120)} | {500 + i: f"small text {i}" for i in range(6)}
    assert got == want


LONG = "All of this is what the page has to say, and it says it at length. " * 6
WRAPPED = [
    (f'<body><div class="content has-sidebar"><h1>T</h1><p>{LONG}</p><div class="sidebar"><a href=x>link</a> more</div></div></body>', "T"),
    (f'<body><div id="page" class="layout-no-sidebar"><article><p>{LONG}</p></article></div><div class="cookie-notice">{LONG * 3}</div></body>', ""),
    (f'<div class="widget-area"><p>{LONG}</p></div>', ""),
    (f'<div class="post no-comments"><article><p>{LONG}</p></article></div><div class="comments"><article class=comment>{LONG * 3}</article></div>', ""),
    (f'<div class="wrap menu-open"><main><p>{LONG}</p></main></div><div class="related"><article><p>{LONG * 2}</p></article></div>', ""),
    (f'<div><h1>T</h1><p>{LONG}</p></div><div class="related"><article><p>teaser</p></article></div>', "T"),
    (f'<article><p>{LONG}</p><div class="related"><article>teaser {LONG}</article></div></article>', ""),
    (f'<a title="1 > 0" href=x>skip</a><article class="post""><p>{LONG}</p></article>', ""),
    (f'<p><b><i><u><s><em><span>{LONG}<div>', ""),
]


@pytest.mark.parametrize(("html", "before"), WRAPPED)
def test_boxes_that_hold_the_article_stay(html, before):
    assert html_text.main_text(html).split() == f"{before} {LONG}".split()


def test_hard_pages_take_linear_time():
    """Ten times the page takes about ten times as long, not a hundred."""
    for part in ('<a href="', "<div>", "<div class=content>", "<p>", "<b><i>", "</span><div>", "<article>", "<li><div>", "<!", "<menu>a"):
        took = []
        for n in (4_000, 40_000):
            start = time.process_time()
            html_text.candidates(part * n)
            took.append(time.process_time() - start)
        assert took[1] < 40 * max(took[0], 0.02), part


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_templates_against_plain_counts_and_clashing_names(spark, broadcast):
    rng = random.Random(1)
    boxes = [f"<div>box {k} <b>of words</b></div>" for k in range(12)]
    table = []
    for i in range(150):
        host = rng.choice(["a.example", "b.example", "c.example", None])
        html = "<body>" + "".join(b for k, b in enumerate(boxes) if rng.random() < k / 20) + f"<article><p>text {i % 110}</p>{rng.choice(boxes)}</article></body>"
        table.append((i, host and f"http://{host}/{i}", html))
    articles, goes = {}, {}
    for i, url, html in table:
        site = url.split("/")[2] if url else ""
        page = html_text.parse(html)
        top = html_text.root(page)
        text = html_text.under(page, top)
        articles.setdefault(site, set()).add(text)
        for h in html_text.subtrees(page, top).values():
            goes.setdefault((site, h), set()).add(text)
    want = {}
    for i, url, html in table:
        site = url.split("/")[2] if url else ""
        cut = {h for (s, h), texts in goes.items() if s == site and len(texts) >= 5 and len(texts) >= 0.1 * len(articles[site])}
        want[i] = html_text.main_text(html, cut)
    names = ["site", "key", "article", "subtree", "_site", "_html", "page_site", "page_key", "page_html", "page_subtrees", "n", "of"]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumns({n: F.lit(n) for n in names})
    out = html_text.extract(df, broadcast=broadcast)
    assert {r.page_id: r.text for r in out.collect()} == want and set(names) < set(out.columns) and len(set(want.values())) > 100


KEPT = "side-effects promo-code alert-level related-work comments-on-the-law banner-year menu-engineering share-price social-contract modal-verbs navigation-history footer-notes widget-theory notice-period popup-books cookie-recipes sponsor-of-the-bill side-note skip-logic toolbar-design".split()


@pytest.mark.parametrize("name", KEPT)
@pytest.mark.parametrize("box", ['<div class="{}">{}</div>', '<p class="{}">{}</p>', '<section id="{}"><p>{}</p></section>', '<p id="x" class="big {}">{}</p>'])
def test_a_name_alone_drops_no_part_of_an_article(name, box):
    for top in ("article", "main", "div"):
        html = f"<body><nav>m</nav><{top}><h1>T</h1><p>One goes first.</p>{box.format(name, 'Two comes next.')}<p>Three ends it.</p></{top}></body>"
        assert html_text.main_text(html) == "T One goes first. Two comes next. Three ends it."


def test_whole_names_need_evidence_inside_an_article():
    page = lambda box, end="<p>Last words.</p>": f"<article><h1>T</h1><p>One goes first.</p>{box}{end}</article>"
    for name in ("notice", "alert", "banner", "sidebar", "promo", "related", "comments", "share"):
        assert "Said here." in html_text.main_text(page(f'<div class="{name}"><p>Said here.</p></div>')), name
    for box in (
        '<div class="related-posts"><a href=x>Read this. And this.</a></div>', '<div class="newsletterSignup"><p>Leave your address.</p><form><input></form></div>', '<div class="newsletter">Join us. <input type=text></div>',
        '<div class="share-buttons">Share Save</div>', '<section class="comments"><div class="comment">Nice. Thanks.</div></section>', '<div class="ad-slot"><a href=y>Buy it now.</a></div>',
    ):
        assert html_text.main_text(page(box)) == "T One goes first. Last words.", box
    assert html_text.main_text(page('<section class="comments"><p>Bob says it is nice.</p></section><div class="share">Share</div>', "")) == "T One goes first."


def test_copies_of_a_page_on_the_second_path_and_null_page_ids(spark):
    pages = [(None if i % 3 else i, "http://a.example/x", "<body><div>same box of the site</div><article><p>one text.</p></article></body>") for i in range(3000)]
    pages += [(9000 + i, "http://a.example/y", f"<body><div>same box of the site</div><article><p>text {i}.</p><div>shared by all of them</div></article></body>") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = html_text.page_report(df).collect()
    assert len(out) == 3008 and sum(r.page_id is None for r in out) == 2000
    got = html_text.extract(df, broadcast=-1).collect()
    assert sorted(r.text for r in got) == sorted(r.text for r in out) == sorted(["one text."] * 3000 + [f"text {i}." for i in range(8)])
