"""What the style tree decides by itself: neutral names, names inside articles, inline elements; and odd html in linear time."""

import time
from collections import Counter

import pytest

from quadrille.llm import html_extract
from quadrille.llm.common import table

SF = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()}


def neutral(html):
    for a, b in (("<nav>", "<div class=k1>"), ("</nav>", "</div>"), ("<footer>", "<div class=k2>"), ("</footer>", "</div>"), ('class="ad"', 'class="k3"'), ("<article>", "<div class=k4>"), ("</article>", "</div>")):
        html = html.replace(a, b)
    return html


def test_neutral_names_give_the_article(spark):
    """Without telling tags and names, and so without article, the tree finds what the names told."""
    rows = [tuple(r) for r in table(spark, SF, "pages").where("page_id % 4 < 2").collect()]
    hosts = Counter(html_extract.host_of(u) for _, u, _ in rows)
    named, plain = texts(spark, rows), texts(spark, [(i, u, neutral(h)) for i, u, h in rows])
    on_large = [i for i, u, _ in rows if hosts[html_extract.host_of(u)] >= 20]
    assert len(on_large) > 500
    assert sum(named[i] == plain[i] for i in on_large) >= 0.95 * len(on_large)


def test_without_the_tree_nothing_goes(spark, monkeypatch):
    rows = [tuple(r) for r in table(spark, SF, "pages").where("page_id % 10 = 0").collect()]
    found, own = texts(spark, rows), html_extract.exceptions
    monkeypatch.setattr(html_extract, "exceptions", lambda parsed, leaves: own(parsed, leaves).limit(0))
    without = texts(spark, rows)
    assert sum(found[i] != without[i] for i in found) > 0.9 * len(found)


def test_names_inside_an_article(spark):
    body = (
        "<article><p>Own text %d</p><div class='related-work'><p>Related work of the paper %d</p></div><div class='reply'><p>The reply of the king %d</p></div>"
        "<div class='notice-board'>Board %d</div><div class='related-posts'><p>More %d</p></div><div class='comment-list'><p>Reader %d</p></div></article>"
    )
    pages = [(i, f"http://many.org/{i}", body % ((i,) * 6)) for i in range(60)] + [(100 + i, f"http://few.org/{i}", body % ((i,) * 6)) for i in range(5)]
    found = texts(spark, pages)
    assert all(found[i] == f"Own text {i}\n\nRelated work of the paper {i}\n\nThe reply of the king {i}\n\nBoard {i}" for i in range(60))
    assert all(found[100 + i] == f"Own text {i}\n\nRelated work of the paper {i}\n\nBoard {i}" for i in range(5))


def test_inline_elements(spark):
    page = "<article><p>Text <b>of</b> page %d <span class='ad'>buy <b>it</b> now</span> and <span>more</span>.</p><p><i class=ad>ad</i></p><p>A<em class='advert'>x</em>B <span class='share-links'>tell <span>all</span> friends</span></p></article>"
    pages = [(i, f"http://h.org/{i}", page % i) for i in range(5)]
    found = texts(spark, pages)
    assert all(found[i] == f"Text of page {i} and more.\n\nAB" for i in range(5))
    # Names of a template wear off: with many pages, what varies stays in its place.
    many = [(i, f"http://h.org/{i}", f"<article><p>One {i} <span class='share'>part {i}</span> two</p></article>") for i in range(80)]
    assert texts(spark, many) == {i: f"One {i} part {i} two" for i in range(80)}


def test_a_site_whose_texts_all_repeat_keeps_its_articles(spark):
    pages = [(i, f"http://h.org/{i}", f"<nav>Menu {i % 2}</nav><article><p>Own text {i % 3}</p><p>Second {i % 2}</p></article>") for i in range(60)]
    assert texts(spark, pages) == {i: f"Own text {i % 3}\n\nSecond {i % 2}" for i in range(60)}


@pytest.mark.parametrize(
    "page",
    [
        "<a x='" * 175_000, "<div>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<script>" + "</script " * 110_000, "<" * 1_000_000, "<a" * 500_000, "<a '>" * 200_000,
        "<a \"'>" * 160_000, "<span class=ad>" * 30_000 + "<div></div>" * 50_000, "<b class=ad>" + "<span class=ad>" * 30_000 + "<b>" * 150_000, "<p class='" + "a" * 1_000_000 + "'>x", "<!--" * 250_000,
        "<a x='>" * 140_000 + '"<b>', "&" * 1_000_000, "<p>" + "x " * 500_000,
    ],
)
def test_a_megabyte_of_anything(page):
    begun = time.perf_counter()
    html_extract.page_blocks(page)
    assert time.perf_counter() - begun < 6


def test_long_paths_and_names_are_bounded():
    found, children = html_extract.page_blocks("<div class='x'>" * 5000 + "text" + f"<p class='{'a b' * 3000}'>more")
    assert [t for b in found for _, t in b] == ["text", "more"]
    assert max(len(p) for p in children) <= html_extract.DEEP and max(len(p) for b in found for p, _ in b) <= html_extract.DEEP + 2 * html_extract.LONG_NAME
    same = html_extract.page_blocks("<div class='x'>" * 5000 + "other")[0]
    assert same[0][0][0] == found[0][0][0]


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ("<p>a<script>if (a < b) { x = '<p' }</script>b</p>", ["ab"]),
        ("<p>a <!-- <p> --> b<br>c &lt;p&gt;</p>", ["a b c <p>"]),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p>", ["x", "y"]),
        ("<p title='never closed>x</p><p>y</p>", ["x", "y"]),
        ("<p>a</p>tail <3 hearts", ["a", "tail <3 hearts"]),
        ("<script>never closed <p>x</p>", []),
        ("<p>a<p>b<ul><li>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("</div></span></p>x", ["x"]),
    ],
)
def test_odd_html(page, kept):
    assert ["".join(t for _, t in b) for b in html_extract.page_blocks(page)[0]] == kept
