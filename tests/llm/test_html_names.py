"""Names of branches are a prior that the style tree can outweigh, in both directions."""

import random
from collections import defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from quadrille.llm import html_extract


@pytest.mark.parametrize(
    "page,kept",
    [
        ("<body class='has-sidebar'><p>Own text</p></body>", ["Own text"]),
        ("<body><div class='content-share'><p>Own text of the page</p></div><footer>f</footer></body>", ["Own text of the page"]),
        ("<article class='comments-open'><p>Own text</p></article>", ["Own text"]),
        ("<article><header class='entry-header'><h1>Title</h1></header><p>Own text</p></article><header>site</header>", ["Title", "Own text"]),
        ("<div class='has-sidebar'><main><p>Own text</p></main><div class='sidebar'>side</div></div>", ["Own text"]),
        ("<article><p>Own text</p></article><div id='comments'><article class='comment'>first</article></div>", ["Own text"]),
        ("<article><p>Own text</p><div class='comments'><article>first</article></div></article>", ["Own text"]),
        ("<p>Own text of the page</p><div class='ad box'>Buy</div>", ["Own text of the page"]),
    ],
)
def test_names(page, kept):
    assert [t for p, t in html_extract.blocks(page)[0] if p[0] in "mp"] == kept


def test_entropy_outweighs_names(spark):
    body = "<article><p>Own text %d</p><div class='box'>Like this text</div><div class='widget'>Aside %d</div><div class='related'>More %d</div><aside>Side %d</aside><form>Ask %d</form><section id='comments'><p>Reader %d</p></section></article><div class='ad'>Buy %d</div>"
    pages = [(i, f"http://many.org/{i}", body % ((i,) * 7)) for i in range(60)]
    pages += [(100 + i, f"http://few.org/{i}", body % ((i,) * 7)) for i in range(5)]
    # Copies count once: their article is no boilerplate.
    pages += [(200 + i, f"http://copies.org/{i}", "<article><p>Own text</p></article>") for i in range(60)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Own text {i}\n\nAside {i}" for i in range(60))
    assert all(found[100 + i] == f"Own text {i}\n\nLike this text" for i in range(5))
    assert all(found[200 + i] == "Own text" for i in range(60))


@pytest.mark.parametrize(
    "page,kept",
    [
        ("<article><p>Let <math><mi>x</mi></math> be</p><p>A <svg><text>curve</text></svg> b</p></article>", ["Let x be", "A curve b"]),
        ("<article><video>No player</video><canvas>Chart</canvas><object>Map</object><p>t</p></article>", ["No playerChartMap", "t"]),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>t</p><button>Send</button><script>x</script></article>", ["Title", "t"]),
    ],
)
def test_nothing_else_is_dropped(page, kept):
    found = [t for p, t in html_extract.blocks(page)[0] if p[0] in "mn" and "comment" not in p]
    assert found == kept


def sites(seed=1):
    """Pages without article or telling names: menus, notices and footers that sites repeat around texts of their own."""
    rng, pages, want = random.Random(seed), [], {}
    for h in range(6):
        menu = "".join(f"<li>Menu {h} {i}</li>" for i in range(5))
        for i in range(40):
            own = [f"Text {h} {i} {k} {rng.random()}" for k in range(rng.randrange(1, 6))]
            body = "".join(f"<p>{t}</p>" for t in own)
            notice = f"<div class='k{h}'><span>We change our terms</span></div>" if i % 3 else ""
            pages.append((100 * h + i, f"http://h{h}.org/{i}", f"<body><div class='t{h}'><ul>{menu}</ul></div>{notice}<div class='b{h}'>{body}</div><div class='z'><p>Imprint of {h}</p></div></body>"))
            want[100 * h + i] = "\n\n".join(own)
    return pages, want


def test_the_tree_decides_on_sites_without_article(spark, monkeypatch):
    pages, want = sites()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert found == want
    monkeypatch.setattr(html_extract, "exceptions", lambda parsed, leaves: leaves.groupBy("host").agg(F.collect_set("path").alias("turned")).limit(0))
    without = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert sum(without[i] != want[i] for i in want) == len(want)  # each page changes when the tree is off


def brute_tree(pages):
    """(host, path) -> (pages, importance) by the definitions."""
    read = [(html_extract.host_of(u), html_extract.blocks(h)) for _, u, h in pages]
    articles = ["\n".join([t for p, t in own if p[0] == "m"] or [t for _, t in own]) for _, (own, _) in read]
    copies = defaultdict(int)
    for (host, _), article in zip(read, articles, strict=True):
        copies[host, article] += 1
    there, texts, shapes = defaultdict(float), defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float))
    for (host, (own, sequences)), article in zip(read, articles, strict=True):
        share = 1 / copies[host, article]
        for path in {p[1:] for p, _ in own}:
            there[host, path] += share
        for path, text in {(p[1:], t) for p, t in own}:
            texts[host, path][text] += share
        for path, sequence in sequences.items():
            shapes[host, path][sequence] += share
    out = {}
    for (host, path), m in there.items():
        counts = [max(1, n) for n in texts[host, path].values()]
        content = 1 if m <= 1 else 1 - sum(map(log, counts)) / len(counts) / log(m)
        above = shapes.get((host, path.rsplit("/", 1)[0]), {})
        total = sum(above.values())
        shape = 1 if total <= 1 else 1 - sum(max(1, n) * log(max(1, n)) for n in above.values()) / (total * log(total))
        out[host, path] = (m, html_extract.GAMMA * content + (1 - html_extract.GAMMA) * shape)
    return out


def test_importance_against_brute_force(spark):
    pages, _ = sites(2)
    pages += [(i + 5000, u, h) for i, u, h in pages[:50:3]]
    parsed = html_extract.parse(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id", "url", "html")
    found = {(r.host, r.path): (r.pages, r.importance) for r in html_extract.style_tree(parsed).collect()}
    want = brute_tree(pages)
    assert set(found) == set(want)
    for k, (m, importance) in want.items():
        assert found[k][0] == pytest.approx(m, abs=1e-4) and found[k][1] == pytest.approx(importance, abs=1e-4)


def test_classes_of_single_pages_are_not_listed(spark):
    pages = [(i, f"http://h.org/{i}", f"<article><p>Own text {i}</p></article><div class='c{chr(97 + i % 26)}{chr(97 + i // 26)}'><p>Aside {i}</p></div>") for i in range(200)]
    parsed = html_extract.parse(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id", "url", "html")
    listed = html_extract.exceptions(parsed, html_extract.style_tree(parsed)).collect()
    assert [sorted(r.turned) for r in listed] == [["+m/article/p"]]


def test_long_pages_and_many_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BATCH_CHARACTERS", 50)
    pages = [(i, "http://h.org/", f"<article><p>{'word ' * (300_000 if i == 3 else 3)}{i}</p></article>" if i % 4 else None) for i in range(30)]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()}
    assert found == {i: f"{'word ' * (300_000 if i == 3 else 3)}{i}" if i % 4 else "" for i in range(30)}
