"""Selectors, links of listings, and articles of pages with planted menus."""

import gc
import random

import pytest
from pyspark.sql import functions as F

from newsmill.functions import tree

PAGE = """<html><body><div id="top" class="box wide"><h2 class="title"><a href="/1" data-k="ab cd">One</a></h2><h2><a href="2.html">Two <b>bold</b></a></h2>
<p>text<p class="x">more <a href="/1">again</a><ul><li>a<li class="on">b<li>c</ul></div><div lang="en-GB"><a href="#x">#</a><a href="javascript:f()">j</a><a>no</a><a href="https://o.example/3?q=1&amp;r=2"> Three </a><br/></div></body></html>"""


def texts(css):
    return [n.text() for n in tree.select(tree.tree(PAGE), css)]


@pytest.mark.parametrize(
    "css,want",
    [
        ("h2.title a", ["One"]), ("h2 > a", ["One", "Twobold"]), ("#top a", ["One", "Twobold", "again"]), ("div.box.wide > p a[href]", ["again"]), ("li", ["a", "b", "c"]),
        ("li.on + li", ["c"]), ("li ~ li", ["b", "c"]), ("a[data-k~=cd]", ["One"]), ('a[href^="https"]', ["Three"]), ("a[href$='.html']", ["Twobold"]), ("a[href*=1]", ["One", "again", "Three"]),
        ("div[lang|=en] a[href]", ["#", "j", "Three"]), ("h2.title a, p.x", ["One", "moreagain"]), ("body *[class] > li", []), ("b", ["bold"]), ("nothing", []),
    ],
)
def test_selectors(css, want):
    assert texts(css) == want


@pytest.mark.parametrize("css", ["", "a:hover", "> a", "a >", "a,,b", "a[", "1a"])
def test_what_is_no_selector(css):
    with pytest.raises(ValueError):
        tree.selector(css)


def test_links_of_a_listing(spark):
    rows = [(1, "https://n.example/list/", PAGE), (2, "https://n.example", "".join(f"<a href='/p{i % 30}'>t{i}</a>" for i in range(100))), (3, "u", None), (4, "https://b.example", "<a href='http://[x'>bad</a><a href='/y'>")]
    df = spark.createDataFrame(rows, "id int, url string, html string")
    got = {r.id: [tuple(x) for x in r.l] for r in df.select("id", tree.selected_links(F.col("html"), F.col("url")).alias("l")).collect()}
    assert got[1] == [("https://n.example/1", "One"), ("https://n.example/list/2.html", "Twobold"), ("https://o.example/3?q=1&r=2", "Three")]
    assert got[2] == [(f"https://n.example/p{i}", f"t{i}") for i in range(20)]
    assert got[3] == [] and got[4] == [("https://b.example/y", "")]


def page(rng, menus, paragraphs):
    words = lambda n: " ".join("".join(rng.choices("abcdefghi", k=rng.randint(2, 8))) for _ in range(n))
    body = [words(rng.randint(12, 60)) + "." for _ in range(paragraphs)]
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{i}'>{words(4)}</a></li>" for i in range(rng.randint(5, 30))) + "</ul>"
    parts = [f"<div class='c{i}'>{menu()}</div>" for i in range(menus)]
    inner = "".join(f"<p>{p[:20]}<b>{p[20:]}</b></p>" if i % 2 else f"<p>{p}" for i, p in enumerate(body))
    article = f"<div><div class='content'><h1>Head</h1>{inner}</div></div>"
    parts.insert(rng.randint(0, menus), article)
    return f"<html><head><title>T</title><meta property='og:image' content='i.png'></head><body><nav>{menu()}</nav>{''.join(parts)}<footer><p>{words(30)}</p></footer><div class='related-list'><p>{words(40)}</p></div></body></html>", body


def test_the_article_among_menus():
    rng = random.Random(4)
    for _ in range(60):
        html, body = page(rng, rng.randint(0, 5), rng.randint(2, 20))
        found = tree.extracted(html)
        assert found["text"].split("\n\n") == body and found["title"] == "Head" and found["via"] == "block" and found["image"] == "i.png"


def test_fallbacks_and_odd_pages(spark):
    pages = ["<p>short one</p><div>and <a href='x'>more</a></div>", "", None, "no tags at all", "<div>" * 3000 + "<p>" + "deep words " * 30, "<body>bare text</body>", "<p>" + "x" * 200 + "</p>"]
    got = [r.a for r in spark.createDataFrame(list(enumerate(pages)), "i int, html string").orderBy("i").select(tree.article_of_page(F.col("html")).alias("a")).collect()]
    assert got[0].text == "short one\n\nand more" and got[0].via == "page"
    assert got[1].text is got[2].text is got[3].text is None and got[1].via is None
    assert got[4].text == ("deep words " * 30).strip() and got[5].text == "bare text" and got[6].text == "x" * 200


def test_articles_of_the_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", tree.article_of_page(F.col("html")).alias("a")).collect()
    for r in rows:
        menu = [n.text() for n in tree.select(tree.tree(r.html), "nav a")]
        if r.a.via == "block" and len(r.a.text) > 500:
            assert not any(f"\n\n{m}\n\n" in r.a.text for m in menu)
    assert sum(r.a.via == "block" for r in rows) > 0.7 * len(rows)


def test_pages_leave_no_trees_behind():
    """Trees refer to themselves; a task of many pages kept them until the collector of cycles came."""
    page = "<html><body><div>" + "<p>A paragraph of more than twenty-five letters, <a href='/x'>a link</a>.</p>" * 30 + "</div></body></html>"
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            assert tree.extracted(page)["via"] == "block"
        left = sum(isinstance(x, tree.Node) for x in gc.get_objects())
    finally:
        gc.enable()
    assert left < 200
