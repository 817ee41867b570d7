from __future__ import annotations

import html
import random
import re

import pyarrow.parquet as pq
import pytest

from viewforge.llm import html_text as H


def cost(content, boiler, arcs, side):
    own = sum(boiler[k] if inside else content[k] for k, inside in enumerate(side))
    return own + sum(forth if side[x] else back for x, y, forth, back in arcs if side[x] != side[y])


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        content, boiler = ([rng.random() * 2 for _ in range(n)] for _ in range(2))
        arcs = [(i, j, rng.random(), rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        least = min(cost(content, boiler, arcs, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(content, boiler, arcs, H.minimum_cut(content, boiler, arcs)) - least) < 1e-4


ARTICLE = "<html><head><title>T</title><style>p</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>{}<footer>&copy; x</footer></body></html>"
CASES = [
    ("<article><h1>Title</h1><p>One &amp; two&nbsp;\n three.<p>Four<br>five</article>", "Title One & two three. Four five"),
    ("<article><header><h1>T</h1></header><p>Text.</p><aside>No</aside><form><p>No</p></form></article>", "T Text."),
    ("<article><p>Text.</p><div class='cookieNotice'>No</div><section id='comments'><p>No, never.</p></section></article>", "Text."),
    ("<article><p>Text</p><script>var a = '</p>';</script><!-- no --><p hidden>No</p><div class=ad>No</div></article>", "Text"),
    ("<article><p>a <b>b<p>c</article>", "a b c"),
    ("<article><p title='a > b'>x &lt;p&gt; y</p></article>", "x <p> y"),
    ("<main><table><tr><td>a<td>b</table><ul><li>c<li>d</ul></main>", "a b c d"),
]


@pytest.mark.parametrize("body,want", CASES)
def test_articles(body, want):
    assert H.main_text(ARTICLE.format(body)) == want


PROSE = "Some long paragraph of text, with commas, and stops. It goes on and on, for a while, so as to be content."
FRAMED = [
    f"<div class='post has-sidebar'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div>",
    f"<main class='search-results comments-open'><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></main>",
    f"<form action=x><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p><input name=a></form>",
    f"<div class='sidebar-layout'><h1>Title</h1><div class=entry-content><p>{PROSE}</p><p>{PROSE}</p></div></div>",
]


@pytest.mark.parametrize("body", FRAMED)
def test_frames_keep_their_article(body):
    assert H.main_text(ARTICLE.format(body)) == f"Title {PROSE} {PROSE}"
    assert H.main_text(f"<html><body>{body}</body></html>") == f"Title {PROSE} {PROSE}"


def test_boilerplate_in_and_around():
    for inside in ("aside", "nav", "footer", "form", "div class=comments", "section id='reader-comments'", "div class='cookie-notice'", "div class=related", "div class='ad-box'", "ul class=menu"):
        name = inside.split()[0]
        assert H.main_text(ARTICLE.format(f"<article><h1>Title</h1><p>{PROSE}</p><{inside}><p>{PROSE}</p><p>Hm, no.</p></{name}><p>{PROSE}</p></article>")) == f"Title {PROSE} {PROSE}", inside
        assert H.main_text(ARTICLE.format(f"<article><p>Short</p></article><{inside}>{f'<p>{PROSE}</p>' * 9}</{name}>")) == "Short", inside
    assert H.main_text(f"<nav>{PROSE}</nav><footer><p>{PROSE}</p></footer>") == ""


def test_cut_overrules_the_classifier():
    """Short blocks of an article lean to boilerplate by themselves, an advert's prose to content."""
    page = ARTICLE.format(f"<div class=ad>{PROSE}</div><article><h1>Title</h1><p>{PROSE}</p><p>Hm.</p><p><a href=x>The source</a></p></article>")
    found = {text: (inside, alone) for text, inside, alone in H.labelled(page)}
    assert found["Hm."] == found["The source"] == (True, False)
    assert [inside for text, inside, alone in H.labelled(page) if text == PROSE and alone] == [False, True]
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    labels = [x for row in pages for x in H.labelled(row["html"])]
    assert sum(inside != alone for _, inside, alone in labels) > 0.1 * len(labels)


def test_deep_and_wide():
    deep = "<div>" * 100_000
    assert H.main_text(f"{deep}<p>{PROSE}</p>") == PROSE
    assert H.main_text("".join(f"<div>{PROSE}" for _ in range(3000))) == " ".join([PROSE] * 3000)
    assert H.main_text(f"<article>{f'<p>{PROSE}</p><p>No</p>' * 3000}</article>") == " ".join([f"{PROSE} No"] * 3000)


def test_without_article():
    long = "Some long paragraph of text, with commas, and stops. It goes on and on, for a while, so as to be content."
    page = f"<body><div class=menu><a>Home</a> <a>About</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div><a href=1>More</a> <a href=2>Links</a></div>"
    assert H.main_text(page) == f"{long} Short. {long}"


@pytest.mark.parametrize("page", [None, "", "<", "<a", "<!-- x", '<p "', "</", "&amp", "<script>x", "<article", "<" * 5000, "<a '" * 3000, "<div>" * 3000])
def test_junk(page):
    assert isinstance(H.main_text(page), str)


def test_pages():
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(?:</article>|<footer)", row["html"], re.S)[1]
        parts = (" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:h1|p|b|br)>", article))
        assert H.main_text(row["html"]) == " ".join(filter(None, parts))


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>é x</p></article>", 3), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")
    out = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(rows).collect()}
    assert out == {1: ("u", "é x", 3), 2: (None, "", 0)}
    assert H.extract(rows.limit(0)).count() == 0
