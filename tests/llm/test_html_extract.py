"""Operator 1: declared articles against the pages' known layout, differencing, odd pages."""

import html
import random
import re

import pytest

from tagwave.llm import html_extract
from tagwave.llm.html_extract import extract, page_lines, shared_lines

SF = "/root/testdata/sf0.001"


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for r in rows:
        article = r.html[r.html.index("<article>"):].split("</article>")[0]
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"<(?!/?b>)[^>]*>", article.replace("</b>", ""))]
        expected = " ".join(x for x in (b.replace("<b>", "") for b in blocks) if x)
        assert out[r.page_id].text == expected and out[r.page_id].n_chars == len(expected)


def test_furniture_is_left_out():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="home"><nav>menu<nav>in</nav></nav>
      <div class="cookie-notice">We use <b>cookies</b></div><script>var a="<p>no</p>";</script>
      <main><article><header><h1>Head&amp;line</h1></header><p>One <i>t</i>wo&nbsp; 1 &lt; 2<p>three<br>four
      <form>ask</form><div id='comments'><div>first!</div></div></article></main>
      <aside>side<p>bar</aside><footer>&copy; x</footer>"""
    assert [x for x, zone in page_lines(page) if zone == 2] == ["Head&line", "One two 1 < 2", "three", "four"]
    assert page_lines("<nav>open <article><p>text</article>")[0] == ("text", 2)
    assert page_lines("a < b <script>never closed") == [("a < b", 0)]
    assert page_lines(None) == page_lines("") == page_lines("<p></p>") == []


def test_furniture_without_end_tags():
    lines = lambda page: [x for x, _ in page_lines(page)]
    assert lines("<p class=notice>Note<p>Body<p>more") == ["Body", "more"]
    assert lines("<ul><li class=share>Share<li>One<li>Two</ul>Body") == ["One", "Two", "Body"]
    assert lines("<ul><li>One<li class=share>Share</ul>Body") == ["One", "Body"]
    assert lines("<div><div class=ad>Buy</div>a</div>b") == ["a", "b"]
    assert lines("<section><div class=ad>Buy<div>now</div></section>Body") == ["Body"]
    assert lines("<dl><dt class=ad>x<dd>y</dl><table><tr><td class=ad>Buy<td>Cell<tr class=ad><td>z<tr><td>w</table>") == ["y", "Cell", "w"]
    assert page_lines("<div><div class=ad>Buy<article><p>Text</article></div>") == [("Text", 2)]
    assert page_lines("<article>Text</article><div class=related><article>Other</article></div>end") == [("Text", 2), ("end", 0)]


def test_shared_lines_have_the_length_of_an_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = shared_lines(a, b)
        kept = [x for x, s in zip(a, shared) if s]
        assert len(kept) == best[-1][-1]
        it = iter(b)
        assert all(x in it for x in kept)


def test_differencing_without_declared_article(spark):
    def page(i, body):
        return f"<body><div>Site name</div><div>Home</div><p>{body}</p><p>more {i}</p><div>All rights reserved</div></body>"

    rows = [(i, f"https://h.example.com/a/{i:03}", page(i, f"story {i} " * 9)) for i in range(12)]
    rows += [(100, "http://other.example.com/x", page(100, "alone")), (101, None, None), (102, "http://h.example.com/", ""),
             (103, "https://h.example.com/a/003", page(3, "story 3 " * 9))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in extract(df).collect()}
    for i in range(12):
        assert out[i] == f"{'story %d ' % i * 9}more {i}"
    assert out[103] == out[3]
    assert out[100] == "Site name Home alone more 100 All rights reserved"  # no neighbour on its host
    assert out[101] == out[102] == ""


def test_declared_article_only_arbitrates(spark):
    def page(i, article, body):
        return f"<body><div>Site name</div><article>{article}</article><p>{body}</p><div>All rights reserved</div></body>"

    teaser = "<p>Read our magazine"
    rows = [(i, f"https://h.example.com/a/{i:03}", page(i, teaser, f"story {i} " * 9)) for i in range(5)]
    # shared paragraphs of a declared article with text of its own are content, as is an article with one neighbour
    rows += [(10 + i, f"https://g.example.com/a/{i:03}", page(i, f"<p>Both have this<p>{f'own {i} ' * 9}", f"next {i}")) for i in range(3)]
    rows += [(20 + i, f"https://e.example.com/a/{i:03}", page(i, teaser, f"story {i} " * 9)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in extract(df).collect()}
    assert [out[i] for i in range(1, 4)] == [("story %d " % i * 9).strip() for i in range(1, 4)]
    assert [out[10 + i] for i in range(3)] == ["Both have this " + (f"own {i} " * 9).strip() for i in range(3)]
    assert out[20] == out[21] == "Read our magazine"


def test_alignment_in_halves_is_an_lcs(monkeypatch):
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
        monkeypatch.setattr(html_extract, "LCS_BITS", 2**28)
        whole = shared_lines(a, b)
        monkeypatch.setattr(html_extract, "LCS_BITS", 20)
        parts = shared_lines(a, b)
        assert sum(parts) == sum(whole)
        it = iter(b)
        assert all(x in it for x in [x for x, s in zip(a, parts) if s])


@pytest.mark.parametrize("n", [0, 2])
def test_empty_and_repeated(spark, n):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "k", 2)] * n, "page_id bigint, url string, html string, key string, host int")
    out = extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in out] == [(1, "u", "x", 1)] * n
