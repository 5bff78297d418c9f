import html
import random
import re
import time

import pytest

from chronolode.llm import html_text as op

SF = "/root/testdata/sf0.01"


def article(page):
    """The template of the tables, taken apart by hand: headings and paragraphs of the only article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op.op2_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages) and all((r.text, r.url, r.n_chars) == (article(pages[r.page_id].html), pages[r.page_id].url, len(r.text)) for r in rows)


def test_page_without_article_element():
    page = """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body><div class="topnav"><a>Home</a> <a>About</a></div>
    <div class="cookie-banner">We use cookies &amp; more on this site, accept all of them</div><div class="post"><h1>My &lt;title&gt;</h1>
    <p>First para with <b>bo</b>ld and <a href="x>y">link text</a>.</p><div class="ad">Buy now great stuff</div><p>Second&nbsp;para<br>line   two</p><!-- <p>hidden</p> -->
    <form><input><p>Subscribe to our list</p></form><ul><li>one item<li>two item</ul><p>End.</p></div>
    <div id="comments"><h3>Comments</h3><p>Great post I liked it very much indeed yes really</p></div><footer>copy</footer></body></html>"""
    assert op.main_text(page) == "My <title>\n\nFirst para with bold and link text.\n\nSecond para line two\n\none item\n\ntwo item\n\nEnd."


@pytest.mark.parametrize("inner", ['<aside><p>{}</p></aside>', '<div class="sidebar">{}</div>', '<div role="complementary">{}</div>', '<section class="comments"><p>{}</p></section>', "<nav>{}</nav>", '<p hidden>{}</p>', '<div style="display: none">{}</div>', "<style>{}</style>", '<div class="newsletter-signup">{}</div>'])
def test_parts_inside_an_article_stay_out(inner):
    noise = " ".join(f"noise{i}" for i in range(60))
    page = f"<body><main><article><h1>Head</h1><p>One two three.</p>{inner.format(noise)}<p>Four five.</p></article></main><footer>{noise}</footer></body>"
    assert op.main_text(page) == "Head\n\nOne two three.\n\nFour five."


def test_short_article_beside_long_advert():
    page = '<body><nav><a>Home</a></nav><div class="ad">' + "buy " * 80 + "</div><article><h1>Hi</h1><p>Yes.</article><footer>&copy; " + "long " * 90 + "</footer></body>"
    assert op.main_text(page) == "Hi\n\nYes."


@pytest.mark.parametrize("page, want", [("", ""), ("<html></html>", ""), ("plain words only", "plain words only"), ("<p>a &lt;b&gt; &#233;&#x41; &amp;amp;</p>", "a <b> éA &amp;"), ("<p>open <b>never <i>closed", "open never closed"), ("a < b and c > d", "a < b and c > d"), ("</p></div>x", "x")])
def test_odd_pages(page, want):
    assert op.main_text(page) == want


def test_best_region_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        a, b = op.best_region(scores)
        assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_weights_are_learned_and_have_their_signs():
    by = op.weights()
    assert all(w < 0 for w in by.tags.values()) and by.features["tag article"] > 0 > by.features["tag nav"] and by.features["links"] < 0
    assert by.own("div", ' class="content"', False) > 0 > by.own("div", ' class="post-comments"', False) > by.own("div", " hidden", False) == op.OUT


WORDS = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize("page, want", [
    (f'<div id="content" class="search-results-guide"><h1>Head</h1><p>{WORDS}</p></div>', f"Head\n\n{WORDS}"),
    (f'<article><p>{WORDS}</p><div class="privacy-report">{WORDS}</div><p>End.</p></article>', f"{WORDS}\n\n{WORDS}\n\nEnd."),
    ('<article><p>one two <span class="share">buy</span> three four</p></article>', "one two three four"),
    ("<article><p>one\0two</p></article>", "one\0two"),
    (f'<div class="page has-sidebar"><div class="sidebar"><p>{WORDS}</p></div><main><h1>Head</h1><p>Text here.</p></main></div>', "Head\n\nText here."),
    (f'<article><h1>Head</h1><p>Text here.</p><div class="post-comments"><p>{WORDS}</p></div></article>', "Head\n\nText here."),
    (f'<article class="teaser"><p>Short one.</p></article><div id="content"><p>{WORDS}</p><p>{WORDS}</p></div>', f"{WORDS}\n\n{WORDS}"),
    (f'<form id="all"><div class="nav-menu"><a>a</a><a>b</a><a>c</a></div><div id="main"><p>{WORDS}</p></div></form>', WORDS),
    (f'<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{WORDS}</p>', WORDS),
    ('<p>a<wbr>b <svg><text>no</text></svg>c</p><p>x <b><i>y</b> z</i> <a href="u>v">w</a> <a title="open>q</a></p>', "ab c\n\nx y z w q"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>", "a b\n\nc\n\nd\n\ne"),
])
def test_scores_not_words_decide(page, want):
    assert op.main_text(page) == want


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a "' * 250_000 + ">", '<a "<>"' * 130_000 + '"', "<div>" * 200_000, "<b>" * 300_000 + "<p>x" * 1000, "<!--" * 250_000, "<a class='" * 100_000, "<div>x" * 50_000 + "</p>" * 50_000 + "</div>" * 60_000, "<ul><li>" * 60_000])
def test_time_grows_with_the_page(page):
    """Pages of about a megabyte that would take minutes if their time grew with the square."""
    began = time.process_time()
    op.main_text(page)
    whole = time.process_time() - began
    began = time.process_time()
    op.main_text(page[: len(page) // 8])
    assert whole < 16 * (time.process_time() - began) + 0.5


def test_nulls_repeats_long_and_clashes(spark):
    long = "<article>" + "<p>word</p>" * 40_000 + "</article>"
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, _text string")
    got = op.extract(df).collect()
    assert sorted(len(r._text) for r in got) == [0, 0, 1, 40_000 * 6 - 2] and op.extract(df.limit(0)).count() == 0
