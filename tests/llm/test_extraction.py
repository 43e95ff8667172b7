import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moundworks.llm import extraction

LONG = "The first paragraph of the story, with commas, runs on for long enough to be read as prose by any rule of thumb."
NEXT = "A second one follows it, and says a little more about the same thing, so that the block of text has some weight."


def text(html):
    return extraction.main_text(html).split("\n")


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def plain(html):
    """The article element of a well-formed page of the given tables, cut at its block tags."""
    out = []
    for part in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]):
        out.append(" ".join(unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split()))
    return "\n".join(x for x in out if x)


def test_given_pages(spark):
    from conftest import DATA
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r.page_id: r for r in extraction.extracted(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        assert found[r.page_id].text == plain(r.html) and found[r.page_id].n_chars == len(plain(r.html)) and found[r.page_id].url == r.url


def test_divs_without_an_article_element():
    html = page(f"""
      <header id="masthead"><a href="/">Site</a><h1>The Site</h1></header>
      <div class="top-nav"><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></div>
      <div id="wrap"><div class="post"><div class="entry-header"><h2>Title</h2><span>by A. Writer</span></div><p>{LONG}<p>{NEXT}<ul><li>one<li>two</ul><blockquote>Said so.</blockquote><p>End.</div>
        <div class="sidebar-right"><h3>More</h3><p>{LONG} {LONG}</p></div></div>
      <div class="cookie-notice"><p>We use cookies, and more cookies, and we say so at some length, here, and again, here.</p></div>
      <div id="comments"><h3>2 comments</h3><div class="comment"><p>{LONG} {LONG} {LONG}</p></div></div>
      <form><p>Subscribe, please, to this, and that.</p><input name=q><button>Go</button></form>
      <footer>&copy; Site</footer>""")
    assert text(html) == ["Title", LONG, NEXT, "one", "two", "Said so.", "End."]


def test_parts_inside_the_article_that_are_none_of_it():
    html = page(f"""<nav>Menu</nav><main><article class="post has-sidebar"><header><p class="byline">By A. Writer</p><h1>Head &amp; line</h1></header>
      <p>{LONG}</p><aside>Aside, aside, aside.</aside><div class="ad-slot"><p>Buy, buy, buy, and buy again, for a price.</p></div>
      <script>var x = "</p><p>no</p>";</script><style>p {{ color: red }}</style><noscript><p>Turn it on.</p></noscript>
      <p hidden>Hidden.</p><p style="display: none">Hidden too.</p><div aria-hidden="true">And this.</div><div role="navigation">Go</div>
      <figure><img src=x alt="no"><figcaption>A caption.</figcaption></figure><p>{NEXT}</p>
      <div class="share-buttons"><a href=x>Share</a></div><section class="related"><article><p>{LONG}</p></article></section>
      <section id="comments"><article class="comment"><p>{LONG}</p></article></section><footer>Filed under x</footer></article></main>""")
    assert text(html) == ["Head & line", LONG, "A caption.", NEXT]


def test_link_lists_lose_to_prose_and_siblings_are_kept():
    links = "".join(f'<li><a href="/{i}">A headline, with commas, of some other story, number {i}</a></li>' for i in range(40))
    html = page(f"<div><ul>{links}</ul></div><div id=x><div><p>{LONG}</p><p>{NEXT}</p></div><h2>Part two</h2><div><p>{LONG}</p></div><div><a href=y>{NEXT}</a></div></div>")
    assert text(html) == [LONG, NEXT, "Part two", LONG]


def test_references_white_space_and_blocks():
    html = page(f"<article><p>a &lt;b&gt; &quot;c&quot; &#233;&#x4f60;&nbsp;&amp;amp; &copy d &bogus; e&am</p><p>one<br>two\n\t three<b>fo</b>ur</p><div>loose <i>text</i><p>{LONG}</p>tail</div><pre>x\n  y</pre></article>")
    assert text(html) == ['a <b> "c" é你 &amp; © d &bogus; e&am', "one two threefour", "loose text", LONG, "tail", "x y"]


def test_broken_markup():
    for html in (f"<article><p>{LONG}<p>{NEXT}", f"</div></p><article><b><p>{LONG}</i></b></p></article></article><p>{NEXT}",
                 f'<article><p class="x>{LONG}</p><p>{NEXT}</p></article>', f"<article><p>{LONG} a < b <3 <</p><p>{NEXT}</p></article>"):
        assert any(NEXT in x or LONG in x for x in text(html))
    assert text(f"<article><p>{LONG} a < b</p><p>1<2</p></article><!-- open") == [f"{LONG} a < b", "1<2"]
    assert text("<article><script>never closed <p>x</p>") == [""]
    assert text("just text") == ["just text"] and text("") == [""] and text(None) == [""] and text("<p>") == [""]
    assert text("<div>" * 5000 + LONG + "</div>" * 5000) == [LONG]


def test_short_articles_and_pages_of_menus_only():
    assert text(page("<nav><a href=x>a, b, c</a></nav><div class=ad>Buy, buy.</div><article><h1>Hi.</h1><p><b>Hi.<br></article><footer>f</footer>")) == ["Hi.", "Hi."]
    assert text(page("<nav><ul><li>a</ul></nav><footer>b</footer><form>c</form>")) == [""]


def test_linear_in_odd_input():
    for html in ("<a " * 200_000, "<a \"" * 100_000, "<!--" * 100_000, "<" * 300_000, "</p>" * 50_000, "<p>x" * 50_000, "<li>" * 50_000, "&" * 300_000):
        extraction.main_text(html)


@settings(max_examples=300)
@given(st.lists(st.sampled_from([*"<>/!-=\"' ab&;#x1", "<p>", "</p>", "<div>", "</div>", "<article>", "<b>", "<table>", "<td>", "<li>", "<script>", "</script>", "<br>", "<h1>"]),
                max_size=60).map("".join))
def test_any_input_gives_lines_without_outer_space(html):
    found = extraction.main_text(html)
    assert found == "\n".join(" ".join(x.split()) for x in found.split("\n")) and "\n\n" not in found and found == found.strip()


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x", "y"), (1, "u", page(f"<article><p>{LONG}</p></article>"), "x", "y"), (None, None, None, None, None), (2, "v", "", "", ""),
            (3, None, page("<article>" + "<p>a, b</p>" * 50_000 + "</article>"), "t", "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars string")
    found = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extraction.extracted(pages).collect()))
    assert found == [(0, "", "", 0), (1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, "v", "", 0), (3, "", "\n".join(["a, b"] * 50_000), 5 * 50_000 - 1)]
    assert extraction.extracted(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert extraction.extracted(pages.limit(0)).count() == 0
    texty = pages.select(F.concat(F.lit("k"), "page_id").alias("page_id"), "url", "html")
    assert {r.page_id for r in extraction.extracted(texty).collect()} == {"k1", "k2", "k3", None}
