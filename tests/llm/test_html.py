import html
import re

import pytest
from pyspark.sql import functions as F

from akuru.llm import queries
from akuru.llm.html import blocks, content, extract

LONG = "A sentence of the article, with some words, and a clause; it goes on for a while. "


def brute(page):
    """The article element of the generator's pages, cut at its block tags by plain replacement."""
    inner = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
    inner = re.sub("</?(?:p|h1)>", "\0", inner).replace("<br>", " ").replace("<b>", "").replace("</b>", "")
    return "\n".join(t for b in inner.split("\0") if (t := re.sub(r"\s+", " ", html.unescape(b)).strip()))


def test_whole_query_equals_brute_force(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op3_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = brute(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p>Just&nbsp;one  &lt;b&gt; &#228;&amp;amp; block", "Just one <b> ä&amp; block"),
        ("<div id=menu><a>Home</a> <a>About us</a></div><div class='content'><h2>Title</h2><p>" + LONG * 3 + "</p><p>Short.</p><ul><li>One<li>Two</ul></div><div class=comments><p>" + LONG * 9 + "</p></div>", f"Title\n{(LONG * 3).strip()}\nShort.\nOne\nTwo"),
        ("<body><header><h1>Site</h1></header><main><article><header><h1>Head</h1></header><p>" + LONG + "</p><aside>See also</aside><form><p>Sign up now</p></form><p>End</p><footer>By me</footer></article></main></body>", f"Head\n{LONG.strip()}\nEnd"),
        ("<article><p>a<script>if (a < b) { x('</p>') }</script> b<!-- <p>no</p> --> c<br>d</p><div class='cookie-notice'>Accept</div></article>", "a b c d"),
        ("<article><p>unclosed <b>bold<p>next <i>one</article><footer>f</footer>", "unclosed bold\nnext one"),
        ("<article><div style='display:none'>x</div><p>5 < 6 & 7 > 2</p></article>", "5 < 6 & 7 > 2"),
        ("<main><div><ul><li>Home<li>About</ul></div><div><p>" + LONG * 3 + "</p></div><div><p>Foo Inc</p></div></main>", (LONG * 3).strip()),
        ("<div><a>Home</a> <a>Shop</a></div><div><p>" + LONG * 2 + "</p><p>Short.</p></div><div>Foo Inc</div>", (LONG * 2).strip() + "\nShort."),
        ("<article><div class='ad-hoc'>" + LONG + "</div></article>", LONG.strip()),
        ("<article><p>Hi there.</p><p class='share-price'>" + LONG * 4 + "</p></article>", "Hi there.\n" + (LONG * 4).strip()),
        ("<body><form id=page><div><p>" + LONG * 3 + "</p><p>More.</p></div></form></body>", (LONG * 3).strip() + "\nMore."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", "Let x=1 be."),
        ("<div class='page has-sidebar'><article><h1>T</h1><p>" + LONG + "</p></article><div class=sidebar><p>" + LONG + "</p></div></div>", "T\n" + LONG.strip()),
        ("<article><section><h2>One</h2><p>" + LONG * 5 + "</p></section><section><h2>Two</h2><p>Short one.</p></section><div class=comments><article><p>" + LONG * 9 + "</p></article></div></article>", f"One\n{(LONG * 5).strip()}\nTwo\nShort one."),
        ("<table><tr><td><ul><li><a>Home</a><li><a>Us</a></ul></td><td><h1>T</h1><p>" + LONG * 3 + "</p><table><tr><td>1<td>2</table></td></tr></table>", f"T\n{(LONG * 3).strip()}\n1\n2"),
        ("<p>a <span hidden>x</span> b</p>", "a b"),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


#: Made-up pages without any telling tag or name: (menu, text, closing line).
NEUTRAL = [
    ("<div><ul><li><a>Home</a><li><a>News</a><li><a>Contact us</a></ul></div>", "<div><h1>Title</h1><p>{}</p><p>Short.</p></div>", "<div>Foo Inc</div>"),
    ("<div><ul><li>Home<li>News<li>Contact us</ul></div>", "<div><h1>Title</h1><p>{}</p><p>Short.</p></div>", "<div><p>Foo Inc</p></div>"),
    ("<table><tr><td>Home<td>News</table>", "<section><h1>Title</h1><p>{}</p><p>Short.</p></section>", "<section><p>Foo Inc</p></section>"),
]


@pytest.mark.parametrize("menu, text, close", NEUTRAL)
def test_ratios_decide_where_nothing_has_a_telling_name(menu, text, close):
    page = blocks(f"<body>{menu}{text.format(LONG * 4)}{close}</body>")
    want = ["Title", (LONG * 4).strip(), "Short."]
    assert [b.text for b in content(page)] == want == [b.text for b in content(page, names=False)]
    assert [b.text for b in content(page, ratios=False)] != want


def test_ratios_alone_find_most_articles_of_the_given_pages(spark):
    """Without names only articles of a few dozen words are confused with the page's other sentences."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    text = lambda page, **off: "\n".join(b.text for b in content(blocks(page), **off))
    alone = sum(text(p, names=False) == brute(p) for p in pages)
    assert alone >= 0.75 * len(pages)
    assert sum(text(p, names=False, ratios=False) == brute(p) for p in pages) == 0


def test_long_and_broken_pages_end():
    assert extract("<p>" + "<b>" * 5000 + "x" + "<" * 2000).startswith("x")
    assert extract("<div>" * 3000 + LONG * 2000).count("sentence") == 2000
    assert extract("<script>never closed") == "" and extract(None) == ""


def test_edge_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>one two"), (2, "u", "<p>same"), (2, "u", "<p>same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    from akuru.llm.html import extract_pages

    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(0, "one two", 7), (1, "", 0), (2, "same", 4), (2, "same", 4)]
    assert extract_pages(df.limit(0)).count() == 0
