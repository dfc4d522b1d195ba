from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rwspark.llm.html_extract import Lines, content, extract, extract_pages

LONG = "This is a long paragraph of the article, with many words and few tags in it. " * 3


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><h1>T &am", "T &am"), ("<article>x &amp;lt; y &copy</article>", "x &lt; y ©"),
        ("<nav>m</nav><article><p> a \n b </p>c</article><footer>f</footer>", "a b\nc"),
        ("<article><p>a<script>var x='</p>';</script><style>p{}</style><p>b<aside>z</aside><form>q</form><section class=comments>c</section></article>", "a\nb"),
        ("<div class='ad'>buy<article><p>a</article>", "a"),
        ("<article>a</article><div>tail</div><article>b</article>", "a\nb"),
        ("<article><p>one<b>two</b> <i>three</i></p></article></body></html>", "onetwo three"),
    ],
)
def test_marked_articles(html, text):
    assert extract(html) == text


def test_regions_without_marks():
    html = f"<body><div class=menu><a>x</a></div><div><a>one</a> <a>two</a> <a>three</a></div><div id=main-text><p>{LONG}</p><p>Short.</p></div><div class='comment'>Nice!</div></body>"
    assert extract(html) == f"{LONG.strip()}\nShort."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "text ", "&amp", "&#x;", "<", "<!--", "-->", "<script>", "</script>", "<br/>", "<td>", "</b>", "<p/"]), max_size=20).map("".join))
def test_broken_markup_never_raises(html):
    assert isinstance(extract(html), str)


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, None, "c"), (None, "u", "", "c"), (2, "u", "<p>a</p>" * 20_000, "c"), (2, "u", "<p>a</p>", "c")], "page_id long, url string, html string, text string")
    got = extract_pages(rows).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 1, 39_999]
    assert extract_pages(rows.limit(0)).count() == 0


def lines_of(html):
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return [x for x in parser.lines if x[0]]


TEASERS = "<div><a href=1>Buy now</a> <a href=2>Deals</a> <a href=3>Shop</a></div>"


def test_threshold_decides_within_articles():
    """Blocks of links without telling names go; plain lists, headings and paragraphs with links stay; without the threshold nothing goes."""
    page = f"<article><h1>Title</h1><p>{LONG}</p>{TEASERS}<div class=x><p>{LONG}<a href=4>a source</a></p></div><h2>List</h2><ul><li>one</li><li>two</li></ul><ul><li><a>More</a></li><li><a>of this</a></li></ul><table><tr><td>1<td>2</table></article>"
    long = LONG.strip()
    assert extract(page) == f"Title\n{long}\n{long} a source\nList\none\ntwo\n1\n2"
    everything = "\n".join(t for t, _ in content(lines_of(page), 0.0))
    assert "Buy now Deals Shop" in everything and "More\nof this" in everything
    rich = f"<article><p>{LONG}</p><div><p>{LONG * 3}<a href=1>{LONG * 4}</a></p></div><p>{LONG}</p></article>"
    assert extract(rich).count("\n") == 2  # mostly a link, but its text is dense


def test_link_only_articles_are_kept():
    assert extract("<article><a href=1>only a link</a></article>") == "only a link"
    assert extract("<article><a href=1>never closed<p>text</p><div>more</div></article>") == "never closed\ntext\nmore"


def test_any_column_is_kept(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", "mine")], "page_id long, html string, text string")
    (r,) = extract_pages(rows, keep=("page_id", "text")).collect()
    assert (r.page_id, r.kept_text, r.text) == (1, "mine", "a")
