import html
import re
import time

import pytest

from cadence.llm.extraction import extract_pages, main_text, op12_block_rules, page_blocks

SF = "/root/testdata/sf0.01"
LONG = "The people of the town were told that it would be closed for the winter, and most of them had been at the meeting where this was said by the mayor. " * 2
SHORT = "It was so."
LONG2 = "After the war there was a time in which all of the houses that stood on the hill were empty, but they would not be for long, as she said to her son. " * 2


def between(page):
    """The article of the tables' pages: they have one article element of a heading and paragraphs."""
    inner = page[page.index("<article>") : page.index("</article>")].replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|</?h1>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    want = {r.page_id: (r.url, between(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op12_block_rules(spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


AROUND = [
    '<nav><a href="/">Home</a> and the rest of it</nav>',
    f"<header><p>{LONG}</p></header>",
    f'<div class="cookie-notice"><p>{LONG}</p></div>',
    f'<div id="sidebar-left"><p>{LONG}</p></div>',
    f'<div class="advert">{LONG}</div>',
    f"<aside><p>{LONG}</p></aside>",
    f"<form><p>{LONG}</p><label>Name of the user</label><select><option>one<option>two</select></form>",
    f'<section class="comments"><article class="comment"><p>{LONG}</p></article></section>',
    f'<div id="comments"><div><p>{LONG}</p></div></div>',
    f"<footer><p>{LONG}</p></footer>",
    f"<script>var a = '<p>{LONG}</p>';</script><style>p {{ }}</style><noscript><p>{LONG}</p></noscript><!-- <p>{LONG}</p> -->",
    f'<div role="alert"><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><p style="display: none">{LONG}</p><template><p>{LONG}</p></template>',
    '<ul><li><a href="/a">One link among the many</a></li><li><a href="/b">And the other one of them</a></li></ul>',
]
TEXT = f"A heading\n\n{LONG.strip()}\n\n{SHORT}\n\n{LONG2.strip()}"
ARTICLE = f"<h1>A heading</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG2}</p>"


@pytest.mark.parametrize("extra", AROUND)
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class='content'>{}</div>", "<main>{}</main>"])
def test_what_is_around_goes(extra, shell):
    for page in (extra + shell.format(ARTICLE), shell.format(ARTICLE) + extra, shell.format(ARTICLE + extra)):
        assert main_text(f"<html><body class='has-sidebar menu-open'>{page}</body></html>") == TEXT


def test_markup_that_is_not_closed():
    assert main_text(f"<article><h1>A heading<p>{LONG}<p><b>{SHORT}<p>{LONG2}") == TEXT
    assert main_text(f"<body><nav><ul><li><a href=/a>Home<li><a href=/b>Shop</ul><article>{ARTICLE}") == TEXT
    assert main_text(f"<form id=page><div><article>{ARTICLE}</article></div></form>") == TEXT
    assert main_text(f"<form id=page><div>{ARTICLE}</div></form>") == TEXT
    assert main_text(f"<header><nav>Menu</nav><h1>A heading</h1></header><article><header><h2>B</h2>by C</header><p>{LONG}</p></article>") == "B\n\n" + LONG.strip()


def test_references_spaces_and_odd_tags():
    page = "<article><p>a &lt;b&gt; &amp;amp; &copy &#65;&#x42;&nbsp;\n\t c<br>d<b>e</b>f < g</p><p> \n </p><pre> x\n y </pre></article>"
    assert main_text(page) == "a <b> &amp; © AB c def < g\n\nx y"
    assert main_text('<article><p title="a > b">one</p><P CLASS=x>two</P><p>3 <i>4</i></p></article>') == "one\n\ntwo\n\n3 4"
    assert main_text("<p>only</p>") == "only" and main_text("bare words") == "bare words"
    assert main_text("<p>one</p><") == "one\n\n<" and main_text("<p>one <b class='x") == "one"
    assert main_text("") == main_text(None) == main_text("<nav>x</nav>") == main_text("<!-- x") == main_text("<script>x") == ""


def test_time_is_linear():
    n = 100_000
    for page in ("<!-- x " * n, '<a title="' * n, "<" * n, "</" * n, "<div>" * n + "x", "<b>" * n + "x" + "<p>y</p>" * 1000, "<p>" * n, "<script>" * n, "<li>" * n, "&" * n, "<a b='" * n + ">", "word " * 20 * n):
        began = time.perf_counter()
        main_text("<article><p>" + page)
        assert time.perf_counter() - began < 10, page[:12]


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (3, "v", f"<article>{ARTICLE * 4000}</article>"), (4, "w", "<nav>a</nav>")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id long, url string, html string, text string, n_chars int, block int")
    got = extract_pages(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in got) == sorted([("1", "u", 0), ("2", "None", 0), ("None", "u", 1), ("None", "u", 1), ("3", "v", 4000 * (len(TEXT) + 2) - 2), ("4", "w", 0)])
    assert extract_pages(df.limit(0)).count() == 0
    blocks = page_blocks(df).where("page_id = 4").collect()
    assert [(b.text, b.first, b.label) for b in blocks] == [("a", "marked", "bad")] and page_blocks(df.limit(0)).count() == 0
