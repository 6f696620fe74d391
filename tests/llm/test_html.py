import html
import re

import pytest
from pyspark.sql import functions as F

from strandsift.llm import html_text, queries


def test_query_gives_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op8_html(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


BODY = "<p>" + "The main text runs on for quite some length here. " * 6 + "</p>"
MAIN = re.sub(r"\s+", " ", re.sub("<[^>]*>", "", BODY)).strip()

PAGES = {
    "furniture": (f"<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><article><h1>Head</h1>{BODY}<p>End.</p></article><aside>Side</aside><footer>Foot</footer></body></html>", f"Head\n\n{MAIN}\n\nEnd."),
    "classes": (f'<div class="cookie-notice"><p>We use cookies on this site to follow you about and about.</p></div><div id="sidebar"><p>More</p></div><main>{BODY}</main><div class="comments"><p>{"First comment by a reader. " * 9}</p></div>', MAIN),
    "no article": (f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div><h2>Title</h2>{BODY}{BODY}<p>Short.</p></div><p><a href=c>imprint</a></p></body>", f"Title\n\n{MAIN}\n\n{MAIN}\n\nShort."),
    "comments inside": (f'<article>{BODY}<section class="comments"><p>Nice!</p></section></article>', MAIN),
    "article header": ("<article><header><h1>Title</h1></header><p>Text</p><footer>by me</footer></article>", "Title\n\nText"),
    "references": ("<article><p>a &amp; b &#233; &#x41; &lt;p&gt; &nbsp; c &copy; &unknown;</p></article>", "a & b é A <p> c © &unknown;"),
    "scripts": ("<article><p>x</p><script>var a='</p><p>no</p>';</script><style>p{}</style><p>y</p><!-- <p>z</p> --></article>", "x\n\ny"),
    "unclosed": ("<article><p>one<p>two<br>three <b>four</article><footer>no", "one\n\ntwo three four"),
    "forms": ("<article><p>keep</p><form><p>Name</p><input name=n><textarea>x</textarea></form><button>Go</button></article>", "keep"),
    "advert": ('<article><p>one</p><div class="ad">Buy</div><p>two</p></article>', "one\n\ntwo"),
    "lists and tables": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n  f</pre></article>", "a\n\nb\n\nc\n\nd\n\ne f"),
    "odd signs": ("<article><p>1 < 2 and 3 > 2 <3</p></article>", "1 < 2 and 3 > 2 <3"),
    "open comment": ("<article><p>a</p><!-- never closed <p>b</p></article>", "a"),
    "hidden": ('<article><p>a</p><div style="display: none"><p>b</p></div><p hidden>c</p></article>', "a"),
    "menu never closed": (f"<nav><ul><li><a>x</a></ul><article>{BODY}</article>", MAIN),
    "frames keep": (f'<div class="layout has-sidebar overflow-hidden"><div class="main-content"><article class="post"><div class="entry-header"><h1>T</h1></div><p data-role="comment" class="lead share">a</p>{BODY}<p class="ad">b</p></article></div><div class="right-sidebar">{BODY}</div></div>', f"T\n\na\n\n{MAIN}"),
    "readers' articles": (f'<main><article><h1>A</h1>{BODY}</article><section id="comments"><article class="comment"><p>mine</p></article></section></main>', f"A\n\n{MAIN}"),
    "nothing": ("<nav>menu</nav>", ""),
    "plain": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_cases(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def test_hard_input_takes_linear_time():
    for page in ("<" * 200_000, "<!--" * 100_000, "<a b='" * 50_000, "<p>" * 100_000, "&" * 200_000, "<div class='x'>" * 20_000, "<span class='ad'>x" * 50_000, "<span class='ad' <b>" * 50_000):
        html_text.main_text(f"<article>{page}")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<article><p>x</p></article>"), (3, "<article><p>x</p></article>"), (None, "<article>y</article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("main_text", F.lit("old"))
    got = sorted((r.page_id or 0, r.main_text) for r in html_text.extract(df).collect())
    assert got == [(0, "y"), (1, ""), (2, ""), (3, "x"), (3, "x")] and html_text.extract(df.limit(0)).count() == 0


def test_a_marked_teaser_is_not_the_article():
    for mark in ("<article><p>Read also this.</p></article>", "<main><h1>Head</h1></main>"):
        assert f"{MAIN}\n\n{MAIN}" in html_text.main_text(f"<body>{mark}<div>{BODY}{BODY}</div></body>")


def test_windows_find_what_marks_tell():
    """Pages whose marks are taken away, or count for nothing, have the same text, found by the windows alone."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    bare = [re.sub(r"</?(?:article|main)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", x) for x in pages]
    assert all("<article" in x for x in pages) and not any("<article" in x or "<main" in x for x in bare)
    same = [html_text.main_text(x) == html_text.main_text(y) == html_text.main_text(x, mark=0) for x, y in zip(pages, bare, strict=True)]
    assert sum(same) >= 0.95 * len(same)


def test_windows_overrule_a_mark():
    """What is marked is neither all nor only what is taken: text as long beside it stays, and marked lines that are too
    short for a surge, and away from it, go."""
    assert html_text.main_text(f"<body><article>{BODY}</article><div>{BODY}<p>End.</p></div></body>") == f"{MAIN}\n\n{MAIN}\n\nEnd."
    far = "<article><p>Read me.</p></article>" + "<div><p><a href=x>a link</a></p></div>" * 9
    assert html_text.main_text(f"<body>{far}<div>{BODY}{BODY}</div></body>") == f"{MAIN}\n\n{MAIN}"


def test_forms_titles_and_names_inside_articles():
    assert html_text.main_text(f"<form action=x><input name=q><article><h1>T</h1>{BODY}</article></form>") == f"T\n\n{MAIN}"
    assert html_text.main_text(f"<form><p>Your name</p></form><div>{BODY}</div>") == MAIN
    assert html_text.main_text(f'<article>{BODY}<div class="related-work"><p>Others did this.</p></div><section id="search"><p>We search.</p></section><div class="related-posts"><p>More</p></div></article>') == f"{MAIN}\n\nOthers did this.\n\nWe search."
    assert html_text.main_text(f"<div><h1>Title</h1></div><div>{BODY}{BODY}</div>") == f"Title\n\n{MAIN}\n\n{MAIN}"


def test_nothing_else_is_dropped():
    page = f'<article><p>x <math><mi>y</mi><mo>+</mo><mn>1</mn></math> z</p><p class="search-results">kept?</p><p class="share rail">and this</p><p class="ad">no</p>{BODY}<p>now see <a href=a>one link</a> and then <a href=b>another link here</a></p></article>'
    want = f"x y+1 z\n\nkept?\n\nand this\n\n{MAIN}\n\nnow see one link and then another link here"
    assert html_text.main_text(page) == want and html_text.main_text(page.replace("article", "div")) == want
