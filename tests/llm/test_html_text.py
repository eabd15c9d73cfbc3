import html as entities
import os
import re

import pytest

from wakeline.llm import html_text as x

DATA = "/root/testdata/sf0.001"

LONG = "A sentence of some length that reads like an article does. "


def test_article_without_the_rest():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; save</div><div class="cookie-notice">We use cookies</div>
    <article><header><h1>The   title</h1></header><p>{LONG * 3}&eacute;&#39;s<br>next</p><p>Short.<div>In <b>a</b> div</div><ul><li>one<li>two</ul>
    <aside>related</aside><form><p>Subscribe</p></form><p hidden>no</p></article>
    <section id="comments"><article><p>{LONG * 4}</p></article></section><footer>&copy; x</footer></body></html>"""
    assert x.extract(html) == "\n\n".join(["The title", (LONG * 3) + "é's next", "Short.", "In a div", "one", "two"])


@pytest.mark.parametrize("name", ["elementor-widget-container", "search-results", "overlay", "share", "copyright disclaimer", "comments-open"])
def test_a_name_around_the_whole_article_loses_nothing(name):
    assert x.extract(f'<body><nav><a>m</a></nav><div class="{name}"><h1>Title</h1><p>{LONG * 3}</p><p>Short.</p></div><footer>c</footer></body>') == "\n\n".join(["Title", (LONG * 3).strip(), "Short."])


def test_a_telling_name_only_lowers_the_score():
    body = f"<h1>Title</h1><p>{LONG * 3}</p>{{}}<p>{LONG * 4}</p>"
    page = "<body><article>" + body + "</article></body>"
    section = f'<div class="related-work"><h2>Related work</h2><p>{LONG * 9}</p><p>{LONG * 9}</p></div>'
    assert "Related work\n\n" + (LONG * 9).strip() in x.extract(page.format(section))
    links = '<div class="related"><a href=1>one thing</a><br><a href=2>other</a></div>'
    advert = '<div class="ad">Buy this now.</div>'
    assert x.extract(page.format(links)) == x.extract(page.format(advert)) == x.extract(page.format(""))


def test_a_list_of_links_in_an_article_goes_and_other_lists_stay():
    page = f"<body><article><p>{LONG * 3}</p>{{}}<p>{LONG * 4}</p></article></body>"
    links = "<ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li><li><a>d</a></li></ul>"
    assert x.extract(page.format(links)) == x.extract(page.format(""))
    assert "\n\none\n\ntwo\n\n" in x.extract(page.format("<ul><li>one</li><li>two</li></ul>"))
    assert "\n\nsee this there\n\n" in x.extract(page.format("<p>see <a>this</a> there</p>"))
    assert "\n\na title in a link\n\n" in x.extract(page.format("<h2><a>a title in a link</a></h2>"))


def test_formulas_stay():
    assert x.extract(f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == LONG + "x=2 holds."


def test_comments_alone_are_a_page():
    assert x.extract(f'<body><div id="comments"><p>{LONG}</p></div></body>') == LONG.strip()


def brute(html):
    """The given pages by patterns instead of parser events: what their one article element holds, cut at its block tags."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"(?i)</?(?:p|h[1-6]|ul|ol|li|div|blockquote|section|table|tr|td|pre)\b[^>]*>", inside)
    plain = [entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br[^>]*>", " ", b))) for b in blocks]
    return "\n\n".join(t for b in plain if (t := " ".join(b.split())))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_given_pages_by_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in x.op9_html_text(spark, DATA).collect()}
    articles = {r.page_id: brute(r.html) for r in rows if r.html and r.html.count("<article>") == 1 and r.html.count("</article>") == 1}
    assert len(articles) > len(rows) / 2
    assert {i: got[i] for i in articles} == articles


def test_page_without_article():
    html = f"<body><div><a href=1>x</a> <a href=2>y</a></div><h2>Title</h2><div>{LONG * 3}</div><div>Short.</div><div>{LONG * 2}</div><div><a>a</a><a>b</a><a>c</a></div></body>"
    assert x.extract(html) == "\n\n".join(["Title", (LONG * 3).strip(), "Short.", (LONG * 2).strip()])


def test_broken_pages():
    assert x.extract(None) == x.extract("") == x.extract("<nav>only</nav>") == ""
    assert x.extract("plain text") == "plain text"
    assert x.extract("<article><p>a</b></i></p><p>b") == "a\n\nb"
    assert x.extract("<article><script>no end") == ""
    assert x.extract("<p>" + "x" * 300_000 + "</p>") == "x" * 300_000
    assert x.extract("<div>" * 3000 + "deep") == "deep"


def test_pieces(monkeypatch):
    html = f"<body><article><h1>T &amp; t</h1><p>{LONG * 20}</p></article></body>"
    whole = x.extract(html)
    monkeypatch.setattr(x, "PIECE", 7)
    assert x.extract(html) == whole


def test_frame(spark):
    rows = [(1, "u", "<p>one &lt; two</p>", 5), (2, None, None, None), (None, "v", "", 1), (1, "u", "<p>one &lt; two</p>", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = x.main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "u", "one < two", 9)] * 2 + [(2, None, "", 0), (None, "v", "", 0)]))
    assert x.main_text(frame.limit(0)).count() == 0
