import pytest

from siftline.operators import extract as ex
from siftline.operators import page_dom as dom

LONG = "Sentence with enough words to count as real content. " * 8  # > 300 characters


def page(html):
    return dom.Page(html)


@pytest.mark.parametrize("html, title", [
    ("<h1>Out</h1><main><h1> In </h1></main>", "In"),
    ("<div role=main><p><h1>Role</h1></div>", "Role"),
    ("<article></article><h1>Only <b>one</b></h1>", "Only one"),
    ("<article><h1></h1></article><h1>later</h1>", ""),
    ("<title>A | B - C</title>", "A"),
    ("<title>A - B :: C</title>", "A"),
    ("<title>A – B — C</title>", "A"),
    ("<title>A // B</title>", "A"),
    ("<title>A &amp; B|C</title>", "A & B|C"),
    ("<p>nothing</p>", ""),
])
def test_title(html, title):
    assert dom.title_of(page(html)) == title


@pytest.mark.parametrize("html, date", [
    ("<time>x</time><time datetime='noon'>", None),
    ("<time>x</time><time datetime='2024-01-02'>", "2024-01-02"),
    ("<time datetime='2 Jan'>", "2 Jan"),
    ("<meta name=date content='d1'><meta property=pubdate content='d2'>", "d2"),
    ("<meta property='article:published_time' content='iso'>", "iso"),
    ("<meta name=date content=''><meta name=published content=p>", "p"),
    ("<i class=UpDate>on 2024-3-4</i>", "2024-3-4"),
    ("<i class=date>no</i><i class=date>2024-3-4</i>", None),
    ("<i class=date>no</i><i class=time>3/4/2024</i>", "3/4/2024"),
    ("<i class=pub-date>November 15, 2023</i>", "November 15, 2023"),
    ("<i class=post-date>Nov 5 2023 later</i>", "Nov 5 2023"),
    ("<i date='x'></i><i date='at 2024-01-02 ok'></i>", "at 2024-01-02 ok"),
    ("<i date-time='1/2/2024'></i>", "1/2/2024"),
    ("<p>2024-01-02</p>", None),
])
def test_publish_date(html, date):
    assert dom.publish_date_of(page(html)) == date


@pytest.mark.parametrize("html, content", [
    # an element marked as content wins, article before div
    (f"<div class=story>{LONG}1</div><article class='x Post'>{LONG}2</article>", (LONG + "2").strip()),
    (f"<div class=content>short</div><div class=body>{LONG}</div>", LONG.strip()),
    # ignored words are substrings of class or id: 'ad' hits 'download-box'
    (f"<div class=content>{LONG}<b class=download-box>gone</b><i id=Main-Nav>gone</i></div>", LONG.strip()),
    (f"<div class=text>{LONG}<script>x()</script><style>y</style><iframe>z</iframe><!-- c --></div>", LONG.strip()),
    (f"<span role=main>{LONG}</span>", LONG.strip()),
    # most paragraphs, first on ties
    (f"<div><p>{LONG}<p>b<p>c</div><section><p>{LONG}</p><p>x</p><p>y</p></section>", LONG + "bc"),
    # too short for a container: long paragraphs only
    ("<div><p>tiny</p><p>" + "w" * 40 + "</p></div>", "w" * 40),
    (f"<p class=share>{LONG}</p><p>no</p>", ""),
    ("", ""),
])
def test_content(html, content):
    assert dom.content_of(page(html), 300) == content


def test_unclosed_paragraphs_nest():
    p = page("<div><p>one<p>two</p>three</div></p>after")
    first, second = p.elements("p")
    assert p.text_of(first) == "onetwothree" and p.text_of(second) == "two"


def test_void_and_self_closed_elements():
    p = page("<p>a<br>b<img src=x>c<div/>d</p>e")
    assert [p.text_of(i) for i in p.elements("p")] == ["abcd"]


def test_paragraph_fallback_sees_nested_text_twice():
    a, b = "a" * 50, "b" * 50
    assert dom.content_of(page(f"<p>{a}<p>{b}"), 300) == f"{a}{b}\n{b}"


def test_links():
    html = "".join(f"<a href='{h}'>l</a>" for h in [
        "http://o.org/x", "//cdn.org/y", "/root", "rel", "../up", "?q=1", "#f", "mailto:a@b", "javascript:x()", "ftp://f.org/z", "rel"
    ]) + "<a>no href</a>"
    assert dom.links_of(page(html), "https://h.org/a/b/c?z=1") == [
        "http://o.org/x", "https://cdn.org/y", "https://h.org/root", "https://h.org/a/b/rel", "https://h.org/a/up",
        "https://h.org/a/b/c?q=1", "https://h.org/a/b/c?z=1#f", "mailto:a@b", "javascript:x()", "ftp://f.org/z",
        "https://h.org/a/b/rel",
    ]


def test_extract_job(spark):
    pages = spark.createDataFrame([
        ("https://h.org:8/x", f"<title>T | s</title><div class=content>{LONG}</div><a href=/l>l</a><a href=mailto:x>m</a>", 0, 200, None),
        ("https://e.org/", None, 0, 404, None),
        ("https://r.org/", "<![foo[ <p>rejected", 0, 200, None),
    ], "url string, html string, depth int, status int, fetched_at timestamp")
    rows = {r.url: r for r in ex.extract_articles(pages, "now").collect()}
    a = rows["https://h.org:8/x"]
    assert (a.title, a.content, a.metadata.domain, a.date_extracted) == ("T", LONG.strip(), "h.org:8", "now")
    e = rows["https://e.org/"]
    assert (e.title, e.content, e.metadata.publish_date, e.metadata.domain) == ("", "", None, "e.org")
    assert [(r.pos, r.link) for r in ex.extract_links(pages).collect()] == [(0, "https://h.org:8/l")]
    assert tuple(ex.crawl_summary(pages, ex.extract_articles(pages, "now")).first()) == (3, 2, 1, 1)
    summary = {r.url: r for r in ex.summary_rows(ex.parse_crawl(pages)).collect()}
    assert summary["https://e.org/"].has_content is False and summary["https://e.org/"].title is None


def test_fields_are_handed_on_a_few_pages_at_a_time(spark, monkeypatch):
    """a task holds the fields of few pages, and none is lost between them."""
    from siftline.operators import extract as ex

    html = "<h1>t{}</h1><p>" + "w" * 50 + "</p><a href='/{}'>x</a>"
    rows = [(i, f"http://h.org/{i}", html.format(i, i) if i % 50 else None) for i in range(203)]
    pages = spark.createDataFrame(rows, "seq int, url string, html string").coalesce(1)
    got = sorted(ex.parse_pages(pages, ["seq"]).select("seq", "title", "links").collect())
    assert [tuple(r) for r in got] == [(i, f"t{i}" if i % 50 else "", [f"http://h.org/{i}"] if i % 50 else []) for i in range(203)]
    sizes = pages.select("url", "html")
    seen = []
    monkeypatch.setattr(type(sizes), "mapInPandas", lambda self, run, schema: seen.extend(len(b) for b in run(iter([self.toPandas()]))))
    ex.parse_pages(sizes, [])
    assert len(seen) > 1 and max(seen) <= ex.PAGES_AT_ONCE and sum(seen) == 203
