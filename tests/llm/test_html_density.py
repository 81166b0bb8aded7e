import html
import math
import random
import time

import pytest

from sparkloom.llm.html_density import Page, extract, main_texts

PARA = "Plain words of a paragraph that say something, and then some more, so that it counts as text. "


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a b"),
        ("<body>hi <b>the</b>re &amp; y&nbsp; z<br>end</body>", "hi there & y z end"),
        ("<p title='abc>text", "text"),
        ("<b>" * 3000 + "deep", "deep"),
        ("<script>var x = '<p>no</p>'</script><style>p{}</style><p>yes</p><!-- no -->", "yes"),
        ("<article><h1>T</h1><p><b>T.<br><p>one</p></article><footer>f</footer>", "T T. one"),
        ("<main><header><h1>Head</h1></header><p>x</p><form>f<input></form></main>", "Head x"),
        ("&#72;&eacute;&#x21; &lt;b&gt; &unknown; &", "Hé! <b> &unknown; &"),
    ],
)
def test_small_pages(source, want):
    assert extract(source) == want


def furniture():
    return (
        '<header><a href="/">Site</a></header><div id="pageHeader"><p>Welcome to the site of sites, where all is well.</p></div><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>',
        '<div class="ad-slot">Buy this now, it is the best there is and costs nearly nothing at all.</div><div id="cookieNotice">We use cookies.</div>',
        f'<aside><p>{PARA}</p></aside><div class="sidebar"><p>{PARA}</p></div>',
        f'<section id="comments"><div class="comment"><p>{PARA * 3}</p></div></section><footer>&copy; us</footer>',
        '<div><ul><li><a href="/1">One more link</a><li><a href="/2">Another link here</a><li><a href="/3">Third</a></ul></div>',
    )


@pytest.mark.parametrize("wrap", ["article", "main", "div", 'div class="post content with-sidebar"', 'div id="story"'])
def test_article_without_furniture(wrap):
    head, ads, side, foot, links = furniture()
    name = wrap.split()[0]
    body = f"<h1>The title</h1><p>{PARA}</p>\n<p>{PARA} <a href='/x'>linked</a> word.</p><ul><li>item one<li>item two</ul>"
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{head}{ads}<{wrap}>{body}</{name}>{side}{links}{foot}</body></html>"
    want = " ".join(f"The title {PARA} {PARA} linked word. item one item two".split())
    assert extract(page) == want


@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_names_of_topics_and_lists_of_references_stay_in_the_article(wrap):
    head, ads, side, foot, links = furniture()
    refs = "<ul><li><a href='/r1'>First reference, of 1999</a><li><a href='/r2'>Second reference, of 2003</a></ul>"
    body = (
        f'<h1>The title</h1><p class="teaser">Lead.</p><p>{PARA}</p><h2 id="search-results">Results</h2><p id="search-path">{PARA}</p><h3 id="ad-hoc-networks">Networks</h3><p>{PARA}</p>'
        f'<section id="related-work"><h2>Related work</h2><p>{PARA}</p></section><section id="discussion"><p>{PARA} <span class="notice">Mind this.</span></p></section><h2 id="navigation">References</h2>{refs}'
    )
    inner = '<div class="ad">Buy it.</div><div class="share-buttons">Share it</div><div class="related"><a href="/x">More one</a> <a href="/y">More two</a></div>'
    page = f"<body>{head}{ads}<{wrap}>{body}{inner}</{wrap}>{side}{links}{foot}</body>"
    want = f"The title Lead. {PARA} Results {PARA} Networks {PARA} Related work {PARA} {PARA} Mind this. References First reference, of 1999 Second reference, of 2003"
    assert extract(page) == " ".join(want.split())


STORY = "<h1>The title</h1>" + "".join(f"<p>{PARA} Part {k}.</p>" for k in range(5))
STORY_TEXT = " ".join(f"The title {' '.join(f'{PARA} Part {k}.' for k in range(5))}".split())
ANCHORS = "<div>" + "".join(f'<p><a href="/{k}">A long text of a link, number {k}, that says what there is to read</a></p>' for k in range(20)) + "</div>"
TEASERS = "<div>" + "".join(f"<p>Short bit {k}</p>" for k in range(25)) + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{ANCHORS}<div>{STORY}</div></body>",  # a list of links with long texts
        f"<body><div>{TEASERS}</div><div><div>{STORY}</div></div></body>",  # two columns of text, no names
        f"<body><div><div><div><div>{STORY}</div></div></div></div>{TEASERS}{ANCHORS}</body>",  # nested wrappers
        "<body>" + "".join(f"<article><h2>Other {k}</h2><p>Bit</p><p>Bit</p><p>Bit</p><p>Bit</p><p>Bit</p><p>Bit</p><p>Bit</p></article>" for k in range(9)) + f"<article>{STORY}</article></body>",  # an article by name is one of ten
        f"<body><main>{TEASERS}{ANCHORS}</main><div>{STORY}</div></body>",  # a main element without the story
        f"<body><div><section>{ANCHORS}</section><section>{STORY}</section><section>{TEASERS}</section></div></body>",
    ],
)
def test_densities_decide(page, monkeypatch):
    """With constant densities, or those of other nodes, each of these pages gives another text."""
    assert extract(page) == STORY_TEXT
    own = Page._densities
    monkeypatch.setattr(Page, "_densities", staticmethod(lambda chars, *a: [1.0] * len(chars)))
    assert extract(page) != STORY_TEXT
    monkeypatch.setattr(Page, "_densities", staticmethod(lambda *a: own(*a)[::-1]))
    assert extract(page) != STORY_TEXT


def test_densities_equal_brute_force():
    """The composite density from its definition, node by node over all descendants."""
    rnd = random.Random(4)
    for _ in range(40):
        bits = ["<div>", "</div>", "<p>", "some words ", "<a href=x>link text</a> ", "<b>bold</b> ", "<ul><li>", "</ul>", "<nav><a>menu</a></nav>", "&amp;x "]
        page = Page("<body>" + "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 80))))
        n = len(page.tag)
        kin = [[j for j in range(n) if any(k == i for k in up(page.parent, j))] for i in range(n)]
        linked = [any(page.tag[k] == "a" for k in up(page.parent, i)) for i in range(n)]
        text = [(i, "".join(html.unescape(t).split())) for i, t in page.text]
        c = [sum(len(t) for j, t in text if j in kin[i]) for i in range(n)]
        lc = [sum(len(t) for j, t in text if j in kin[i] and linked[j]) for i in range(n)]
        t = [len(kin[i]) - 1 for i in range(n)]
        lt = [sum(page.tag[j] == "a" for j in kin[i]) - (page.tag[i] == "a") for i in range(n)]
        texts = [(i, html.unescape(x)) for i, x in page.text]
        assert page._counts(texts, linked, [True] * n) == (c, lc, t, lt)
        got = page._densities(c, lc, t, lt, 1)
        for i in range(n):
            at_least = lambda x: max(x, 1)
            base = math.log(c[i] / at_least(c[i] - lc[i]) * lc[i] + lc[1] / at_least(c[1]) * c[i] + math.e)
            ratio = c[i] / at_least(lc[i]) * (at_least(t[i]) / at_least(lt[i]))
            if c[i] and base > 1:
                assert got[i] == pytest.approx(c[i] / at_least(t[i]) * max(0, math.log(ratio, base)))


def up(parent, i):
    while i >= 0:
        yield i
        i = parent[i]


@pytest.mark.parametrize("bit", ["<b>", "<b></i>", "<div><b></i>", "<a ", "<i><div><b></i>", "<li><dd>", "<body>", "<td><div>", "<p", "<script", "&", "<a title='"])
def test_deep_and_broken_pages_take_linear_time(bit):
    took = []
    for n in (20_000, 80_000):
        page, t = bit * n + "end", time.perf_counter()
        extract(page)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 0.2


def test_random_markup_never_fails():
    rnd = random.Random(6)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<", ">", "&", "&amp;", "text ", "<a href=x>", "</a>", "<!--", "-->", "<table><tr><td>", "<script>", "</script>", "\x00", "<li>", "</ul>", "é", '"', "<br/>", "<![CDATA["]
    for _ in range(2000):
        extract("".join(rnd.choice(bits) for _ in range(rnd.randrange(60))))


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>x</p>", 6), (1, "u", "<p>x</p>", 7), (2, "v", "<p>" + "word " * 300000, 8)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, main_texts(df).collect()), key=str)
    assert [(r[0], r[2]) for r in got[:3]] == [(1, ""), (1, "x"), (2, ("word " * 300000).strip())] and got[3][2] == "x"
    assert main_texts(df.limit(0)).count() == 0


def test_columns_of_the_results_names(spark):
    """Columns named as the results are read as any other, and not carried."""
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old", 9, "__h")], "page_id long, url string, html string, text string, n_chars int, __html string")
    got = main_texts(df)
    assert got.columns == ["page_id", "url", "text"] and got.first().text == "x"
