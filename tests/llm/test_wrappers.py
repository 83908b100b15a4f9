import pytest

from auditlark.llm import wrappers as W

PAGE = """<!DOCTYPE html><html lang="en"><head><title>Site: {title}</title><style>p{{margin:0}}</style><script>var t="</p><article>no";</script></head>
<body class="home"><header><a href="/">Logo</a></header><nav><ul><li><a href="/a">Menu</a></li><li><a>More</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad <p>hidden</p> --><div class="ad">Buy now</div>
<article><header><h1>{title}</h1></header><p>First &amp; <b>bo</b>ld,
  two   lines<br>of&nbsp;it.</p>{body}<aside>Related</aside><form><input value="x"><p>Your mail</p></form>
<div class="share">Share this</div><section id="comments"><p>A reader says</p></section></article>
<div id="sidebar"><p>Popular</p></div><footer>&copy; Owner</footer></body></html>"""


def page(title, n, broken=False):
    body = "".join(f"<p>Paragraph {i} of {title}.</p>" if not broken else f"<p><b>Paragraph {i} of {title}.<br>" for i in range(n))
    return PAGE.format(title=title, body=body)


def expected(title, n):
    return "\n\n".join([title, "First & bold, two lines of it.", *(f"Paragraph {i} of {title}." for i in range(n))])


def wrapper_of(pages):
    whole = None
    for p in pages:
        own = W.page_wrapper(p)
        whole = own if whole is None else W.joined(whole, own)
    return whole


def test_alignment_finds_slots_optional_and_repeated_groups():
    pages = [
        "<body><article><h1>A</h1><p>x</p><p>y</p><dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl></article></body>",
        "<body><article><h1>B</h1><ul><li>one</li></ul><p>z</p></article></body>",
        "<body><article><h1>C</h1><p>z</p></article><footer>f</footer></body>",
    ]
    whole = wrapper_of(pages)
    assert W.expression(whole) == "(body(article(#h1 ul(#li)? #p+ dl(#dt+ #dd+)?) footer(#)?))"
    assert whole[W.CHILDREN][0][W.PAGES] == 3


def test_a_sequence_without_a_template_is_closed():
    items = [[f"k{i % 60}", False, False, [], 1, 1, 0, 0] for i in range(600)]
    closed = W.folded(items)
    assert len(closed) <= 60
    many = [[f"k{i * 7 % 61}.{i % 9}", False, False, [], 1, 1, 0, 0] for i in range(200)]
    assert all(x[W.OPTIONAL] and x[W.REPEATED] for x in W.folded(many))


def test_extraction():
    pages = [page("Alpha", 3), page("Beta", 0), page("Gamma", 2, broken=True), page("Delta", 1)[:-14]]
    roots = W.content_roots(wrapper_of(pages))
    assert roots == ["html>body.home>article"]
    for html, (title, n) in zip(pages, [("Alpha", 3), ("Beta", 0), ("Gamma", 2), ("Delta", 1)]):
        assert W.extract(html, roots) == expected(title, n)


def test_content_without_an_article_element():
    make = lambda i: f"<html><body><div id='top'><a href='/'>Home</a> <a href='/x'>Other</a></div><div class='wrap'><div class='story'><p>Text {i} about {i * 7}.</p><p>More of {i}, and longer.</p></div><div class='links'><a>one {i}</a></div></div><p>Same on every page.</p></body></html>"
    pages = [make(i) for i in range(6)]
    roots = W.content_roots(wrapper_of(pages))
    assert roots == ["html>body>div.wrap>div.story"]
    assert W.extract(pages[3], roots) == "Text 3 about 21.\n\nMore of 3, and longer."


@pytest.mark.parametrize("fan_in", [2, W.FAN_IN])
def test_main_text_over_a_table(spark, monkeypatch, fan_in):
    monkeypatch.setattr(W, "FAN_IN", fan_in)
    monkeypatch.setattr(W, "HELD_HOSTS", 2)
    cases = [(f"https://site{i % 4}.example/p/{i}", page(f"T{i}", i % 5, i % 3 == 0), expected(f"T{i}", i % 5)) for i in range(40)]
    cases += [("http://user@SITE1.example:80/x", page("Upper", 2), expected("Upper", 2)), (None, page("None", 1), expected("None", 1)), ("junk", None, ""), ("http://site0.example", "", "")]
    cases += [("http://site0.example/same", page("Same", 1), expected("Same", 1))] * 5
    cases += [("http://plain.example/", "no markup &lt; at all", "no markup < at all"), ("http://plain.example/", "<p>unclosed <a href='x>q", "unclosed <a href='x>q")]
    rows = [(i, url, html, "kept", 1) for i, (url, html, _) in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(7)
    found = {r.page_id: r for r in W.main_text(pages).collect()}
    assert len(found) == len(cases)
    for i, (_, _, text) in enumerate(cases):
        assert found[i].text == text, cases[i]
    assert W.main_text(pages.limit(0)).count() == 0


def test_long_and_hostile_pages():
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert len(W.extract(long, ["article"]).split("\n\n")) == 50_000
    deep = "<div>" * 3_000 + "<p>x</p>" + "</div>" * 3_000
    W.page_wrapper(deep)
    assert W.extract(deep, []) == "x"
    W.page_wrapper("<a href=\"" * 2_000)
    W.page_wrapper("<p" + " a='" * 2_000)
