import time

import pytest

from auditlark.llm import wrappers as W

from .test_wrappers import expected, page, wrapper_of

ARTICLE = "<p>Story {i} tells of {j}, at length.</p><p>It ends with {i}.</p>"
TEXT = "Story {i} tells of {j}, at length.\n\nIt ends with {i}."


def texts(make, n=5):
    pages = [make(i) for i in range(n)]
    roots = W.content_roots(wrapper_of(pages))
    return [W.extract(p, roots) for p in pages]


@pytest.mark.parametrize("shell", [
    '<body class="single has-sidebar"><article>{}</article></body>',
    '<body class="sidebar"><main class="main-content with-sidebar">{}</main></body>',
    '<body><article class="post comments-open">{}</article></body>',
    '<body><div class="layout sidebar-left"><div class="story">{}</div></div><div class="menu-bar">Menu</div></body>',
    '<body><div class="layout no-sidebar"><article>{}</article></div><div class="left-sidebar">Popular</div></body>',
])
def test_a_page_is_not_lost_by_a_class_name(shell):
    found = texts(lambda i: shell.format(ARTICLE.format(i=i, j=i * 7)))
    assert found == [TEXT.format(i=i, j=i * 7) for i in range(5)]


def test_an_article_keeps_the_header_with_its_title():
    make = lambda i: f'<body><article><header class="entry-header"><h1>Title {i}</h1></header><p>Text of {i}.</p></article><header class="site-header">Logo</header></body>'
    assert texts(make) == [f"Title {i}\n\nText of {i}." for i in range(5)]


def test_named_regions_stay_out():
    for region in ('<div class="cookie-notice">x</div>', '<div class="ad">x</div>', '<section id="comments">x</section>', '<div class="site-footer">x</div>'):
        assert texts(lambda i: f"<body><article><p>Text of {i}.</p>{region}</article></body>") == [f"Text of {i}." for i in range(5)]  # noqa: B023
    html = page("Alpha", 3)
    assert W.extract(html, W.content_roots(wrapper_of([html, page("Beta", 1)]))) == expected("Alpha", 3)


def through_wrapper(make, n=8):
    pages = [make(i) for i in range(n)]
    whole = wrapper_of(pages)
    roots = W.content_roots(whole)
    return [W.extract(p, roots, W.template_slots(whole, roots)) for p in pages]


def test_notices_of_the_template_are_no_text():
    make = lambda i: (
        f'<body><article><h1>Title {i}</h1><div class="msg">Read us every day</div><p>Text {i}, of some length.</p><p class="ad">Buy now!</p><h2>Summary</h2>'
        f'<ul><li>One {i}</li><li class="comment">Nice</li></ul><blockquote>Quote {i}</blockquote><p class="end">All rights kept</p></article></body>'
    )
    assert through_wrapper(make) == [f"Title {i}\n\nText {i}, of some length.\n\nSummary\n\nOne {i}\n\nQuote {i}" for i in range(8)]


def test_copies_of_one_page_keep_their_text():
    make = lambda i: "<body><article><h1>Same</h1><p>Always the same text.</p></article></body>"
    assert through_wrapper(make) == ["Same\n\nAlways the same text."] * 8


def test_names_that_only_hold_a_listed_word_are_no_regions():
    for name in ("social-history", "story-alert", "search-results-explained"):
        assert texts(lambda i: f'<body><article><section class="{name}">Text of {i}.</section></article></body>') == [f"Text of {i}." for i in range(5)]  # noqa: B023
    make = lambda i: f'<body><article><h1>T {i}</h1><section data-role="banner"><p>Text {i}.</p></section><div data-id="share"><p>More {i}.</p></div></article></body>'
    assert texts(make) == [f"T {i}\n\nText {i}.\n\nMore {i}." for i in range(5)]


@pytest.mark.parametrize("html", [
    "<div>" * 100_000 + "<p>x</p>" + "</div>" * 100_000, "<div>" * 100_000 + "x" + "</nav>" * 100_000, "x<b" * 300_000, "<svg" * 250_000 + "x", "<a href='" * 100_000 + "x",
    '<p class="' * 100_000, "<!" * 300_000, "<ul><li>x" * 50_000,
])
def test_a_megabyte_of_broken_markup_takes_seconds(html):
    start = time.perf_counter()
    W.page_wrapper(html)
    W.extract(html, ["html>body>article"])
    assert time.perf_counter() - start < 20
