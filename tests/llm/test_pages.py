import time

import pytest

from cuelake.llm import pages as p

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><h1>Site</h1><p>Welcome, to our site. Hello, there.</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, to track. Really, we do. It is, as they say, for you.</div>
<div id="content-with-sidebar"><div class="sidebar"><p>Popular posts, and more, here. And here.</p></div>
<div class="post"><h2>Title &amp; more</h2><p>First para, with <a href=x>a link</a> and&nbsp;text.
 It is long enough, to be content.</p><p>Short.</p><ul><li>one<li>two</ul><p><b>Unclosed bold, in a paragraph. It goes on.<br><p>Next one, after it.
<form><p>Enter mail</p></form><div class="ad">Buy, now. And here, too.</div></div>
<section id="comments"><article class="comment"><p>I disagree, with all. Very much, indeed, as said.</p></article></section></div>
<footer>&copy; 2020, all rights. Reserved.</footer>"""


def test_article_of_a_page():
    assert p.main_text(PAGE) == (
        "Title & more First para, with a link and text. It is long enough, to be content. Short. one two "
        "Unclosed bold, in a paragraph. It goes on. Next one, after it."
    )


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain &lt;b", "plain <b"), ("<p>a<p>b", "a b"), ('<a title="x>y">t</a> <b', "t <b"), ("a<br>b<!-- x", "a b"),
    ("<div><div>", ""), ("<p>un<b>bro</b>ken</p>", "unbroken"), ("<P>A&#233;&hellip;</P>", "Aé…"), ("<nav>a</nav>", ""),
    ("<article><p>One short line.</p></article><div>Other words, which are many. More, of them.</div>", "One short line."),
    ('<article class="post comments-open has-sidebar"><div class="entry-header"><h1>T</h1></div><p>One, two.</p></article>', "T One, two."),
    ('<article class="comment"><p>No, not.</p></article><article><p>One, two.</p></article>', "One, two."),
    ('<a title="unclosed>t</a>', "t"), ("</div></p>x", "x"), ("<script>never closed", ""), ("<p>a\n\t b</p>", "a b"),
])
def test_small_cases(html, text):
    assert p.main_text(html) == text


def test_long_and_deep_pages():
    words = "word, and more. " * 20_000
    assert p.main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert p.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("html,chars", [
    ('<a b="' * 170_000, 1_020_000), ("<svg a='b' " * 95_000, 1_044_999), ('<a b="' * 170_001 + ">", 0), ("<!--" * 250_000, 0),
    ("<div>" * 100_000 + "x", 1), ("<div>" * 50_000 + "</x>" * 50_000, 0), ("<ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, 99_999),
    ('<div class="widget">x ' * 50_000, 99_999), ("<a \"'\">' " * 60_000 + '"', 120_001),
])
def test_hostile_pages_take_seconds(html, chars):
    begin = time.monotonic()
    assert len(p.main_text(html)) == chars
    assert time.monotonic() - begin < 20


def test_tags_with_quotes_that_never_end():
    assert [html[b:e] for html in ("a<b c=\"d>e<i>f", "<x 'y\"><z '>", "<p a='>' b=\">t") for b, e, *_ in p.markup(html)] == [
        '<b c="d>', "<i>", "<x 'y\"><z '>", "<p a='>"]


BODY = "".join(f"<p>Paragraph {k} of the story, which goes on. It has some length, as stories do.</p>" for k in range(10))
STORY = p.main_text(f"<div>{BODY}</div>")


@pytest.mark.parametrize("html,text", [
    (f"<article><header><h1>Title</h1><p>Lead</p></header><div class=body>{BODY}</div></article>", f"Title Lead {STORY}"),
    (f"<article><p>Intro.</p><ul>{BODY.replace('<p>', '<li>')}</ul><p>End.</p></article>", f"Intro. {STORY} End."),
    (f"<div><p>An intro of the story, which is long enough. It has some length, as they do.</p><section>{BODY}</section></div>",
     f"An intro of the story, which is long enough. It has some length, as they do. {STORY}"),
    (f"<div>{BODY}</div>" + "".join(f"<div><article><a href=x>Card {k} of others</a> A line.</article></div>" for k in range(12)), STORY),
])
def test_nothing_of_the_article_is_dropped(html, text):
    assert p.main_text(f"<html><body>{html}</body></html>") == text


@pytest.mark.parametrize("html,text", [
    (f"<article><svg viewBox='0 0 1 1'/>{BODY}<svg><text>x</text></svg></article>", STORY),
    (f"<article><p>One, two.</p><video-js></video-js><svg-icon></svg-icon>{BODY}</article>", f"One, two. {STORY}"),
    (f"<article data-title='The hidden cost' title=\"a hidden b\">{BODY}</article>", STORY),
    (f"<article><div hidden><p>No.</p></div><div aria-hidden=true>No.</div><div style='display: none'>No.</div>{BODY}</article>", STORY),
    (f'<article class="long-form">{BODY}</article>', STORY),
    (f'<div class="elementor-widget">{BODY}</div><div class="sidebar">Side.</div>', STORY),
    ('<div class="widget">' * 3000 + BODY, STORY),
    (f'<article>{BODY}<section id="discussion"><p>We discuss.</p></section><section id="related-work"><p>Others.</p></section></article>',
     f"{STORY} We discuss. Others."),
    (f'<form action="x.aspx"><nav>Menu</nav><div>{BODY}</div><div class="sidebar">Side.</div></form>', STORY),
    (f'<div>{BODY}</div><form><p>Enter mail, please.</p></form>', STORY),
])
def test_names_do_not_rule_out_the_article(html, text):
    assert p.main_text(f"<html><body>{html}</body></html>") == text


def test_ratios_alone_find_the_article():
    """Nothing is named and nothing is declared: menus, an advert and a footer are told by their paths."""
    links = "".join(f"<li><a href=/{k}>Link {k}</a>" for k in range(8))
    page = f"<html><body><div><ul>{links}</ul></div><div>Buy this, now.</div><div><h1>Title</h1>{BODY}</div><div>All rights, reserved.</div></body></html>"
    assert p.main_text(page) == f"Title {STORY}"


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "", "x"), (2, "u", "<p>é</p>", "x"), (2, "u", "<p>é</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = p.extract(frame).collect()
    assert p.extract(frame).columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(p.main_text(PAGE))), (None, 0), (2, 0), (2, 1), (2, 1)]
    assert p.extract(frame.limit(0)).collect() == []
