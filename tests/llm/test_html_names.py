"""Names of classes and ids, links, formulas and imprints in and around articles."""

import pytest

from millrace.llm import html

LONG = ("A sentence of the story, with a clause, and more of it. " * 6).strip()
OTHER = ("Another sentence, which goes on for a while, and ends here. " * 5).strip()
SHORT = "One short remark."


def in_article(middle):
    return f"<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}</p>{middle}<p>{OTHER}</p></article><footer>us</footer></body></html>"


def in_div(middle):
    return f"<html><body><nav><a href=/>Home</a></nav><div class=story><h1>T</h1><p>{LONG}</p>{middle}<p>{OTHER}</p></div><footer>us</footer></body></html>"


@pytest.mark.parametrize("page", [in_article, in_div])
@pytest.mark.parametrize(
    "middle, text",
    [
        ('<h3 id="social-impact">Social impact</h3>', "Social impact"),
        (f'<section id="related-work"><h2>Related work</h2><p>{OTHER}</p></section>', f"Related work\n{OTHER}"),
        (f'<section id="related-work"><p>{SHORT}</p></section>', SHORT),
        (f'<div class="login-guide"><p>{SHORT}</p></div>', SHORT),
        ('<p class="form-note">Fill in all of it.</p>', "Fill in all of it."),
        ('<p>We met <span class="ad-hoc">ad hoc</span> teams</p>', "We met ad hoc teams"),
        ('<p>Use the <code class="menu">File</code> item</p>', "Use the File item"),
        ('<p><a href="/r">Read the report</a></p>', "Read the report"),
        ('<h2>Sources</h2><ul><li><a href="/a">First source</a></li><li><a href="/b">Second</a></li></ul>', "Sources\nFirst source\nSecond"),
        ("<p>So <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a = b</annotation></math> holds.</p>", "So a=b holds."),
        ('<ul><li>A point, made at some length, as one does.</li><li><a href="/p">A linked point</a></li></ul>', "A point, made at some length, as one does.\nA linked point"),
    ],
)
def test_names_and_links_take_nothing_out_of_a_text(page, middle, text):
    assert html.main_text(page(middle)) == f"T\n{LONG}\n{text}\n{OTHER}"


@pytest.mark.parametrize("page", [in_article, in_div])
@pytest.mark.parametrize(
    "middle",
    [
        f'<div id="comments"><p>{LONG}</p><p>{LONG}</p></div>',
        f'<section class="comment-list"><p>{OTHER}</p></section>',
        '<div class="share-buttons"><span>Share this</span> <a>one</a> <a>two</a></div>',
        '<aside><p>See also, elsewhere.</p></aside>',
        "<form><p>Write to us, please.</p></form>",
        f'<div class="cookie-banner">{SHORT}</div>',
        '<div class="relatedPosts"><a href=/1>One thing</a> <a href=/2>Another</a></div>',
    ],
)
def test_what_says_to_be_something_else_goes(page, middle):
    assert html.main_text(page(middle)) == f"T\n{LONG}\n{OTHER}"


def test_the_only_article_is_the_text_whatever_stands_beside_it():
    advert = f"<div><p>{LONG} {LONG} {LONG}</p></div>"
    rights = "<div>Copyright 2020, all rights reserved by the makers of this page, and by nobody else, anywhere.</div>"
    article = f"<article><h1>T</h1><p>{OTHER}</p></article>"
    assert html.main_text(f"<html><body>{advert}{article}{rights}</body></html>") == f"T\n{OTHER}"
    assert html.main_text(f"<html><body>{article}<p>{LONG}</p><p>{LONG}</p></body></html>") == f"T\n{OTHER}"
    plain = f"<div><h1>T</h1><p>{LONG}</p><p>{OTHER}</p></div>"
    assert html.main_text(f"<html><body>{plain}{rights}</body></html>") == f"T\n{LONG}\n{OTHER}"
    assert html.main_text(f"<html><body>{plain}<p>© 2021 us</p></body></html>") == f"T\n{LONG}\n{OTHER}"
