"""Pages whose main text is linked, interrupted or nested."""

from __future__ import annotations

import collections

import pytest

from annalist.llm import html



def test_pages_of_layouts_that_were_not_learned_from():
    weight, same, lost, extra, every = html.weights(), 0, 0, 0, 0
    pages = html.labelled_pages(200, seed=1234)
    for page, text in pages:
        got = html.main_text(page, weight)
        want, have = collections.Counter(text.split()), collections.Counter(got.split())
        same, lost, extra, every = same + (got == text), lost + (want - have).total(), extra + (have - want).total(), every + want.total()
    assert same >= 0.88 * len(pages) and lost <= 0.01 * every and extra <= 0.01 * every


@pytest.mark.parametrize("open_, close", [("<main>", "</main>"), ("<article>", "</article>"), ('<div class="post">', "</div>")])
@pytest.mark.parametrize(
    "part, lines",
    [
        ("<table><tr><td>one</td><td>two</td></tr><tr><td>three</td><td>four</td></tr></table>", ["one", "two", "three", "four"]),
        ("<ul>" + "".join(f'<li><a href="/{w}">{w} it</a></li>' for w in ("see", "read", "find", "use", "try")) + "</ul>", ["see it", "read it", "find it", "use it", "try it"]),
        ("<aside><h3>More of this</h3><ul>" + '<li><a href="/x">another story of the day</a></li>' * 8 + "</ul></aside>", []),
        ("<blockquote>What someone said</blockquote><pre>x = 1</pre>", ["What someone said", "x = 1"]),
        ("<dl><dt>Name</dt><dd>What it means</dd></dl><hr><ol><li>First</li><li>Second</li></ol>", ["Name", "What it means", "First", "Second"]),
        ('<form><label>Your name</label><input><button>Send</button></form><div class="share"><a href="/s">Share this</a></div>', []),
    ],
)
def test_parts_of_an_article(open_, close, part, lines):
    body = f"{open_}<h1>The title</h1><p>A first line of text that says what it is all about.</p>{part}<p>Ending words of the article, and there are a few of them.</p>{close}"
    assert text_of(body).split("\n") == ["The title", "A first line of text that says what it is all about.", *lines, "Ending words of the article, and there are a few of them."]


@pytest.mark.parametrize("names", ["content search-results", "post related-work", "share-price", "comment-policy", "ad-hoc-notes", "story footer-notes"])
def test_parts_of_a_name_are_no_veto(names):
    body = f'<div class="{names}"><h1>The title</h1><p>A first line of text that says what it is all about and a little more of it.</p><p>Then there is a second line with about as many words as the first one.</p></div>'
    assert text_of(body).split("\n")[1:] == ["A first line of text that says what it is all about and a little more of it.", "Then there is a second line with about as many words as the first one."]


def test_weights_come_from_the_pages_that_are_given():
    pages = [(f'<body><div class="zork"><p>{"kept words here " * 5}</p></div><div class="blah"><p>{"other things there " * 5}</p></div></body>', " ".join(["kept words here"] * 5))] * 5
    weight = html.fit_weights(pages)
    assert weight["is zork"] > 0 > weight["is blah"]
    assert html.main_text('<div class="blah"><p>one two three four five six</p></div><div class="zork"><p>a b c d e f g h i j k l</p></div>', weight) == "a b c d e f g h i j k l"


def test_null_empty_long_and_clashing_pages(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "w", "<p>" + "words " * 400_000, 1)], "page_id long, url string, html string, x int").withColumnRenamed("x", "HTML")
    assert [len(r.text.split()) for r in html.extract(rows).orderBy("page_id").collect()] == [0, 0, 400_000]
    assert html.extract(rows.limit(0)).collect() == []


MENU = '<nav><ul><li><a href="/">Home page of the site</a></li></ul></nav>'
FOOT = "<footer>All rights are reserved by the owner of this site</footer>"


def text_of(body: str) -> str:
    return html.main_text(f"<html><head><title>T</title></head><body>{MENU}{body}{FOOT}</body></html>", html.weights())


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content"><div>', "</div></div>")])
def test_linked_titles_and_paragraphs_at_the_edges(open_, close):
    body = '<h1><a href="/t">The title</a></h1><p>One line of text.</p><p><a href="/more">All of it is a link.</a></p>'
    assert text_of(open_ + body + close) == "The title\nOne line of text.\nAll of it is a link."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main><div>", "</div></main>")])
@pytest.mark.parametrize("box", ['<div class="ad">' + "buy this now " * 300 + "</div>", "<aside><ul>" + '<li><a href="/x">another story of the day</a></li>' * 200 + "</ul></aside>", '<div class="notice"><p>' + "please note <b>this</b> " * 200 + "</p></div>"])
def test_long_asides_do_not_cut_the_text(open_, close, box):
    assert text_of(f"{open_}<h1>Title</h1>{box}<p>Some text of the page.</p>{box}<p>End.</p>{box}{close}") == "Title\nSome text of the page.\nEnd."


def test_a_list_of_links_outside_the_text_stays_out():
    assert text_of('<div><a href="/a">First</a> <a href="/b">Second</a></div><article><h1>Title</h1><p>Some text.</p></article><ul><li><a href="/c">Third</a></li></ul>') == "Title\nSome text."


TEXT = "<h1>Title</h1><p>Some text of the page.</p><p>End.</p>"
WANT = "Title\nSome text of the page.\nEnd."
REPLY = '<article class="comment"><p>I think that this is wrong and long enough</p></article>'


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{TEXT}</article><section id='comments'>{REPLY * 3}</section>",
        f"<article>{TEXT}<section id='comments'>{REPLY * 3}</section></article>",
        f"<main><article>{TEXT}</article>{REPLY * 3}</main>",
        f"<main>{TEXT}<div id='discussion'><article><p>An unmarked reply to the text</p></article></div></main>",
        f'<div class="content">{TEXT}</div><section id="comments">{REPLY * 3}</section>',
        f"<article>{TEXT}</article><aside><article><h2>Teaser</h2><p>Another story of the day</p></article></aside>",
        f"<article>{TEXT}</article><aside>{REPLY * 3}<article><p>Another story of the day</p></article></aside><div>Made by a friend</div>",
        f"<aside><article><h2>Teaser</h2><p>Another story of the day</p></article></aside><main>{TEXT}</main>",
        f'<div class="sidebar"><article><h2>Teaser</h2><p>Another story of the day</p></article></div><article>{TEXT}</article>',
    ],
)
def test_comments_and_teasers_that_are_articles_stay_out(body):
    assert text_of(body) == WANT


@pytest.mark.parametrize(
    "body",
    [
        f"<form><main>{TEXT}</main></form>",
        f"<form><article>{TEXT}</article></form>",
        f'<div class="has-sidebar"><article>{TEXT}</article><aside><p>A box at the side</p></aside></div>',
        f'<div id="wrap"><div class="ad">An advert that is never closed<article>{TEXT}</article></div>',
        f"<aside>A box that is never closed<article>{TEXT}</article>",
        f'<main><article class="post category-social">{TEXT}</article></main>',
    ],
)
def test_what_wraps_or_was_left_open_does_not_hide_the_text(body):
    assert text_of(body) == WANT
