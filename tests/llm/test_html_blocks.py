"""HTML extraction: the distribution decides, markup weighs, and broken pages take linear time."""

import time

import pytest

from tessera.llm import html

PROSE = "Prose that goes on for a while, with clauses and no links in it. " * 4
PARAGRAPH = f"<p>{PROSE}</p>"


def article(inner):
    return html.main_text(f"<article>{inner}</article>")


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('text <span class="ad">Buy now</span> more', "text more"),
        ("text <span hidden>x</span> more", "text more"),
        ("a<button>b</button>c<svg><title>q</title><text>z</text></svg>d<noscript>e</noscript>f", "acdf"),
        ("<p>a <select><option>X</option></select> b</p>", "a b"),
        ('<section class="social-science"><p>x</p></section>', "x"),
        ('<p id="search-algorithms">y', "y"),
        ('<p class="product-related-facts">z', "z"),
        ('<section id="discussion"><p>D</p></section><div id="related-work">R</div><div id=search-results>S</div><div id=search>Q</div><p class=form>F</p>', "D\nR\nS\nQ\nF"),
        ("<p>a <math><mi>x</mi></math></p>", "a x"),
        ("&<b>amp;</b>", "&amp;"),
        ("<p>a<script>x</script>b</p>", "ab"),
        ("<p>a<!-- </p> -->b</p>", "ab"),
        ('<p class="a>Hello world</p>', ""),
        ('<p class="comment">first!<p>next</p>', "next"),
        ('<b>a<div class="ad">b</b>c</div>d', "a\nd"),
        ('<p style="color:red; display: none">x</p><p style="overflow: hidden">y</p>', "y"),
    ],
)
def test_within_an_article(inner, want):
    assert article(inner) == want


def test_form_around_the_page():
    assert html.main_text('<form id="aspnetForm"><article><p>Hi there</p></article></form>') == "Hi there"
    assert html.main_text(f'<form id="aspnetForm"><input type=hidden><h1>T</h1>{PARAGRAPH}</form>') == f"T\n{PROSE.strip()}"
    assert html.main_text(f"<form><p>{'Your name please. ' * 6}</p></form><h1>T</h1>{PARAGRAPH}") == f"T\n{PROSE.strip()}"


def test_windows_decide_without_marks():
    short = f"<h1>T</h1><p>By Ann</p><p>Monday</p>{PARAGRAPH}<h2>More</h2>{PARAGRAPH}<p>Last.</p>"
    want = f"T\nBy Ann\nMonday\n{PROSE.strip()}\nMore\n{PROSE.strip()}\nLast."
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Topic number {i}</a></li>" for i in range(9)) + "</ul>"
    assert html.main_text(f"<div>Menu one</div><div>Menu two</div>{short}") == want
    assert html.main_text(f"{menu}{short}{menu}<div>All rights reserved</div>") == want
    assert html.main_text("<table><tr><td>only</td><td>cells</td></tr></table>") == "only\ncells"


def test_of_an_article_all_lines_stay():
    references = "<ul>" + "".join(f"<li><a href=/{i}>Ref {i}</a></li>" for i in range(7)) + "</ul>"
    want = "T\n" + PROSE.strip() + "".join(f"\nRef {i}" for i in range(7)) + "\nSh is."
    assert article(f"<h1>T</h1>{PARAGRAPH}{references}<p>Sh is.</p>") == want
    assert article(f"{PARAGRAPH}<p><a href=x>The source</a></p>") == f"{PROSE.strip()}\nThe source"
    assert article(f'{PARAGRAPH}<p role="note">Mind this.</p><p class="more-comments-policy">And that.</p>') == f"{PROSE.strip()}\nMind this.\nAnd that."
    assert article(f'{PARAGRAPH}<div class="discussion"><p>reader</p></div>') == PROSE.strip()


def test_an_article_outweighs_other_text():
    unmarked = "".join(f"<p>{'x' * 210} {i}</p>" for i in range(4))
    assert html.main_text(f"<article><p>Hi.</p></article>{unmarked}") == "Hi."
    long = "".join(f"<p>{'x' * 900} {i}</p>" for i in range(40))
    assert html.main_text(f"<article><p>Hi.</p></article>{long}").count("\n") == 40


def test_words_weigh_and_windows_decide():
    """A menu's, advert's or comment's words only weigh: what they mark stays where it is nearly all that the page has."""
    said = "".join(f"<p>{'A comment of some length. ' * 40}{i}</p>" for i in range(9))
    assert html.main_text(f'<div class="comments">{said}</div><p>x</p>').count("\n") == 8
    assert html.main_text(f'<article>{PARAGRAPH * 5}</article><div class="comments">{said}</div>').count("\n") == 4
    assert html.main_text("<nav>Only a menu that holds no link</nav>") == "Only a menu that holds no link"
    teasers = "".join(f"<article><h3>Story {i}</h3><p>Few words.</p></article>" for i in range(4))
    page = f"<main><h1>T</h1><article>{PARAGRAPH}{PARAGRAPH}<p>End.</p></article>{teasers}</main>"
    assert html.main_text(page) == f"T\n{PROSE.strip()}\n{PROSE.strip()}\nEnd."
    # without windows (each line its own, no threshold) menus, adverts and teasers stay
    lines = html.lines_of(f'<nav>Menu</nav><article><p>a <span class="ad">Buy</span> b</p></article>{page}')
    assert len(html.main_lines(lines)) < len(lines) == len(html.main_lines(lines, reach=len(lines), surge=0.0))


def test_windows_take_something_from_every_page():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    assert all(html.main_lines(lines) != lines for lines in map(html.lines_of, pages))


def test_a_linked_title_stays():
    top = "<h1><a href=x>T</a></h1><div><a href=y>Ann</a></div><div><a href=z>Monday</a></div><div><a href=w>News</a></div>"
    assert article(f"{top}{PARAGRAPH}") == f"T\nAnn\nMonday\nNews\n{PROSE.strip()}"


def test_a_short_article_outweighs_what_is_around_it():
    assert html.main_text(f"<article><h1>A b</h1><p>Sh is.</p></article><div>{PARAGRAPH}</div>") == "A b\nSh is."
    assert html.main_text(f"<main><h1>Headline</h1><p>By Bob</p><article>{PARAGRAPH}<p>End</p></article></main>") == f"Headline\nBy Bob\n{PROSE.strip()}\nEnd"
    assert html.main_text("<article></article><p>x</p>") == "x"


def test_time_is_linear():
    for part in ("<a x='", '<a x="', "<div>", "<b><p>", "<article><p>x", "<form><article>x", "<table><tr><td>", "<!--", "<![CDATA[", "</script", "<script>", "<span class=ad>"):
        began = time.perf_counter()
        html.main_text(part * ((1 << 20) // len(part)))
        assert time.perf_counter() - began < 15, part
    began = time.perf_counter()
    html.main_text("<a x='" * 170_000)
    assert time.perf_counter() - began < 1
