"""The distribution chooses the region; what is left out never takes it along."""

import re

import pyarrow.parquet as pq
import pytest

from quotaflow.llm.html_text import is_mark, main_text, read_page, region

LONG = "The article goes on for a good while here, with more than eighty characters of plain text in it."
A, B = "First. " + LONG, "Second. " + LONG
ARTICLE = f"<article><h1>Title</h1><p>{A}</p><p>{B}</p></article>"
WANT = f"Title\n\n{A}\n\n{B}"


@pytest.mark.parametrize("wrap", ["page no-sidebar", "layout-with-menu", "header-fixed", "js-comments-off", "widget-ready", "ad-light", "banner",
                                  "related", "sidebar-left"])
def test_marked_wrappers_keep_the_article(wrap):
    assert main_text(f'<body class="{wrap}"><div class="{wrap}"><nav>Home</nav>{ARTICLE}</div></body>') == WANT
    assert main_text(f'<div id="{wrap}">{ARTICLE}</div><footer>x</footer>') == WANT


@pytest.mark.parametrize("tag", ["form", "dialog", "aside"])
def test_elements_around_the_article_keep_it(tag):
    assert main_text(f"<body><{tag}><p>x</p>{ARTICLE}</{tag}></body>") in (WANT, f"x\n\n{WANT}")
    assert main_text(f"<body><{tag}><div><h1>Title</h1><p>{A}</p><p>{B}</p></div></{tag}></body>") == WANT


@pytest.mark.parametrize("page", ["<nav>x</nav>", f"<nav><p>{LONG}</p></nav>", f"<footer>{LONG}</footer>", "<div class=ad>Buy</div>",
                                  f"<menu><li>{LONG}</menu>"])
def test_pages_without_an_article_are_empty(page):
    assert main_text(page) == ""


def test_parts_of_the_article_stay_unless_marked():
    page = f'<article><section class="ad-free"><p>{A}</p></section><div class="ad-slot">Buy</div><p>{B}</p><div class="post-comments">x {LONG}</div></article>'
    assert main_text(page) == f"{A}\n\n{B}"


def test_marks():
    marked = ["ad", "ad-slot", "site-footer", "cookie_banner", "related-posts nav", "adBox2", "sidebar--right", "comments-area", "main-menu"]
    assert all(is_mark(x.split()[-1]) for x in marked if x != "related-posts nav")
    assert not any(map(is_mark, ["no-sidebar", "with-menu", "header-fixed", "ad-free", "download", "readability", "js-comments-off", "content",
                                 "article-body", "shared", "badge"]))


def test_comments_longer_than_the_article_stay_out():
    page = f"<body>{ARTICLE}<div class=comments>" + f"<p>{LONG}</p>" * 30 + "</div></body>"
    assert main_text(page) == WANT


def test_region_without_article():
    page = f"<body><div>Buy our things now, friends.</div><div><h1>Title</h1><p>{A}</p><ul><li><a href=x>One source</a></ul><p>{B}</p></div><div>About us</div></body>"
    assert main_text(page) == f"Title\n\n{A}\n\nOne source\n\n{B}"
    split = f"<body><div>Buy</div><div><h2>Title</h2><div><p>{A}</p><p>{B}</p></div><div>Share this</div></div></body>"
    assert main_text(split) == WANT


def test_deep_pages_take_time_by_their_length():
    page = "<div>" * 30_000 + f"<p>{A}<p>{B}" + "</div><p>x" * 1_000
    assert main_text(page).startswith(f"{A}\n\n{B}")
    assert region(read_page("<div>" * 30_000 + "deep")) in (0, 1)


def renamed(html):
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", html)


def unmarked(html):
    return re.sub(r'\s(?:class|id|role)=("[^"]*"|\S+?(?=[\s>]))', "", html)


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()


def test_given_pages_without_article_elements(pages):
    assert sum(main_text(renamed(h)) != main_text(h) for h in pages) == 0


def test_given_pages_by_the_distribution_alone(pages):
    """No article elements, no class, id or role: the text is found all the same."""
    same = sum(main_text(unmarked(renamed(h))) == main_text(h) for h in pages)
    assert same >= 0.9 * len(pages), same
