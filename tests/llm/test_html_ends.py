"""What is left out of a page ends where the HTML standard ends it."""

import pytest

from quotaflow.llm.html_text import main_text

LONG = "The article goes on for a good while here, with more than eighty characters of plain text in it."
A, B = "First. " + LONG, "Second. " + LONG

PAGES = {
    "head without end": f"<html><head><title>T</title><meta charset=utf-8><body><p>{A}<p>{B}",
    "head without end or body": f"<head><title>T</title><style>x</style><p>{A}</p><p>{B}</p>",
    "head, then text": f"<head><title>T</title>{A}<p>{B}",
    "head, then inline": f"<head><title>T</title><b>First.</b> {LONG}<p>{B}",
    "p": f"<body><p class=notice>Note <p>{A}<p>{B}",
    "p by a block": f"<article><p class=notice>Note <div>{A}</div><p>{B}</article>",
    "p by its parent": f"<article><div><p class=ad>Note </div><p>{A}<p>{B}</article>",
    "li": f"<article><ul><li class=promo>Buy <ul><li>x</ul> now<li>{A}<li>{B}</ul></article>",
    "dd and dt": f"<dl><dt class=ad>Buy<dd>{A}<dd class=ad>Buy<dt>{B}</dl>",
    "option": f"<div><option class=ad>Buy<option>{A}<option class=ad>Buy</div><p>{B}",
    "td": f"<table><tr><td class=ad>Buy<td>{A}<tr><td>{B}</table>",
    "tr": f"<table><tr class=ad><td>Buy<td>now<tr><td>{A}<tr class=ad><td>Buy</table><p>{B}",
    "tbody": f"<table><tbody class=ad><tr><td>Buy<tbody><tr><td>{A}</table><p>{B}",
    "nav by its parent": f"<body><div><nav><ul><li>Home</ul></div><p>{A}</p><p>{B}</p>",
    "nav by main": f"<body><nav><ul><li>Home</ul><main><p>{A}</p><p>{B}</p></main></body>",
    "nav by article": f"<body><nav><ul><li>Home</ul><article><p>{A}</p><p>{B}</p></article></body>",
    "div by its parent": f"<body><section><div class=ad>Buy<div>now</section><p>{A}</p><p>{B}</p>",
    "div by article": f"<body><div class=ad>Buy<div>now</div><article><p>{A}</p><p>{B}</p></article></body></html>",
    "heading": f"<body><h2 class=promo>Buy<h2>{A}</h2><p>{B}",
}


@pytest.mark.parametrize("kind", list(PAGES))
def test_left_out_elements_end(kind):
    assert main_text(PAGES[kind]) == f"{A}\n\n{B}"


@pytest.mark.parametrize("inner", [
    "<div>x</div><p>x<p>x", "<ul><li>x<li>x</ul>", "<table><tr><td>x</div></nav><td>x</table>", "<article>A related card</article>",
    "x</section></td></p>x", "<div class=ad>x</div>"])
def test_closed_elements_stay_out_whole(inner):
    for tag, end in (("nav", "nav"), ("div class=related", "div"), ("aside", "aside")):
        page = f"<body><article><p>{A}</p><{tag}>{inner} x</{end}><p>{B}</p></article></body>"
        assert main_text(page) == f"{A}\n\n{B}", page
    assert main_text(f"<ul><li class=ad>Buy <ul><li>x<li>x</ul>x<li>{A}</ul><p>{B}") == f"{A}\n\n{B}"


def test_deep_pages_take_time_by_their_length():
    deep = "<ul><li>" * 20_000 + "<div class=ad>x" * 5_000
    assert main_text(deep + "</ul>" * 20_000 + f"<p>{A}") == A
