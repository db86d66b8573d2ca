"""Inside article and main every block stays that is not left out."""

import pytest

from quotaflow.llm.html_text import main_text

LONG = "The article goes on for a good while here, with more than eighty characters of plain text in it."
AD = "<div class=ad>Buy now</div>"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_linked_blocks_stay(tag):
    page = (f"<body><ul><li><a href=/>Home page of this site</a></ul><{tag}><p>{LONG}</p><p><a href=x>A paragraph that is one link</a></p>"
            f"<ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul></{tag}><p><a href=y>Next page</a></p></body>")
    assert main_text(page) == "\n\n".join([LONG, "A paragraph that is one link", "Source one", "Source two"])


@pytest.mark.parametrize("tag", ["article", "main"])
def test_short_blocks_between_adverts_stay(tag):
    page = f"<body><{tag}><p>{LONG}</p>{AD * 6}<p>Short one.</p>{AD * 6}<p>{LONG}</p>{AD * 6}<p>End.</p></{tag}>{AD * 6}<p>Outside.</p></body>"
    assert main_text(page) == "\n\n".join([LONG, "Short one.", LONG, "End."])
