"""Pages with tags and comments that never end."""

import time

import pytest

from spoorline.llm import html_extract

BODY = "<html><body><article><p>A sentence about rivers that goes on for a while.</p><p>Another one about mountains.</p></article>"
TEXT = "A sentence about rivers that goes on for a while.\nAnother one about mountains."


@pytest.mark.parametrize("tail", ["<a ", '<p class="x', "<!--", "</", "<!x ", "<?", "<![CDATA[", "< ", "<"])
def test_long_tails_take_linear_time(tail):
    start = time.time()
    assert html_extract.extract(BODY + tail * 100_000)[0].startswith(TEXT)
    assert html_extract.extract(tail * 100_000) is not None
    assert time.time() - start < 20


def test_short_and_closed_tails_stay():
    page = BODY + "<!-- note --><p>Third text here, also long enough to stay.</p></body></html>"
    assert html_extract.closed(page) == page
    many = BODY + "<!-- a -->" * 500 + "</body></html>"
    assert html_extract.closed(many) == many
    script = "<script>" + "<!-- x " * 10 + "</script>" + BODY
    assert html_extract.closed(script) == script
    tags = BODY + "<b " * 500 + ">"
    assert html_extract.closed(tags) == tags
    assert html_extract.closed(BODY + "<b " * 500) == BODY and html_extract.closed(BODY + "<!-- b " * 500) == BODY
