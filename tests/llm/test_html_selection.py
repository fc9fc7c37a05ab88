"""Main text: quotes in attribute values, hidden elements, titles and ledes beside the body, names as hints."""

import pytest

from stockroom.llm.html_text import extract, main_text

FIRST = "The first sentence of the article, which is long enough. And another one, with marks."
SECOND = "A second paragraph follows; it says more, goes on for a while, and then it ends here."
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>" * 4


def test_apostrophe_in_an_unquoted_value():
    assert main_text(f"<p title=it's>{FIRST}</p><p>I don't know.</p>") == f"{FIRST}\n\nI don't know."
    assert main_text("<p title=it's>One.") == "One."
    assert main_text("<p title=\"a > b\" data-x='c > d' e=f\"g>One.") == "One."
    assert main_text("<p title=\"never closed>One.") == "One."


def test_attributes_that_only_speak_of_hiding():
    for attribute in ("data-note='display: none is css'", "data-x=\"aria-hidden='true'\"", "title='hidden'", "style='color: red'"):
        assert FIRST in main_text(f"<body><p {attribute}>{FIRST}</p>{BODY}</body>")
    for attribute in ("hidden", "aria-hidden=true", "style='color:red; display : none'", "HIDDEN=''"):
        assert "gone" not in main_text(f"<body><p {attribute}>It is gone, all of it.</p>{BODY}</body>")


@pytest.mark.parametrize("byline", ["", "<div class=byline>By A. Writer</div>"])
def test_title_and_lede_beside_the_body(byline):
    got = main_text(f"<body><div class=post><h1>Title</h1>{byline}<p>Lede of the piece.</p><div class=body>{BODY}</div></div><div class=sidebar>links</div></body>")
    assert got.startswith("Title\n\n" + ("By A. Writer\n\n" if byline else "") + f"Lede of the piece.\n\n{FIRST}") and "links" not in got


def test_titles_outside_stay_outside():
    page = f"<body><div class=top><h1>Site</h1></div><div class=post><h1>Title</h1>{BODY}</div></body>"
    assert main_text(page).startswith("Title")
    assert main_text(f"<body><header><h1>Site</h1></header><div>{BODY}</div></body>").startswith(FIRST)


def test_name_with_a_boilerplate_word_is_a_hint():
    section = f"<section id='legal-notice'><h2>Notice</h2><p>{SECOND} In law.</p></section>"
    assert f"Notice\n\n{SECOND} In law." in main_text(f"<body><article>{BODY}{section}</article></body>")
    links = "<div class='share-links'><a>Mail</a> <a>Print</a></div>"
    assert "Mail" not in main_text(f"<body><article>{BODY}{links}</article></body>")
    comments = f"<div id='reader-comments'><p>{FIRST} {SECOND} I like it.</p></div>"
    assert "I like it" not in main_text(f"<body><article>{BODY}{comments}</article></body>")


def test_long_page_and_empty_table(spark):
    page = f"<body><article>{BODY * 5_000}</article></body>"
    assert main_text(page).count(FIRST) == 20_000
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
