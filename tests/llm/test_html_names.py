"""Main text: names of elements around the article, of headings, and hidden as a class word."""

from stockroom.llm.html_text import main_text

BODY = "<p>The first sentence of the article, which is long enough. And another, with marks.</p><p>A second paragraph follows; it says more, and ends here.</p>"


def test_names_do_not_drop_the_article():
    for around in ("div class='with-sidebar'", "div class='post has-comments'", "main class='search-layout'", "div class='overflow hidden'", "div title='the hidden cost'"):
        got = main_text(f"<body><{around}>{BODY}</{around.split()[0]}><div class='sidebar'>short links</div></body>")
        assert "first sentence" in got and "second paragraph" in got and "short links" not in got
    assert "Related work" in main_text(f"<body><article>{BODY}<h2 id='related-work'>Related work</h2>{BODY}</article></body>")
    assert "gone" not in main_text(f"<body>{BODY}<p hidden>gone.</p></body>")
