"""Templates do not depend on a host's size or on copies of its pages."""

import pytest

from lakeloom.llm import html

BOX = "<div><p>Read our other stories on this site</p></div>"


def page(i, box=""):
    return f"<body><div><h2>Story {i}</h2><p>Text of {i}</p></div>{box}</body>"


@pytest.mark.parametrize("bound", [html.BROADCAST_TEMPLATES, 0])
def test_size_and_copies_play_no_part(spark, monkeypatch, bound):
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", bound)
    rows = [(i, f"https://big.example/{i}", page(i, BOX if i < 9 else "")) for i in range(200)]  # a box on 9 of 200 pages
    rows += [(300 + i, f"https://few.example/{i}", page(7)) for i in range(6)] + [(400 + i, f"https://few.example/x{i}", page(400 + i)) for i in range(4)]  # six copies of one page
    rows += [(500 + i, f"https://four.example/{i}", page(i, BOX)) for i in range(4)]  # a box on too few pages
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i}\nText of {i}" for i in range(200))
    assert all(got[300 + i] == "Story 7\nText of 7" for i in range(6))
    assert all(got[500 + i] == f"Story {i}\nText of {i}\nRead our other stories on this site" for i in range(4))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='content has-sidebar'><h1>T</h1><p>Running text of the page</p></div><div class='sidebar'>s</div></body>", "T\nRunning text of the page"),
        ("<body><form id='aspnetForm'><div class='menu'><a>x</a></div><div><h1>T</h1><p>Running text of the page</p></div></form></body>", "T\nRunning text of the page"),
        ("<body><div class='page-notice'><h1>T</h1><p>All of the page stands in this box</p></div><p>x</p></body>", "T\nAll of the page stands in this box\nx"),
        ("<article><p>a</p><p class='social-history'>b</p><div class='related-work'><p>Others did <a>this</a> before us</p></div></article>", "a\nb\nOthers did this before us"),
        ("<article><p>a</p><div class='related-posts'><a href=1>One more</a> <a href=2>Another</a></div><form>Your mail</form></article>", "a"),
        ("<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>About</a></div><div><p>Text with <a>a link</a> in it</p></div></body>", "Text with a link in it"),
        ("<main><p>short</p></main><section class='comments'><p>A very long comment, far longer than the text of the page itself.</p></section>", "short"),
        ("<article><p>see</p><ul><li><a>one</a></li><li><a>two</a></li></ul></article>", "see\none\ntwo"),
    ],
)
def test_names_and_link_density(page, text):
    assert html.Page(page).text() == text


@pytest.mark.parametrize("bound", [html.BROADCAST_TEMPLATES, 0])
def test_boxes_without_telling_names(spark, monkeypatch, bound):
    """Menus, notices and comment boxes in plain divs go with the templates, and stay when the pass is off."""
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", bound)
    boxes = ["<div><p>Home News About</p></div>", "<section><p>We keep data on your machine.</p></section>", "<div><h3>Say what you think</h3><p>Be kind to others.</p></div>"]
    wrap = lambda i: f"<div>{boxes[0]}<div><h1>Story {i}</h1><p>Text {i} of this page</p>{boxes[1]}</div>{boxes[2]}</div>"
    rows = [(i, f"https://plain.example/{i}", f"<body>{wrap(i)}</body>" if i % 2 else f"<body><article><h1>Story {i}</h1><p>Text {i} of this page</p>{boxes[1]}</article>{boxes[2]}</body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {i: f"Story {i}\nText {i} of this page" for i in range(12)}
    off = {r.page_id: r.text for r in html.extract(pages, min_pages=1000).collect()}
    assert all("We keep data" in t for t in off.values()) and "Home News" in off[1]


def test_a_very_long_page():
    page = "<body><nav><a>x</a></nav><article>" + "<p>some words &amp; more of them</p>" * 600_000 + "</article></body>"
    assert len(page) > 20_000_000
    text = html.Page(page).text()
    assert text.count("\n") == 599_999 and text.startswith("some words & more of them\nsome")
