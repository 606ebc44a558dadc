"""op3: an explicit article against longer text beside it, comments told by their build, what stays inside, deep pages."""

from __future__ import annotations

import time

import pytest

from lorekeep.llm.html_text import main_text

ARTICLE = "<article><h1>Head</h1><p>First paragraph of the article.</p><p>Second paragraph of it.</p></article>"
TEXT = "Head First paragraph of the article. Second paragraph of it."


@pytest.mark.parametrize("n", [2, 5, 12])
@pytest.mark.parametrize("words", [4, 40])
def test_article_keeps_its_place(n, words):
    said = "".join(f"<div class='o'><p>{' '.join([f'reader{k}'] * words)}.</p></div>" for k in range(n))
    assert main_text(f"<body>{ARTICLE}<div class='user-opinions'>{said}</div></body>") == TEXT
    assert main_text(f"<body><div class='zz'>{said}</div>{ARTICLE}</body>") == TEXT


@pytest.mark.parametrize("after", ['<div class="responses"><p>Q</p></div>', '<div class="discussion"><p>Long words of a reader, one after another.</p></div>', "<div class=foot>Contact us | Imprint</div>", "<div><p>Q q q q q q q q q q q q q q q</p></div>"])
def test_blocks_after_the_article(after):
    assert main_text(f"<body>{ARTICLE}{after}</body>") == TEXT
    assert main_text(f"<body><article><p>P</p></article>{after}</body>") == "P"


def test_comments_by_their_build():
    comment = "<div class=c9><b>{}</b> <i>{}</i><p>{}</p></div>"
    said = comment.format("Ann", "12 May 2020", "Nice one.") + comment.format("Bob", "3 days ago", "I do not think so at all, since it rained.")
    page = "<body><div id=story><h1>Title</h1><p>One paragraph of the story that is long enough.</p><p>And one more of the story.</p><div class=k>{}</div></div></body>"
    assert main_text(page.format(said)) == "Title One paragraph of the story that is long enough. And one more of the story."
    assert main_text(f"<article><p>Some text of the article.</p>{said}</article>") == "Some text of the article."
    kept = "<section class=c9><h2>{}</h2><p>In {} it was so.</p></section>"
    assert main_text(f"<article><p>Intro text here.</p>{kept.format('One', '12 May 2020')}{kept.format('Two', '13 May 2020')}</article>") == "Intro text here. One In 12 May 2020 it was so. Two In 13 May 2020 it was so."


def test_what_stays_inside():
    links = "<ul><li><a href=1>Link one</a><li><a href=2>Link two</a><li><a href=3>Link three</a></ul>"
    assert main_text(f"<body><div class=entry><p>A paragraph that is long enough to be text.</p>{links}<p>Another paragraph that is long enough.</p></div></body>") == (
        "A paragraph that is long enough to be text. Link one Link two Link three Another paragraph that is long enough."
    )
    assert main_text('<article><p>One.</p><p class="alert">Mind this.</p><p>Two.</p></article>') == "One. Mind this. Two."
    assert main_text('<article><p>One sentence of it.</p><p class="ad">Buy.</p><p>Another sentence of it.</p></article>') == "One sentence of it. Another sentence of it."


def test_open_comments_and_hidden_parts():
    assert main_text("<article><p>One.</p><!-- never closed <p>Two") == "One."
    assert main_text("<p>One.</p><!-- a --><p>Two.</p><!-- b <!-- c <p>Three") == "One. Two."
    assert main_text("<script>if (a <!-- b) {}</script><article><p>One.</p></article>") == "One."
    assert main_text('<article><p>One.</p><p style="color:red; display : none">Two.</p></article>') == "One."


@pytest.mark.parametrize("html", ["<ul><li>" * 20_000 + "x", "<div>" * 20_000 + "x", "<b>" * 20_000 + "</i>" * 20_000 + "x", "<p><span>" * 20_000 + "x", "<a><b>" * 20_000 + "x", "<table><tr><td>" * 20_000 + "<p>x"], ids=range(6))
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    assert main_text(html) in ("x", "")
    assert time.process_time() - began < 8
