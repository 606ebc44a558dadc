"""op3: whole articles of many layouts, with exact expected texts."""

from __future__ import annotations

import html
import random

import pytest

LONG = "A long paragraph with many words that carries what the article says and does not end before it is long enough."
ART = f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article>"
WHOLE = f"Title {LONG} Short. {LONG}"
PROBES = {
    "no-sidebar": (f'<body><nav><a href="#">x</a></nav><div class="content no-sidebar">{ART}</div></body>', WHOLE),
    "with-related": (f'<div class="page with-related">{ART}</div>', WHOLE),
    "open p": (f"<p class=ad>Buy now<div>{ART}</div>", WHOLE),
    "open li": (f'<ul><li class="share">Share<li>{ART}</ul>', WHOLE),
    "lead in main": (f"<main><h1>Title</h1><p>Lead of it<article><p>{LONG}</p></article></main>", f"Title Lead of it {LONG}"),
    "two articles": (f"<body><div>junk</div><article><p>{LONG}</p></article><article><p>{LONG} Second.</p></article></body>", f"{LONG} {LONG} Second."),
    "no container": (f"<body><p>Hi</p><p>{LONG}</p><p><a href=x>a link that is all the paragraph</a></p><p>{LONG}</p><p>End.</p></body>", f"Hi {LONG} a link that is all the paragraph {LONG} End."),
    "alert-free": (f'<article><p>{LONG}</p><p class="alert-free">free</p><p class="alert">Cookies!</p></article>', f"{LONG} free"),
    "long comments": (f'<div><div class=post><h1>T</h1><p>{LONG}</p></div><div id="comments">{ART * 3}</div></div>', f"T {LONG}"),
    "page in a form": (f"<form><div class=menu><a>1</a></div><div><p>{LONG}</p><p>x</p></div></form>", f"{LONG} x"),
    "menus without names": (f"<body><div><a>Home</a> <a>News of today</a> <a>About</a></div><div><p>{LONG}</p><p>z <a>q</a></p></div><ul><li><a>Related one</a><li><a>two</a><li><a>three</a></ul></body>", f"{LONG} z q"),
    "cells": (f"<table><tr><td class=menu><a>m</a><td><p>{LONG}<p>k<tr><td>x</table>", f"{LONG} k"),
    "script inside": (f'<article><p>{LONG}foo<script>var x="</p>"</script>bar</p></article>', f"{LONG}foobar"),
    "related teasers": (f'{ART}<div class="related"><article><p>{LONG}</p></article></div>', WHOLE),
    "heading outside": (f"<div><h1>Title</h1><div></div><div><p>{LONG}</p><p>last</p></div></div><div class=footer>f</div>", f"Title {LONG} last"),
    "only names": ('<div class="widget"><p>All there is.</p></div>', "All there is."),
    "header of the article": (f"<header>Site</header><article><header><h1>T</h1></header><p>{LONG}</p><footer>by me</footer></article>", f"T {LONG}"),
    "links only": ("<p><a href=x>one</a></p>", "one"),
}


@pytest.mark.parametrize("name", list(PROBES))
def test_layouts(name):
    from lorekeep.llm import html_text

    page, want = PROBES[name]
    assert html_text.main_text(page) == want


def test_generated_pages_give_exactly_the_article(spark):
    from lorekeep.llm import html_text

    rng = random.Random(21)
    vocab = ["amber", "river", "stone", "über", "niña", "R&D", "a<b", "42", "walks", "under", "the", "old", "bridge,", "slowly."]
    say = lambda lo, hi: " ".join(rng.choice(vocab) for _ in range(rng.randint(lo, hi)))
    rows, want = [], {}
    for i in range(300):
        blocks, texts = [], []
        for k in range(rng.randint(1, 9)):
            text = say(1, 4) if k and rng.random() < 0.3 else say(15, 90)
            tag = rng.choice(("p", "p", "p", "h2", "blockquote", "li"))
            inner = html.escape(text, quote=False)
            if rng.random() < 0.3:
                inner = inner.replace(" ", " <b>", 1) + ("</b>" if " " in text else "")
            closing = "" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"
            block = f"<{tag}>{inner}{closing}"
            blocks.append(f"<ul>{block}</ul>" if tag == "li" else block)
            texts.append(text)
        body = "".join(blocks)
        if rng.random() < 0.4:
            body = body.replace("</h2>", '</h2><div class="ad">Buy it</div>', 1)
        box = rng.choice(("<article>{}</article>", "<main><article>{}</article></main>", '<div class="content no-sidebar">{}</div>', '<div id="main-text"><section>{}</section></div>', "<div>{}</div>"))
        menu = rng.choice(("<nav>{}</nav>", '<div class="site-menu">{}</div>', "<div>{}</div>", "<ul>{}</ul>")).format("".join(f"<li><a href=/{k}>{say(1, 2)}</a></li>" for k in range(5)))
        tail = rng.choice(("", f'<section id="comments"><article class="comment"><p>{html.escape(say(5, 60))}</p></article></section>', f'<aside>{html.escape(say(3, 9))}</aside>', "<form><label>Mail</label><input></form>"))
        page = f"<!DOCTYPE html><html><head><title>t</title><script>if(a<b){{}}</script></head><body><header>Site</header>{menu}{box.format(body)}{tail}<footer>&copy; us</footer></body></html>"
        rows.append((i, None, page, "clash"))
        want[i] = " ".join(texts)
    rows += [(900, "u", None, ""), (901, "u", "<div>" * 3000 + "deep " * 20_000, None)]
    want |= {900: "", 901: " ".join(["deep"] * 20_000)}
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert [i for i in want if got[i]["text"] != want[i]] == []
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
