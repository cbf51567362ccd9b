from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from lanternwatch.llm import htmltext
from lanternwatch.llm.htmltext import extract

PROSE = "A paragraph of some length, with a comma or two, that reads like an article."


class Plain(HTMLParser):
    """A second, simple extractor: the blocks inside ``article``."""

    def __init__(self):
        super().__init__()
        self.blocks, self.run, self.on = [], [], 0

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        self.blocks += [text] if text else []

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        if self.on and tag == "br":
            self.run.append(" ")
        elif self.on and tag in htmltext.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if self.on and tag in htmltext.BLOCKS:
            self.flush()
        self.on -= tag == "article"

    def handle_data(self, data):
        if self.on:
            self.run.append(data)


def plain(html):
    p = Plain()
    p.feed(html or "")
    p.close()
    return "\n\n".join(p.blocks)


def test_whole_table_against_a_second_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract_pages(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_quotes_open_values_only():
    assert extract(f'<p class=x">A {PROSE}</p><p class=y">B {PROSE}</p>') == f"A {PROSE}\n\nB {PROSE}"
    assert extract(f"<p title=\"never closed>{PROSE}</p><p>Don't {PROSE}</p>") == f"{PROSE}\n\nDon't {PROSE}"
    assert extract(f"<article><p title='a > b'>{PROSE}</p><p>1 < 2 and a <b>bold</b> word</p></article>") == f"{PROSE}\n\n1 < 2 and a bold word"


@pytest.mark.parametrize("piece", ['<p title="', "<p a='x>", "<", "</", "<!--", "<svg>", "<a href=x>", "<div><li></p>", "<h1>", "<article>", '<p =="', "<p a= "])
def test_nothing_unclosed_is_slow(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 20


def test_link_text_across_blocks():
    cards = "".join(f"<a href=/{i}><div><p>Card {i}, a teaser, {PROSE}</p></div></a>" for i in range(20))
    assert extract(f"<body><div class=cards>{cards}</div><div class=post><p>{PROSE}</p><p>More of it.</p></div>") == f"{PROSE}\n\nMore of it."
    assert extract(f"<article><p><a href=x>unclosed</p><p>{PROSE}</p></article>") == f"unclosed\n\n{PROSE}"


def test_parts_of_an_article_stay():
    parts = [("legal", "The legal part."), ("side", "A side."), ("discussion", "What it means."), ("responses", "Answers given."), ("bottom", "The end."), ("notice", "Note this.")]
    body = "".join(f'<div class="{c}"><p>{t}</p></div>' for c, t in parts)
    sources = "<ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul>"
    page = f"<nav>menu</nav><article><h1>Title</h1><p>{PROSE}</p>{body}{sources}<div class=advert>Buy!</div><form><p>Write to us</p></form></article><div class=notice><p>{PROSE}</p></div>"
    assert extract(page) == "\n\n".join(["Title", PROSE, *[t for _, t in parts], "Source one", "Source two"])


def test_titles_and_names_of_containers():
    assert extract(f"<div class=content><h1>Title</h1><div class=text><p>{PROSE}</p></div></div>") == f"Title\n\n{PROSE}"
    assert extract(f'<html><head><title>x</title><body class=with-sidebar><div class="page has-sidebar"><article><p>{PROSE}</p></article><div class=sidebar><p>{PROSE}</p></div></div>') == PROSE
    comments = f"<div id=comments class=comments-area><article class=comment-body><p>I say, {PROSE}</p></article></div>"
    assert extract(f"<main><div class=entry><p>{PROSE}</p></div>{comments}</main>") == PROSE


def test_markup_and_hidden_parts():
    assert extract(f"<article><p hidden>no</p><p style='display: none'>no</p><p>{PROSE} &lt;b&gt; &amp;nbsp; &eacute;&#233;</p><script>if (a < b) document.write('<p>no</p>')</script></article>") == f"{PROSE} <b> &nbsp; éé"
    assert extract("<div>" * 5000 + f"<p>{PROSE}</p>") == PROSE
    assert [extract(x) for x in (None, "", "   ", "<p></p>", "<!-- x", "<script>x")] == [""] * 6


def test_empty_table_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "x", 3), (1, "u", f"<article><p>{PROSE}</p></article>", "x", 3), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = htmltext.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), (PROSE, len(PROSE)), (PROSE, len(PROSE))]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0
