"""Varied pages whose main text is known: layouts, wrappers, noise and blocks are drawn by a seed."""

import random
import time
from html import escape

import pytest

from tessera.llm import html_extract as H

WORDS = "river stone market letter garden winter engine table bridge summer paper island forest mirror candle".split()
WRAPPERS = [
    "", "class='layout has-sidebar'", "class='post tag-news'", "id='wrap' class='sidebar-right'", "id='search-engines'", "class='content'",
    "class='page-header-fixed'", "class='site no-nav'", "id='main-menu-layout'", "class='ad-free'",
]
LAYOUTS = ["article", "main", "div", "sections", "body", "form", "table", "nested"]


def sentence(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    for k in range(6, n, 7):
        words[k] += ","
    return " ".join(words).capitalize() + rng.choice([".", " & more.", " <now>.", " “so”."])


def paragraph(rng):
    text = " ".join(sentence(rng, rng.randint(9, 16)) for _ in range(rng.randint(2, 4)))
    first, rest = text.split(" ", 1)
    inline = rng.choice(["<b>%s</b>", "<span class='tag'>%s</span>", "<a href='#'>%s</a>", "<em>%s</em>", "%s"])
    gap = rng.choice([" ", "\n  ", "<br>", "&#32;"])
    return f"<p>{inline % escape(first)}{gap}{escape(rest)}" + rng.choice(["</p>", "</p>", ""]), text


def blocks(rng):
    out = [("<h1>%s</h1>" % escape(t), t) for t in [sentence(rng, 5)]]
    for _ in range(rng.randint(4, 7)):
        out.append(paragraph(rng))
        kind = rng.randrange(5)
        if kind == 0:
            items = [sentence(rng, 4) for _ in range(3)]
            out.append(("<ul>" + "".join(f"<li>{escape(t)}" for t in items) + "</ul>", "\n".join(items)))
        elif kind == 1:
            t = sentence(rng, 12)
            out.append((f"<blockquote>{escape(t)}</blockquote>", t))
        elif kind == 2:
            t = sentence(rng, 4)
            out.append((f"<h2>{escape(t)}</h2>", t))
            out.append(paragraph(rng))
    return out


def noise(rng):
    t = lambda n: escape(sentence(rng, n))
    every = [
        f"<nav><ul><li><a href='/'>{t(2)}</a><li><a href='/x'>{t(2)}</a></ul></nav>", f"<header><a href='/'>{t(3)}</a></header>", f"<footer>{t(6)}</footer>",
        f"<aside><p>{t(30)}</p></aside>", f"<div class='cookie-notice'><p>{t(25)}</p></div>", f"<div class='ad'>{t(8)}</div>", f"<div class='sidebar'><p>{t(20)}</p></div>",
        f"<form action='/s'><p>{t(5)}</p><input><button>{t(1)}</button></form>", f"<script>var x = '<p>{'y ' * 40}</p>';</script>", "<style>p{color:red}</style>", f"<!-- <p>{t(20)}</p> -->",
    ]
    rng.shuffle(every)
    return every[: rng.randint(4, len(every))]


def page(seed):
    rng = random.Random(seed)
    layout, wrapper, body = LAYOUTS[seed % len(LAYOUTS)], rng.choice(WRAPPERS), blocks(rng)
    text, inner = "\n".join(t for _, t in body), "".join(h for h, _ in body)
    if layout in ("article", "main"):
        core = f"<{layout}>{inner}</{layout}>"
    elif layout == "sections":
        cut = len(body) // 2
        core = "".join(f"<section><div class='part'>{''.join(h for h, _ in part)}</div></section>" for part in (body[:cut], body[cut:]))
        core = f"<div id='content'>{core}</div>"
    elif layout == "body":
        core = inner
    elif layout == "form":
        core = f"<form method='post' action='page.aspx'><input type='hidden'><div id='content'>{inner}</div></form>"
    elif layout == "table":
        core = f"<table><tr><td>{inner}</td></tr></table>"
    elif layout == "nested":
        core = f"<div><div><div class='entry'>{inner}</div></div></div>"
    else:
        core = f"<div class='text'>{inner}</div>"
    if layout not in ("body",):
        core = f"<div {wrapper}>{core}</div>"
        comments = "".join(f"<div class='comment'><p>{escape(sentence(rng, 14))}</p></div>" for _ in range(3))
        core += f"<div id='comments'><h3>Comments</h3>{comments}</div>"
    around = noise(rng)
    half = rng.randint(0, len(around))
    if layout == "body":
        core = "<div></div>" + core + "<div></div>"
    return f"<html><head><title>T</title></head><body>{''.join(around[:half])}{core}{''.join(around[half:])}</body></html>", text


@pytest.mark.parametrize("seed", range(64))
def test_known_pages(seed):
    html, want = page(seed)
    assert H.main_text(html) == want


@pytest.mark.parametrize("tag", ["div", "article"])
def test_a_page_in_a_form_and_a_form_in_a_page(tag):
    prose = "".join(paragraph(random.Random(k))[0] for k in range(3))
    ask = "<form><p>Your name, your mail, and what you have to say about it, please, in a few words, or in many of them.</p><input></form>"
    got = H.main_text(f"<body><{tag}>{prose}{ask}</{tag}></body>")
    assert got.count("\n") == 2 and "Your name" not in got
    assert H.main_text(f"<body><form><{tag}>{prose}</{tag}><button>Send</button></form></body>") == got
    assert H.main_text(f"<body>{ask}</body>") == ""


def test_nothing_but_what_names_cut_is_kept():
    html = "".join(f"<div class='{c}'><p>{'word ' * 30}</p></div>" for c in ("notice", "promo", "banner"))
    assert H.main_text(f"<body>{html}</body>") != ""
    assert H.main_text(f"<body><div class='comments'><p>{'word ' * 30}</p></div></body>") == ""


def test_an_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string, n_chars int")).collect() == []


LINE = "This paragraph has more than eighty characters, a comma or two, and says number %d of what the article has to say."


@pytest.mark.parametrize("name", ["comments-closed", "post reply-style", "comment-status-open no-comments", "skip-me", "shared-desk"])
def test_names_that_only_hold_a_word_of_what_is_cut(name):
    body = "".join(f"<p>{LINE % k}</p>" for k in range(3))
    html = f'<body><div class="{name}">{body}</div><div id="footer"><p>{LINE % 9}</p></div></body>'
    assert H.main_text(html) == "\n".join(LINE % k for k in range(3))


def test_parts_of_an_article_named_after_what_is_cut():
    parts = '<div class="discussion"><h2>Discussion</h2><p>{0}</p></div><div id="related-work"><h2>Related work</h2><p>{1}</p></div>'
    html = f'<body><article><p>{LINE % 0}</p>{parts.format(LINE % 1, LINE % 2)}<div class="comments"><p>{LINE % 8}</p></div></article></body>'
    assert H.main_text(html) == "\n".join([LINE % 0, "Discussion", LINE % 1, "Related work", LINE % 2])


@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "commentlist", "disqus_thread", "discussion", "comment-17", "reader-comments section"])
def test_comments_are_cut(name):
    html = f'<body><main><p>{LINE % 0}</p></main><div class="{name}">' + "".join(f"<p>{LINE % k}</p>" for k in range(1, 6)) + "</div></body>"
    assert H.main_text(html) == LINE % 0
    plain = f'<body><div class="text"><p>{LINE % 0}</p><p>{LINE % 1}</p></div><div id="{name.split()[0]}"><p>{LINE % 3}</p></div></body>'
    assert H.main_text(plain) == "\n".join([LINE % 0, LINE % 1])


def test_short_sections_stay():
    long_ = "<section>" + "".join(f"<p>{LINE % k}</p>" for k in range(12)) + "</section>"
    html = f'<body><div id="content">{long_}<section><p>{LINE % 12}</p></section></div></body>'
    assert H.main_text(html) == "\n".join(LINE % k for k in range(13))


def test_paragraphs_of_other_names():
    html = f'<body><article><p>{LINE % 0}</p><p class="note skip-me">{LINE % 1}</p><p class="cookie-notice">{LINE % 2}</p><p class="ad">{LINE % 3}</p></article></body>'
    assert H.main_text(html) == "\n".join([LINE % 0, LINE % 1])


@pytest.mark.parametrize("piece", ["<div>x</p>", '<a b="', "<a '\" ", "<b><div>x</div>", "<span><div>x", "<li><span>x", "</i><b>x", "<td>x</tr>", "<p><i>x</p>", "<!-- x", "<script>x"])
def test_malformed_long_pages_take_linear_time(piece):
    def seconds(n):
        began = time.perf_counter()
        H.main_text(f"<body><p>{LINE % 1}</p>" + piece * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(32_000) < 100 * max(0.01, min(seconds(2_000) for _ in range(3)))


def test_page_of_five_megabytes():
    body = "".join(f"<p>{LINE % k}</p>\n" for k in range(42_000))
    html = f"<html><body><nav>menu</nav><article>{body}</article><footer>end</footer></body></html>"
    assert len(html) > 5_000_000 and H.main_text(html) == "\n".join(LINE % k for k in range(42_000))
