"""Template deduction on hosts whose markup tells little, against a plain version."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tablewise.llm import pages

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def plain_texts(rows):
    """The same deduction with sets of pages in place of sums of hashes."""
    hosts = defaultdict(list)
    for i, url, html in rows:
        hosts[url.split("/")[2]].append((i, html, *pages.page_tokens(html)))
    out = {}
    for held in hosts.values():
        holders, below = defaultdict(set), defaultdict(set)
        for _, html, tokens, _ in held:
            for token, place, is_text in tokens:
                holders[token, is_text].add(html)
                if is_text:
                    below[place].add(token)
        filled = {
            place
            for place, found in below.items()
            if len(holders[place, False]) > 1 and all(holders[t, True] == holders[place, False] for t in found)
        }
        for i, _, _, runs in held:
            runs = [r for r in runs if r[2]] or runs
            slots = [r for r in runs if r[3] or r[1] not in filled] or runs
            out[i] = "\n\n".join(r[0] for r in slots)
    return out


def test_two_layouts_of_a_host(spark):
    """60 % of the pages have one layout, 40 % another; each has furniture of its own, without telling names."""
    rows, want = [], {}
    for i in range(10):
        story = f"<div class=k3><p>story {i}</p><p>The same line.</p></div>"
        layout = f"<div class=k1><p>Our shop</p></div>{story}" if i % 5 < 3 else f"<section class=k7>{story}<div class=k8>Ring us</div></section>"
        rows.append((i, "http://a.example/", f"<html><body class='post-{i}'><div id=post-{i} class='post-{i} hentry'>{layout}<p class=k9>All rights</p></div></body></html>"))
        want[i] = f"story {i}\n\nThe same line."
    assert texts(spark, rows) == want == plain_texts(rows)


def test_few_pages_are_enough(spark):
    rows = [(i, "http://a.example/", f"<body><div class=a>Welcome</div><div class=b>text {i}</div></body>") for i in range(3)]
    assert texts(spark, rows) == {i: f"text {i}" for i in range(3)}
    assert texts(spark, rows[:2]) == {i: f"text {i}" for i in range(2)}
    assert texts(spark, rows[:1]) == {0: "Welcome\n\ntext 0"}
    # Copies of one page tell nothing apart.
    assert texts(spark, [rows[0], (7, *rows[0][1:])]) == {0: "Welcome\n\ntext 0", 7: "Welcome\n\ntext 0"}


def test_template_inside_articles(spark):
    """Names say nothing inside an article; what all pages have at a place of their own class goes."""
    body = "<article class=post-{0}><h1>The title</h1><p>A line of all.<p class='share price'>{0} euros</p><div class='related-work'>work {0}</div><div class=box>Tell a friend</div><div class=ad>Buy {0}</div></article>"
    rows = [(i, "http://a.example/", body.format(i)) for i in range(4)]
    want = {i: f"The title\n\nA line of all.\n\n{i} euros\n\nwork {i}" for i in range(4)}
    assert texts(spark, rows) == want == plain_texts(rows)


@pytest.mark.parametrize("places", [0, 1000])
def test_against_plain_deduction(spark, monkeypatch, places):
    monkeypatch.setattr(pages, "PLACES_AT_ONCE", places)
    draw = random.Random(7)
    rows = []
    for i in range(120):
        words = lambda n: " ".join(draw.choice("one two three four five".split()) for _ in range(n))
        parts = [
            f"<div class=k{draw.randrange(4)}><p>{draw.choice(['Shared line', words(3)])}</p>{words(draw.randrange(3))}</div>" for _ in range(draw.randrange(1, 6))
        ]
        inner = "".join(parts)
        rows.append((i, f"http://h{draw.randrange(8)}.example/{i}", f"<body>{inner}</body>" if i % 3 else f"<body><p>menu</p><article>{inner}</article></body>"))
    rows += [(1000 + i, *rows[i][1:]) for i in range(10)]
    got = texts(spark, rows)
    assert got == plain_texts(rows)
    off = {i: "\n\n".join(r[0] for r in [r for r in pages.page_tokens(h)[1] if r[2]] or pages.page_tokens(h)[1]) for i, _, h in rows}
    assert got != off
