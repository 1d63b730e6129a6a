"""One hostile cell must not stop a job: work grows with the length of a text or page, and no more."""

import random
import time

import pytest

from tablewise.llm import pages, quality, secret_scan

from . import edge


@pytest.mark.parametrize(
    "html",
    ["<a " * 350_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "x" + "</b>" * 50_000, '<a ="' * 200_000 + ">", "<!--" * 200_000, "<" * 500_000 + ">", "<p " + "a=b " * 200_000 + ">x</p>"],
    ids=["open tags", "nested", "inline", "quotes", "comments", "signs", "attributes"],
)
def test_pages_take_linear_time(html):
    start = time.perf_counter()
    pages.page_tokens(html)
    assert time.perf_counter() - start < 20


def test_text_behind_the_last_tag_is_kept():
    assert [r[0] for r in pages.page_tokens("<p>one</p>two < three")[1]] == ["one", "two < three"]
    assert [r[0] for r in pages.page_tokens("no tag & all &lt;b&gt;")[1]] == ["no tag & all <b>"]
    assert [r[0] for r in pages.page_tokens("<p>one</p>two<!-- open")[1]] == ["one", "two"]
    assert [r[0] for r in pages.page_tokens("<p title='a>b' class=don't>one</p>")[1]] == ["one"]


@pytest.mark.parametrize("text", ["acgt" * 1_000_000, "a1" * 300_000, "9" * 500_000 + "://x", "a:" * 300_000], ids=["letters", "mixed", "digits", "colons"])
def test_addresses_take_linear_time(text):
    start = time.perf_counter()
    secret_scan.weak_parts(text, [])
    assert time.perf_counter() - start < 20


def test_schemes_begin_with_the_first_letter_of_their_run():
    assert secret_scan.weak_parts("see 9.+http://x/y and -a.b+c://z", []) == [("endpoint", 7, 17), ("endpoint", 23, 32)]


def test_repeats_of_a_text_of_a_million_words(spark):
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**7)) for _ in range(1_000_000))
    text += " x y z" * 3 + " " + text[:400]
    got = quality.text_counts(spark.createDataFrame([(text,)], "text string")).drop("words").first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == edge.plain_counts(text)
