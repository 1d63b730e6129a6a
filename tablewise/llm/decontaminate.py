"""Benchmark decontamination with a positional inverted index.

Benchmark items are cut into windows of consecutive words. One pass over the documents counts the
corpus frequency of every benchmark term. Each window is then looked up by its rarest terms only:
a second pass stores the postings of those terms (document, position, and the words around it), the
offset-adjusted lists of a window's rarest terms are intersected, and what is left is compared with
the whole window. So frequent words are never listed, however many documents they fill.

The same lists give proximity matches: a window is near where all its terms but ``MISSING`` stand at most ``SLACK`` words from
their places (a word changed, left out, put in, two words swapped). As one more list than terms may be missing is
stored, each near match has a posting, whose words around it decide.

Documents are known by a 128-bit key of their text: exact copies share their postings, and a
document without an id is checked like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.staging import stage_table
from .text import lower_ascii, pinned, text_key

#: Characters between words, once A-Z are lower case.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a window.
WINDOW = 10
#: Terms of a whole window that a proximity match may lack (shorter windows: none), and words that a term may be off its place.
MISSING, SLACK = 1, 1
#: Rarest terms by which a window is looked up: more than may be missing.
RAREST = 2
#: Terms that one pass over the documents looks for; they are broadcast. More terms take more passes.
TERMS_A_PASS = 200_000
#: Windows that one pass over the postings looks for, likewise.
WINDOWS_A_PASS = 50_000


def split_terms(text: Column) -> Column:
    """Words of lower-case letters, digits and all characters beyond ASCII."""
    parts = F.split(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), "^" + GAPS, ""), GAPS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct windows ``(window_id, terms, items)`` of all items, ``items`` being the keys of those that hold it.

    An item of fewer words is one window; one without words has none.
    """
    words = pinned(items.select(key, text), _w=split_terms(F.col(text))).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    each = words.select(key, "_w", F.explode(starts).alias("_at")).select(key, F.slice("_w", F.col("_at"), window).alias("terms"))
    grouped = each.groupBy("terms").agg(F.collect_set(F.col(key).cast("string")).alias("items"))
    return grouped.select(F.xxhash64("terms").alias("window_id"), "terms", "items")


def _passes(terms: DataFrame) -> list[DataFrame]:
    """The terms in blocks that may be broadcast."""
    held = stage_table(terms.select("term").distinct())
    blocks = -(-held.count() // TERMS_A_PASS)
    if blocks <= 1:
        return [F.broadcast(held)]
    return [F.broadcast(held.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i)) for i in range(blocks)]


def _found(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows whose ``term`` is among the terms."""
    found = [words.join(block, "term", "left_semi") for block in _passes(terms)]
    return reduce(DataFrame.unionAll, found)


def rarest_terms(docs: DataFrame, windows: DataFrame, rarest: int = RAREST, text: str = "text", missing: int = MISSING) -> DataFrame:
    """``(window_id, term, offset, rank, lists, n)``: where the terms of least corpus frequency stand in each window.

    ``n`` is the frequency, and terms that no document holds have no list; windows with more than ``missing`` places of
    such terms are left out, as nothing can match them.
    """
    every = windows.select("window_id", F.posexplode("terms").alias("offset", "term"))
    words = pinned(docs.select(text), _w=split_terms(F.col(text))).select(F.explode("_w").alias("term"))
    frequency = _found(words, every).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    of_window = W.partitionBy("window_id")
    ranked = every.join(frequency, "term", "left").select(
        "window_id",
        "term",
        "offset",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.row_number().over(of_window.orderBy(F.coalesce("n", F.lit(0)), "offset")).alias("rank"),
        F.least(F.count(F.lit(1)).over(of_window), F.lit(rarest)).alias("lists"),
        F.count_if(F.col("n").isNull()).over(of_window).alias("_none"),
    )
    return ranked.where((F.col("rank") <= rarest) & (F.col("_none") <= missing) & (F.col("n") > 0)).drop("_none")


def build_index(docs: DataFrame, terms: DataFrame, reach: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Postings of the given terms, and one entry a document with the number of its words.

    A posting is ``(doc, term, position, near)``: the key of the text, the place of the term (from 0) and
    the words from ``reach`` before to ``reach`` after it. The entry of the document itself has the empty
    term, position -1, its id and ``n_words``.
    """
    named = pinned(docs.select(key, text), _w=split_terms(F.col(text))).select(
        F.col(key).alias("id"), text_key(F.col(text)).alias("doc"), "_w"
    )
    placed = named.select("id", "doc", "_w", F.posexplode(F.concat(F.array(F.lit("")), "_w")).alias("_at", "term"))
    own = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    position = F.col("_at") - 1
    first = F.greatest(position - reach, F.lit(0))
    listed = position >= 0
    return _found(placed, terms.select("term").unionAll(own)).select(
        F.when(~listed, F.col("id")).alias("id"),
        "doc",
        "term",
        position.alias("position"),
        F.when(listed, F.slice("_w", first + 1, position - first + 1 + reach)).alias("near"),
        F.when(~listed, F.size("_w").cast("long")).alias("n_words"),
    )


def window_matches(index: DataFrame, windows: DataFrame, seeds: DataFrame, reach: int, whole: int = WINDOW) -> DataFrame:
    """``(doc, window_id, start, length, phrase, near)``: where a document holds a window in a row, or nearly.

    For phrases the lists of a window's rarest terms are intersected on (document, window, start); the posting of the rarest
    one has seen the whole window. Near windows are decided at any of their postings: at some shift of the window by
    at most ``SLACK`` words, all its terms but ``MISSING`` (of windows of ``whole`` words) are at most ``SLACK`` words off.
    """
    postings = index.where(F.col("position") >= 0).select("doc", "term", "position", "near")
    plan = stage_table(seeds.join(windows.select("window_id", "terms"), "window_id"))
    blocks = -(-plan.count() // (RAREST * WINDOWS_A_PASS)) or 1
    parts = [plan.where(F.pmod(F.col("window_id"), F.lit(blocks)) == i) for i in range(blocks)]
    found = reduce(DataFrame.unionAll, [postings.join(F.broadcast(part), "term") for part in parts])
    start = F.col("position") - F.col("offset")
    at = F.least("position", F.lit(reach)) - F.col("offset")
    missing = F.when(F.size("terms") >= whole, F.lit(MISSING)).otherwise(F.lit(0))
    stands = " OR ".join(f"get(near, _at + d + j + {k}) <=> t" for k in range(-SLACK, SLACK + 1))
    shifts = ", ".join(str(d) for d in range(-SLACK, SLACK + 1))
    in_place = F.expr(f"exists(array({shifts}), d -> size(filter(terms, (t, j) -> {stands})) >= size(terms) - _missing)")
    # Most postings lack several of the window's terms altogether.
    close = F.size(F.array_except("terms", "near")) <= F.col("_missing")
    lists = (
        found.withColumn("_at", at)
        .withColumn("_missing", missing)
        .select(
            "doc",
            "window_id",
            "rank",
            "lists",
            start.alias("start"),
            F.size("terms").alias("length"),
            ((F.col("rank") == 1) & (start >= 0) & (F.slice("near", F.greatest(F.col("_at"), F.lit(0)) + 1, F.size("terms")) == F.col("terms"))).alias("exact"),
            F.when(close, in_place).otherwise(F.lit(False)).alias("near"),
        )
        .where((F.col("rank") > 1) | F.col("exact") | F.col("near"))
    )
    together = lists.groupBy("doc", "window_id", "start", "length", "lists").agg(
        F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("_ranks"), F.bool_or("exact").alias("_exact"), F.bool_or("near").alias("near")
    )
    phrase = F.col("_exact") & (F.col("_ranks") == F.expr("shiftleft(1, lists) - 1"))
    return together.select("doc", "window_id", "start", "length", phrase.alias("phrase"), "near").where(F.col("phrase") | F.col("near"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """One row a document: ``key, n_words, n_hit, n_items, items, contaminated, near_items``.

    ``n_hit`` counts the words inside any occurrence of a window of an item, ``items`` holds the keys of
    the items with such windows, sorted as strings, ``near_items`` those with near windows only: a document with
    these alone is not contaminated. Null texts and texts without words have no hits; an
    item without words has no window; without items nothing is contaminated; equal texts give equal rows
    and repeated rows and null keys stay; other columns are not looked at.
    """
    windows = stage_table(item_windows(items, window, item_text, item_key))
    seeds = stage_table(rarest_terms(docs, windows, RAREST, text))
    reach = window - 1 + 2 * SLACK
    index = stage_table(build_index(docs, seeds, reach, text, key))
    found = stage_table(window_matches(index, windows, seeds, reach, window))
    matches = found.where("phrase")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    spans = matches.groupBy("doc", "start").agg(F.max("length").alias("length"))
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    covered = spans.withColumn("_new", fresh).groupBy("doc").agg(F.sum("_new").cast("long").alias("n_hit"))
    held = (
        found.groupBy("doc", "window_id")
        .agg(F.bool_or("phrase").alias("phrase"))
        .join(windows.select("window_id", "items"), "window_id")
        .select("doc", "phrase", F.explode("items").alias("item"))
        .groupBy("doc")
        .agg(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("item")))).alias("items"), F.collect_set("item").alias("_all"))
    )
    entries = index.where(F.col("position") < 0).select(F.col("id").alias(key), "doc", "n_words")
    none = F.array().cast("array<string>")
    return entries.join(held.join(covered, "doc", "left"), "doc", "left").select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.sort_array(F.coalesce(F.array_except("_all", "items"), none)).alias("near_items"),
    )

