"""Phrases, target resampling and fingerprints against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tablewise.llm import collocations, resampling, text, winnowing

from . import edge


@pytest.fixture(scope="module")
def docs(spark):
    return edge.edge_documents(spark).cache()


def rows(values):
    return sorted(values, key=repr)


# 11: phrase collocations

PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_rows(df):
    return edge.as_rows(df, *PHRASE)


@pytest.mark.parametrize("suffixes", [4_000_000, 40, 3])
def test_collocations_equal_counting_one_by_one(docs, suffixes):
    """Also where nearly every prefix fills a group and is extended to its full depth."""
    plain = [(r.text, r.lang) for r in docs.collect()]
    got = collocations.collocations(docs, min_count=3, top=60, group_suffixes=suffixes)
    assert phrase_rows(got) == rows(edge.plain_collocations(plain, min_count=3, top=60))


def hot_passages(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    passage = "all of this. stands in A third of, all"
    some = [(" ".join(rng.choices(vocabulary, k=25)) + rng.choice(["!", "\n", ":x;", "\t\tend"]) + passage, rng.choice(["en", None, "und", "é"])) for _ in range(300)]
    return some + [("the the the the the the the", "en")] * 40 + [(None, None), ("", "en"), (" \t", "xx"), (".,;", "xx")]


@pytest.mark.parametrize(("words", "percent", "chars"), [(2, 100, 8_000_000), (5, 60, 500), (7, 100, 2_000)])
def test_collocations_with_hot_words_and_small_blocks(spark, monkeypatch, words, percent, chars):
    monkeypatch.setattr(collocations, "BLOCK_CHARS", chars)
    plain = hot_passages(spark)
    df = spark.createDataFrame(plain, "text string, lang string").repartition(5)
    got = collocations.collocations(df, max_words=words, min_count=4, top=200, contained_percent=percent, group_suffixes=300)
    assert phrase_rows(got) == rows(edge.plain_collocations(plain, words, 4, 200, percent))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, words int, id int, block int, a int")
    assert collocations.collocations(empty).collect() == []
    rare = spark.createDataFrame([("one two three", "en", 1, 2, 3, 4)], empty.schema)
    assert collocations.collocations(rare).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(rare, max_words=1)


# 12: importance resampling

RESAMPLED = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize(("run", "share"), [(1, 20_000), (1, 20), (2, 20_000), (3, 100), (3, 1)])
def test_resampling_equals_hashing_one_by_one(spark, docs, monkeypatch, run, share):
    """Whatever is in the head, as states of words and pairs or not at all."""
    monkeypatch.setattr(resampling, "HEAD_SHARE", share)
    plain = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    items = [("the target SPEAKS of x x", 1), (None, 2), ("", 3), (plain[6][1], 4)]
    target = spark.createDataFrame(items, "text string, doc_id int")
    got = resampling.resample(docs.where("doc_id IS NOT NULL"), target, percent=40, max_run=run, buckets=97)
    want = edge.plain_resampled(plain, [t for t, _ in items], 40, run, 97)
    # Equal rows may change places.
    assert edge.as_rows(got, *RESAMPLED[:4]) == rows([w[:4] for w in want])
    assert sorted((r for r in edge.as_rows(got, "rank", "score") if r[0]), key=lambda r: r[0]) == sorted((w[4], w[3]) for w in want if w[4])


def test_resampling_with_null_keys_and_no_target(spark, docs):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, none, percent=100)
    want = edge.plain_resampled(plain, [], 100)
    assert edge.as_rows(got, *RESAMPLED[:4]) == rows([w[:4] for w in want])
    may = [w for w in want if w[4]]
    assert sorted(r[0] for r in edge.as_rows(got, "rank") if r[0]) == list(range(1, len(may) + 1))
    empty = spark.createDataFrame([], docs.schema)
    assert resampling.resample(empty, docs).collect() == []


def test_long_words_stay_out_of_the_head(spark):
    df = spark.createDataFrame([(1, ("x" * 70 + " y ") * 30)], "doc_id long, text string")
    head = resampling.frequent_head(df, 2)
    assert head.words.to_pylist() == [b"y"] and len(head.pairs) == 0
    want = edge.plain_resampled([(1, ("x" * 70 + " y ") * 30)], ["y y"], 100, 2)
    assert edge.as_rows(resampling.resample(df, spark.createDataFrame([("y y",)], "text string"), 100, 2), *RESAMPLED) == want


# 13: winnowing


@pytest.mark.parametrize(("gram", "window", "stretch"), [(3, 4, 1 << 15), (3, 4, 7), (2, 17, 64), (1, 1, 10), (8, 13, 100)])
def test_winnowing_equals_looking_at_every_window(docs, monkeypatch, gram, window, stretch):
    monkeypatch.setattr(winnowing, "STRETCH", stretch)
    want = rows([(r.doc_id, edge.plain_winnow(r.text, gram, window)) for r in docs.collect()])
    got = winnowing.fingerprints(docs, gram=gram, window=window).collect()
    assert rows([(r.doc_id, [tuple(s) for s in r.fingerprint]) for r in got]) == want


def test_texts_that_share_enough_words_share_a_hash(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choices(["a", "b", "c", "\u00e9", "dd"], k=n))
    texts = []
    for i in range(60):
        shared = noise(6)
        texts.append((i, " ".join([noise(rng.randint(1, 90)), shared, noise(50)]), " ".join([noise(rng.randint(1, 9)), shared, noise(2)])))
    df = spark.createDataFrame(texts, "i int, a string, b string")
    pairs = df.select("i", *[winnowing.spans(winnowing.winnow(text.split_words(F.col(c)))).alias(c) for c in "ab"])
    found = winnowing.shared_spans(pairs, "i", "a", "b").collect()
    assert {s.i for s in found} == set(range(60))
    run = lambda t, at: t.split(" ")[at : at + 3]
    assert all(run(texts[s.i][1], s.left) == run(texts[s.i][2], s.right) for s in found)


@pytest.mark.parametrize("buckets", [1, 4])
def test_edited_texts_and_next_rows(spark, docs, monkeypatch, buckets):
    monkeypatch.setattr(winnowing, "BUCKETS_A_PARTITION", buckets)
    known = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit(1).alias("at"), F.lit("c").alias("_key"), F.lit(0).alias("k"))
    known = spark.createDataFrame(known.collect(), known.schema).repartition(3).cache()
    plain = sorted(((r.doc_id, r.text or "") for r in known.collect()), reverse=True)
    got = winnowing.edited_likeness(known).collect()
    unpacked = lambda p: [(x >> 31, winnowing.LAST - (x & winnowing.LAST)) for x in p]
    found = [(r.doc_id, r.n_chars, r.edited, unpacked(r.packed), unpacked(r.edited_packed), r.near_edited, r.near_next) for r in got]
    assert rows(found) == rows(edge.plain_edited(plain))


def test_next_rows_of_repeated_null_and_single_keys(spark, docs):
    assert winnowing.edited_likeness(spark.createDataFrame([], docs.schema)).collect() == []
    one = winnowing.edited_likeness(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert (one.edited, one.near_next) == ("abcabc", 1.0)
    # Every row is the next one of exactly one other.
    held = spark.createDataFrame(docs.collect() * 3, docs.schema).cache()
    followed = winnowing.with_next(held).select(F.col("_next._text").alias("t"), F.coalesce("text", F.lit("")).alias("own"))
    assert edge.as_rows(followed, "t") == edge.as_rows(held.select(F.coalesce("text", F.lit("")).alias("t")), "t")


def test_printed_fingerprints(spark):
    whole = "one text, one print \u00e9 " * 3
    row = spark.createDataFrame([(whole,), (whole,), ("",), (None,)], "t string").select(winnowing.as_string(winnowing.winnow(text.split_words(F.col("t")))).alias("p")).collect()
    assert [r.p for r in row] == [",".join(f"{h:08x}:{p}" for h, p in edge.plain_winnow(whole))] * 2 + ["", ""]
