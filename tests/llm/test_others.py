"""Language model, pages, sharding, mixing and the pipeline against plain versions and invariants."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F

from tablewise.llm import blocks, decontaminate, elias_fano, mixing, ngram_lm, pages, quality, queries, shards

from . import edge


@pytest.fixture(scope="module")
def docs(spark):
    return edge.edge_documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


# 4: language model


@pytest.mark.parametrize(("n", "universe"), [(1, 1 << 32), (3, 1 << 62), (5, 10), (1000, 1 << 62), (5000, 6000), (0, 7), (70_000, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    head, lows, highs = elias_fano.EliasFano.parts(values, universe)
    held = elias_fano.EliasFano(int(head[0]), int(head[1]), lows, highs)
    assert (held[np.arange(n)] == values).all()
    wanted = np.concatenate([values, rng.integers(0, universe, 300), [0, universe - 1]])
    assert (held.successor(wanted) == np.searchsorted(values, wanted)).all()
    assert ((held.find(wanted) >= 0) == np.isin(wanted, values)).all()


def plain_scores(table):
    """The model of the module's docstring, word by word."""
    code = lambda w: xxhash.xxh3_64_intdigest(w if isinstance(w, bytes) else w.encode())
    tokens = [[code(w) for w in edge.words(edge.lower(t or ""))] + [code(b"\n")] for _, t in table]
    training = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1 for k, _ in table]
    unigram, pairs = Counter(), Counter()
    for t, train in zip(tokens, training, strict=True):
        if train:
            unigram.update(t)
            pairs.update(zip([code(b" "), *t], t, strict=False))
    n, v = sum(unigram.values()), len(unigram)
    own = lambda c: (unigram[c] + 0.5) / (n + 0.5 * (v + 1))
    seen = dict(unigram) | {code(b" "): unigram[code(b"\n")]}

    def probability(before, word):
        count = seen.get(before, 0)
        share = ngram_lm.MU / (math.sqrt(count) + ngram_lm.MU)
        return (1 - share) * pairs[before, word] / max(count, 1) + share * own(word)

    out = []
    for (key, _), t, train in zip(table, tokens, training, strict=True):
        base = sum(math.log10(own(x)) for x in t)
        score = sum(math.log10(probability(b, x)) for b, x in zip([code(b" "), *t], t, strict=False))
        out.append((key, not train, len(t), sum(unigram[x] > 0 for x in t), n, base, score))
    return out, probability, unigram, seen


def check_scores(result, want):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    got = sorted((tuple(r[c] for c in columns), r.base_score, r.score) for r in result.collect() if r.doc_id is not None)
    want = sorted((w[:5], w[5], w[6]) for w in want if w[0] is not None)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (head, base, score), (_, plain_base, plain_score) in zip(got, want, strict=True):
        assert abs(base - plain_base) < 1e-6 * head[2] + 1e-9
        assert abs(score - plain_score) < 2.5 / ngram_lm.UNIT * head[2]


@pytest.mark.parametrize("hot", [1_000_000, 3, 0.01])
def test_scores_equal_the_plain_model(docs, plain, monkeypatch, hot):
    monkeypatch.setattr(ngram_lm, "HOT", hot)
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 7)
    want, probability, unigram, seen = plain_scores(plain)
    check_scores(ngram_lm.score_documents(docs), want)
    for before in list(seen)[:20]:  # probabilities add up to one, with one unknown word
        total = sum(probability(before, w) for w in unigram)
        assert total < 1 + 1e-9


def test_scores_query_and_held_out_gain(spark, sf_dir):
    table = edge.pandas_table(sf_dir, "documents")
    want = plain_scores(list(zip(table.doc_id, table.text, strict=True)))[0]
    result = queries.QUERIES["op4_language_model"](spark, sf_dir)
    check_scores(result, want)
    held = [r for r in result.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_placement_leaves_scores_alone(docs, monkeypatch):
    """Contexts dealt to many places give the very same scores."""
    want = edge.as_rows(ngram_lm.score_documents(docs), "doc_id", "n_tokens", "score")
    monkeypatch.setattr(ngram_lm, "HOT", 2)
    assert edge.as_rows(ngram_lm.score_documents(docs), "doc_id", "n_tokens", "score") == want


def test_no_training_documents(spark):
    key = next(i for i in range(50) if ngram_lm.held_out(i))
    one = spark.createDataFrame([(key, "a b a")], "doc_id long, text string")
    r = ngram_lm.score_documents(one).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (4, 0, 0, True)
    assert ngram_lm.score_documents(one.limit(0)).count() == 0


# 6: pages

HOST = "https://user@Example.org:80/a/{}?x=//y"


def page(i, body, extra=""):
    menu = "<nav><ul>" + "".join(f"<li><a href=/{j}>menu {j}</a>" for j in range(4)) + "</ul></nav>"
    return (
        f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a = '<p>no</p>';</script></head><body>"
        f"<header>site name</header>{menu}{extra}{body}<footer>&copy; us</footer></body></html>"
    )


def test_parts_that_are_no_article(spark):
    body = (
        "<article><header><h1>A &amp; B</h1></header><p>one <b>bold\n  text</b>&nbsp;here<br>and more<p>two &#233;&lt;x&gt;"
        "<ul><li>first<li>second</ul><aside>side</aside><div class='ad box'>buy</div><form>name <input></form><!-- <p>gone</p> -->"
        "<blockquote>said<div>deep</div>after</blockquote><section id=comments><p>reader</p></section><p>end</article>"
    )
    rows = [(1, HOST.format(1), page(1, body, "<div id='cookie-notice'>we use cookies</div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = pages.main_texts(df).collect()[0]
    assert r.text.split("\n\n") == ["A & B", "one bold text here and more", "two é<x>", "first", "second", "said", "deep", "after", "end"]
    assert r.n_chars == len(r.text)


def test_template_text_goes(spark):
    """Without any telling markup: what all pages of a host share is its template, the rest fills the slots."""
    make = lambda i, text: f"<html><body><div class=x1><p>Our shop</p><p>Call us</p></div><div class=x2>{text}</div><div class=x3><p>Opening hours</p></div></body></html>"
    texts = {i: [f"story {i} begins", f"story {i} ends" if i % 3 else "The end."] for i in range(40)}
    rows = [(i, HOST.format(i), make(i, "".join(f"<p>{t}</p>" for t in ts))) for i, ts in texts.items()]
    rows += [(100, "http://small.example/1", make(0, "<p>only page</p>")), (101, None, None), (None, "", ""), (102, "x", "<p>broken <b"), (103, "x", "plain < text")]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, page int").repartition(4)
    got = defaultdict(set)
    for r in pages.main_texts(df).collect():
        got[r.page_id].add(r.text)
    for i, ts in texts.items():
        assert got[i] == {"\n\n".join(ts)}
    assert got[100] == {"Our shop\n\nCall us\n\nonly page\n\nOpening hours"}
    assert got[101] == got[None] == {""}
    assert got[102] == {"broken <b"}
    assert got[103] == {"plain < text"}
    assert pages.main_texts(df.limit(0)).count() == 0


def test_pages_query(spark, sf_dir):
    import html

    table = edge.pandas_table(sf_dir, "pages")

    def want(text):
        article = re.search("<article>(.*?)</article>", text, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        return "\n\n".join(p for p in parts if p)

    got = {r.page_id: r.text for r in queries.QUERIES["op6_main_texts"](spark, sf_dir).collect()}
    assert got == {k: want(t) for k, t in zip(table.page_id, table.html, strict=True)}


# 8: shards


def check_shards(result, table, n_shards=16):
    found = result.collect()
    want = sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in table if k is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found if r.doc_id is not None) == want
    by_shard = defaultdict(list)
    for r in found:
        assert r.law == "rows" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(n_shards)]
    assert sum(sizes) == len(table) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    return found


def test_shards_of_edge_cases(docs, plain):
    check_shards(shards.shard_documents(docs), plain)
    assert shards.shard_documents(docs.limit(0)).count() == 0


def test_shards_query_cuts_few_links(spark, sf_dir):
    table = edge.pandas_table(sf_dir, "documents")
    found = check_shards(queries.QUERIES["op8_shards"](spark, sf_dir), list(zip(table.doc_id, table.text, strict=True)))
    text = dict(zip(table.doc_id, table.text, strict=True))
    groups = defaultdict(Counter)
    for r in found:
        groups[text[r.doc_id]][r.shard] += 1
    assert all(len(g) == 1 for g in groups.values())


def test_groups_beyond_a_shard(spark, monkeypatch):
    """A group of a third of all rows must be split, but into few shards; ranks are counted in parts."""
    monkeypatch.setattr(shards, "WINDOW_ROWS", 50)
    table = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    found = check_shards(shards.shard_documents(df), table)
    text = dict(table)
    hot = Counter(r.shard for r in found if text[r.doc_id] == "hot")
    assert len(hot) <= 10
    pairs = defaultdict(set)
    for r in found:
        if text[r.doc_id].startswith("pair"):
            pairs[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 0.1 * len(pairs)


# 9: mixing


def plain_schedule(share, period):
    had, out = [0] * len(share), []
    for t in range(period):
        ready = [(-(-(had[i] + 1) * period // s), i) for i, s in enumerate(share) if had[i] < s and had[i] * period // s <= t]
        due, i = min(ready)
        assert due > t
        out.append((i, had[i], t))
        had[i] += 1
        assert all(abs(h - s * (t + 1) / period) < 1 for h, s in zip(had, share, strict=True))
    return out


@pytest.mark.parametrize("share", [[1], [3, 7], [1, 1, 1, 97], [5, 11, 17, 23, 44], [33, 33, 34]])
def test_schedule(spark, share):
    period = sum(share)
    df = spark.createDataFrame([(i, s, period) for i, s in enumerate(share)], "number int, share long, period long")
    got = sorted((r.number, r.turn, r.slot) for r in mixing.period_schedule(df).collect())
    assert got == sorted(plain_schedule(share, period))
    assert all(r.release <= r.slot < r.deadline for r in mixing.period_schedule(df).collect())


def check_mixture(found, n_rows, block_rows):
    assert sorted(r.position for r in found) == list(range(n_rows))
    inside = defaultdict(list)
    for r in found:
        assert r.release <= r.slot < r.deadline
        inside[r.source, r.block].append(r)
    for rows in inside.values():
        assert len(rows) <= block_rows and len({r.slot for r in rows}) == 1
    order = sorted(found, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in order)


def test_mixture_keeps_its_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 70)
    rows = [(i, "a" if i < 900 else "b" if i < 1200 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    weights = spark.createDataFrame([("a", 0.2), ("b", 0.5), (None, 0.3)], "source string, weight double")
    found = mixing.mix_sources(df, weights, block_rows=4).collect()
    check_mixture(found, 1500, 4)
    order = sorted(found, key=lambda r: r.position)
    had = Counter()
    for i, r in enumerate(order[:560], 1):  # until the first source runs out
        had[r.source] += 1
        for name, w in (("a", 0.2), ("b", 0.5), (None, 0.3)):
            assert abs(had[name] - w * i) <= 2 * 4


def test_mixture_of_edge_cases(docs, plain):
    found = mixing.mix_sources(docs, period=7).collect()
    check_mixture(found, len(plain), mixing.BLOCK_ROWS)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# pipeline


def plain_pipeline(sf_dir):
    """Which documents the filtering stages keep."""
    from .test_documents import plain_llr

    table = edge.pandas_table(sf_dir, "documents")
    labels = edge.pandas_table(sf_dir, "labels")
    good = set(labels[labels.quality == 1].doc_id)
    rows = list(zip(table.doc_id, table.text, strict=True))
    kept = []
    for (key, text), llr in zip(rows, plain_llr([t for _, t in rows], [k in good for k, _ in rows]), strict=True):
        n, *_, repeated = edge.plain_counts(text)
        if n >= 50 and 100 * repeated <= 50 * n and llr >= quality.THRESHOLD:
            kept.append((key, text))
    prints = [edge.plain_fingerprint(t) for _, t in kept]
    first = edge.plain_components(prints, [k for k, _ in kept])
    kept = [(k, t) for (k, t), c in zip(kept, first, strict=True) if k == c]
    items = edge.pandas_table(sf_dir, "benchmark")
    hits = edge.plain_hits([t for _, t in kept], list(zip(items.item_id, items.text, strict=True)))
    return [(k, t) for (k, t), (_, hit, _) in zip(kept, hits, strict=True) if not hit]


def test_pipeline(spark, sf_dir):
    want = plain_pipeline(sf_dir)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(want)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(found[0].asDict())
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_mixing_stage_orders_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    order = [(r.doc_id, r.source) for r in mixed.select("doc_id", "source").collect()]
    assert sorted(k for k, _ in order) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    # All sources have the same weight here, so every run of the table has the same share of each, up to two blocks.
    for start in range(0, len(order) - 40, 10):
        assert max(Counter(s for _, s in order[start : start + 40]).values()) <= 2 * mixing.BLOCK_ROWS


def test_stages_that_drop_nothing_keep_everything(spark, sf_dir):
    assert decontaminate.WINDOW == 10
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_edge_cases(spark, sf_dir, docs, plain):
    """Null and repeated ids, null texts, clashing columns: rows are told apart, and columns stay as they are."""
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)
    llr = [r.kept for r in quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()]
    assert stages["quality rules"](spark, docs, sf_dir).count() == sum(llr)
    single = stages["near duplicates"](spark, docs, sf_dir)
    assert single.columns == docs.columns
    prints = [edge.plain_fingerprint(t) for _, t in plain]
    marks = edge.plain_components(prints, list(range(len(plain))))
    assert single.count() == len(set(marks))
    for name in ("decontamination", "mixing"):
        assert key(stages[name](spark, docs, sf_dir).collect()) == key(docs.collect())
    placed = stages["sharding"](spark, docs, sf_dir).collect()
    assert key(placed) == key(docs.collect())
    assert len({(r.shard, r.slot) for r in placed}) == len(plain)


def test_stages_keep_columns_with_their_own_names(spark, sf_dir, tmp_path):
    """Columns named like those that the stages work with, in any case, stay with their rows."""
    names = "_row _key __ROW component_id kept position number part doc".split()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    table.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "mix_position": F.lit("z")}).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        assert set(found.columns) == set(docs.columns)
        held = found.collect()
        assert held and all(r[c] == f"{c}{r.doc_id}" for r in held for c in names)
        if name == "mixing":
            assert sorted(r.mix_position for r in held) == list(range(len(held)))
        if name == "sharding":
            assert {r.shard for r in held} <= set(range(16))


def test_stored_shards_follow_the_schedule(spark, sf_dir, tmp_path, monkeypatch):
    """Sources of 600 and 200 rows under equal weights: in each stored shard both come alike until the small one has run out."""
    monkeypatch.setattr(mixing, "source_weights", lambda rows, source: rows.select(source).distinct().selectExpr(source, "1D AS weight"))
    rows = [(i, f"text number {i}", "a" if i % 4 else "b") for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("mixing", "sharding"):
        stages[name](spark, docs, sf_dir).repartition(5).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    found = docs.collect()
    assert sorted(r.doc_id for r in found) == list(range(800))
    for shard in range(shards.SHARDS):
        inside = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        assert [r.mix_position for r in inside] == sorted(r.mix_position for r in inside)
    early = Counter(r.source for r in found if r.slot < 20)
    late = Counter(r.source for r in found if r.slot >= 30)
    assert abs(early["a"] - early["b"]) <= 60 and late["a"] > 3 * late["b"]


def test_the_pipeline_stores_its_mixture(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.mix_position for r in found) == list(range(len(found)))
    for shard in {r.shard for r in found}:
        inside = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        assert [r.mix_position for r in inside] == sorted(r.mix_position for r in inside)
