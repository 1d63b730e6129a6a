"""Operators on documents against plain versions, on a table of edge cases and on the smallest test tables."""

import hashlib
import re

import numpy as np
import pytest

from tablewise.llm import blocks, components, decontaminate, quality, queries, secret_scan, simhash, substrings, token_count

from . import edge

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return edge.edge_documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def rows(values):
    return sorted(values, key=repr)


# 1: SimHash


def test_components_equal_brute_force(docs, plain):
    prints = [edge.plain_fingerprint(t) for _, t in plain]
    ids = [k for k, _ in plain]
    want = [(k, f"{p:016x}", c) for k, p, c in zip(ids, prints, edge.plain_components(prints, ids), strict=True)]
    got = edge.as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == rows(want)


def test_simhash_query_equals_brute_force(spark, sf_dir):
    table = edge.pandas_table(sf_dir, "documents")
    prints = [edge.plain_fingerprint(t) for t in table.text]
    ids = table.doc_id.tolist()
    want = [(k, f"{p:016x}", c) for k, p, c in zip(ids, prints, edge.plain_components(prints, ids), strict=True)]
    assert edge.as_rows(queries.QUERIES["op1_simhash"](spark, sf_dir), "doc_id", "fingerprint", "component_id") == rows(want)


def test_every_value_has_one_home_anchor_and_all_near_ones():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    row, anchor, home = simhash.anchors(prints)
    for i in range(300):
        for block in range(3):
            mine = (row == i) & (anchor >> 24 == block)
            assert home[mine].sum() == 1
    # prints that differ in one bit of a block meet at the home of either one
    for bit in range(46):
        other_row, other_anchor, _ = simhash.anchors(prints ^ np.uint64(1 << bit))
        for i in range(0, 300, 7):
            own = set(anchor[(row == i) & home & (anchor >> 24 == bit // 23)])
            assert own <= set(other_anchor[other_row == i])


@pytest.mark.parametrize("limit", [50_000, 20])
def test_split_anchors_lose_no_link(spark, monkeypatch, limit):
    """A dense cluster of prints, most of them at the same anchors, also where these are cut into parts."""
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", limit)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            prints.add(int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {r.node: r.root for r in components.smallest_reachable(simhash.near_links(df)).collect()}
    unsigned = [p % (1 << 64) for p in signed]
    want = edge.plain_components(unsigned, signed)
    assert [found.get(p, p) for p in signed] == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 800)], "a long, b long")
    got = {r.node: r.root for r in components.smallest_reachable(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 800: 800, 900: 800}


# 2: token counts


def test_token_counts_equal_the_library(docs, plain):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in plain]
    want = [(k, len((t or "").encode()), c, c > 1024) for (k, t), c in zip(plain, n, strict=True)]
    got = edge.as_rows(token_count.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == rows(want)


def test_token_count_query_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    table = edge.pandas_table(sf_dir, "documents")
    want = [(k, len(tokenizer.encode(t, add_special_tokens=False).ids)) for k, t in zip(table.doc_id, table.text, strict=True)]
    assert edge.as_rows(queries.QUERIES["op2_token_counts"](spark, sf_dir), "doc_id", "n_tokens") == rows(want)


def test_small_blocks_give_the_same_counts(docs, monkeypatch):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    want = edge.as_rows(token_count.token_counts(docs, path), "doc_id", "n_tokens")
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 3)
    assert edge.as_rows(token_count.token_counts(docs, path), "doc_id", "n_tokens") == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_count.load_tokenizer(queries.tokenizer_file("word_bpe_49k.json"))


# 3: secrets


def base_spans(text):
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def check_secrets(result, texts):
    got = {}
    for r in result.collect():
        got.setdefault(r.doc_id, []).append(r)
    for key, text in texts:
        base = base_spans(text or "")
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        fitting = [r for r in got[key] if r.base_sha256 == digest]
        assert fitting
        r = fitting[0]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if s.split(":")[0] in ("assign", "access", "hex")] == base
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_plain_findings(docs, plain):
    result = secret_scan.secret_scan(docs)
    assert result.count() == len(plain)
    check_secrets(result, plain)


def test_secret_query(spark, sf_dir):
    table = edge.pandas_table(sf_dir, "documents")
    check_secrets(queries.QUERIES["op3_secret_scan"](spark, sf_dir), list(zip(table.doc_id, table.text, strict=True)))


def test_weak_parts_need_each_other(spark):
    random_looking = "Zx9aB3dE5fG7hJ1kL"
    texts = {
        1: f"login: alice99 with {random_looking}",
        2: "login: alice99 alone",
        3: f"{random_looking} alone",
        4: f"login: alice99\n\n{random_looking} in another paragraph",
        5: f"login: alice99 {'x ' * 200}{random_looking} too far",
        6: f"https://example.com/a and {random_looking}",
        7: "login: alice99 at https://example.com/a",
        8: "password=hunter22 at https://example.com/a",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secret_scan.secret_scan(docs).collect()}
    assert got == {
        1: ["identifier", "secret"], 2: [], 3: [], 4: [], 5: [], 6: ["endpoint", "secret"], 7: [], 8: ["assign", "endpoint"],
    }


def test_credentials_inside_a_url(spark):
    """Connection strings and signed URLs: the URL swallows neither the identifier nor the secret inside it."""
    url = "postgres://bob:Xy7kQ9pLm2Rt5Vw8@db.example:5432/app"
    texts = {
        1: url,
        2: "see https://files.example.com/a/b.bin?user=alice99&sig=Zx9aB3dE5fG7hJ1kL/x here",
        3: "https://hooks.example.com/services/Zx9aB3dE5fG7hJ1kL",
        4: "https://Example.com/Some/Path/2020/Article alone",  # no segment looks random
        5: "server=Zx9aB3dE5fG7hJ1kL",  # one string does not complete itself
        6: "login: Zx9aB3dE5fG7hJ1kL",
        7: "https://example.com/x?token=abc123def",
        8: f"two: {url} {url}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(docs).collect()}
    assert got[1] == "endpoint:0:51,secret:15:31"
    kinds = {k: [s.split(":")[0] for s in v.split(",") if s] for k, v in got.items()}
    assert kinds[2] == ["endpoint", "identifier", "secret"] and kinds[3] == ["endpoint", "secret"]
    assert kinds[4] == kinds[5] == kinds[6] == []
    assert kinds[7] == ["endpoint", "assign"] and kinds[8] == ["endpoint", "secret"] * 2


# 5: quality


def plain_llr(texts, trusted):
    from collections import Counter

    import xxhash

    def chained(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS

    def grams(text):
        w = edge.words(text)
        return [chained(x) for x in w] + [chained(a, b) for a, b in zip(w, w[1:], strict=False)]

    raw, good = Counter(), Counter()
    bags = [grams(t) for t in texts]
    for bag, is_good in zip(bags, trusted, strict=True):
        raw.update(bag)
        if is_good:
            good.update(bag)
    n, g, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    out = []
    for bag in bags:
        ratios = [np.log((good[x] + 1) / (g + b)) - np.log((raw[x] + 1) / (n + b)) for x in bag] if g else [0]
        out.append(float(np.mean(ratios)) if bag else 0.0)
    return out


def check_quality(result, table, trusted):
    llr = plain_llr([t for _, t in table], trusted)
    want = []
    for (key, text), score in zip(table, llr, strict=True):
        counts = edge.plain_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((key, *counts, failed, not failed and score >= quality.THRESHOLD))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert edge.as_rows(result, *names) == rows(want)
    got = sorted(r.llr for r in result.select("llr").collect())
    assert np.allclose(got, sorted(llr), atol=1e-5)


def test_quality_equals_brute_force(spark, docs, plain):
    labels = spark.createDataFrame([(k, 1, 0) for k in (15, 18, 36)] + [(3, 0, 1), (None, 1, 0), (15, 1, 0)], "doc_id long, quality int, toxic int")
    check_quality(quality.quality_rules(docs, labels), plain, [k in (15, 18, 36) for k, _ in plain])


def test_quality_query_equals_brute_force(spark, sf_dir):
    table = edge.pandas_table(sf_dir, "documents")
    labels = edge.pandas_table(sf_dir, "labels")
    good = set(labels[labels.quality == 1].doc_id)
    check_quality(
        queries.QUERIES["op5_quality_rules"](spark, sf_dir),
        list(zip(table.doc_id, table.text, strict=True)),
        [k in good for k in table.doc_id],
    )


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.llr for r in quality.quality_rules(docs, none).collect()} == {0.0}


# 7: decontamination


@pytest.fixture(scope="module")
def items(spark, plain):
    shared = next(t for _, t in plain if t and len(t.split()) == 60)
    texts = [shared, " ".join(shared.split()[5:25]), "one", "A b", None, "", "...", shared.upper(), "never seen words at all", "x x x x x x x x x x x"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_hits_equal_brute_force(docs, plain, items):
    want = [
        (k, n, hit, len(held), held, hit > 0)
        for (k, _), (n, hit, held) in zip(plain, edge.plain_hits([t for _, t in plain], [tuple(r) for r in items.collect()]), strict=True)
    ]
    got = edge.as_rows(decontaminate.decontaminate(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert got == rows(want)


def test_terms_in_several_passes(docs, items, monkeypatch):
    want = edge.as_rows(decontaminate.decontaminate(docs, items), "doc_id", "n_hit", "n_items")
    monkeypatch.setattr(decontaminate, "TERMS_A_PASS", 7)
    assert edge.as_rows(decontaminate.decontaminate(docs, items), "doc_id", "n_hit", "n_items") == want


def test_no_items(docs, items):
    got = decontaminate.decontaminate(docs, items.limit(0))
    assert {r.contaminated for r in got.collect()} == {False}


def plain_near(text, items):
    """Keys of items with a near window but no phrase, by trying every start."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(edge_lower))
    near, exact = set(), set()
    for key, item in items:
        terms = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(edge_lower))
        for at in range(max(len(terms) - 9, 1) if terms else 0):
            v = terms[at : at + 10]
            for s in range(-len(v) - 1, len(words) + 2):
                found = sum(any(0 <= s + j + k < len(words) and words[s + j + k] == t for k in (-1, 0, 1)) for j, t in enumerate(v))
                if found >= len(v) - len(v) // 10:
                    near.add(str(key))
                if s >= 0 and words[s : s + len(v)] == v:
                    exact.add(str(key))
    return sorted(near - exact)


edge_lower = {c: c + 32 for c in range(65, 91)}


def test_near_items_equal_brute_force(spark, docs, plain, items):
    base = [f"w{i}" for i in range(14)]
    item = " ".join(base[2:12])
    texts = [
        " ".join([*base[:6], "other", *base[7:]]),  # a word changed
        " ".join([*base[:6], *base[7:]]),  # left out
        " ".join(base[3:12]),  # the first one
        " ".join(base[2:11]),
        " ".join([*base[:6], "more", *base[6:]]),  # put in
        " ".join([*base[:5], base[6], base[5], *base[7:]]),  # swapped
        " ".join([*base[:5], "a", "b", *base[7:]]),  # two changed: not near
        " ".join(base),
        item.upper() + " " + " ".join([*base[2:7], "z", *base[8:12]]),
        "short one", "one short", "short x one", None, "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3
    few = [(1, item), (2, " ".join([*base[2:6], "unheard", *base[7:12]])), (3, "short one"), (4, None), (5, " ".join(["unheard", "of", *base[4:12]]))]
    for table, held in ((spark.createDataFrame(rows, "doc_id long, text string"), few), (docs, [tuple(r) for r in items.collect()])):
        got = decontaminate.decontaminate(table, spark.createDataFrame(held, "item_id long, text string"))
        want = sorted((-1 if r.doc_id is None else r.doc_id, plain_near(r.text, held)) for r in table.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.near_items)) for r in got.collect()) == want
    near = {r.doc_id: r.near_items for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string")).collect()}
    assert [i for i in range(9) if "1" in near[i]] == [0, 1, 2, 3, 4, 5]


# 10: substrings


def test_removed_words_equal_brute_force(docs, plain):
    want = [(k, *r) for (k, _), r in zip(plain, edge.plain_removed([t for _, t in plain]), strict=True)]
    got = edge.as_rows(substrings.remove_repeated(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == rows(want)


def test_blocks_do_not_matter(docs, plain, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 2)
    test_removed_words_equal_brute_force(docs, plain)


def test_cover_reaches_every_pair():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % 21 in substrings.COVER and (j + d) % 21 in substrings.COVER for d in range(21))


# empty tables


def test_empty_tables(spark, docs, items):
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    path = queries.tokenizer_file("byte_bpe_50k.json")
    for result in (
        simhash.near_duplicates(none), token_count.token_counts(none, path), secret_scan.secret_scan(none),
        quality.quality_rules(none, labels), decontaminate.decontaminate(none, items), substrings.remove_repeated(none),
    ):
        assert result.count() == 0


