"""Small tables with everything that may go wrong, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text) -> list[str]:
    return WORD.findall(text) if isinstance(text, str) else []


def edge_documents(spark):
    """Null, empty, blank, very long, repeated and odd texts; null and repeated ids; columns with clashing names."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(60)
    base = prose(120)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        None, "", " \t\n", "one", "A b C", base, base, base, " ".join(near), base.upper(), shared,
        prose(40) + "\n" + shared + " " + prose(30), shared + " " + prose(200), prose(20) + " " + shared,
        prose(6000) + " " + shared, "x " * 400, "same line\n" * 30, prose(35), prose(34),
        "Ünï çödé ÀÉ " + prose(60), "emoji 😀 \U0001f600 " + prose(50), "nul \x00 char " + prose(50),
        "non breaking\xa0space and em\x1cfs " + prose(50), "<|endoftext|> it's we'll  two   three\n\n x<|endoftext|>",
        'password = "hunter2hunter" and AKIA' + "Z" * 16 + " with " + "ab12" * 8 + " token: abc",
        "login: alice99 then Zx9" + "aB3" * 6 + " at https://example.com/x\n\nfar away https://example.org/y",
        "# * $ % & | < > " * 20, prose(80),
    ]
    rows = [(i * 3 if i != 4 else None, t, "de", f"s{min(i % 5, 2)}", len(t or ""), i, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, 1, None, None), (15, prose(70), None, "s1", None, 1, "", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, block int, id string, n_words int"
    return spark.createDataFrame(rows, schema).repartition(3)


def plain_fingerprint(text) -> int:
    w = words(lower(text)) if isinstance(text, str) else []
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], ids: list, bits: int = 4) -> list:
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    smallest = defaultdict(list)
    for p, key in zip(prints, ids, strict=True):
        if key is not None:
            smallest[find(p)].append(key)
    return [min(smallest[find(p)], default=None) for p in prints]


def plain_counts(text) -> tuple:
    text = text if isinstance(text, str) else ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[t] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_removed(texts: list) -> list[tuple]:
    every = [words(t) for t in texts]
    found = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    out = []
    for w in every:
        gone = {p for i in range(len(w) - 34) if found[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def plain_hits(texts: list, items: list[tuple], size: int = 10) -> list[tuple]:
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for key, text in items:
        w = cut.findall(lower(text)) if text else []
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i : i + size])].add(str(key))
    out = []
    for text in texts:
        w = cut.findall(lower(text)) if isinstance(text, str) else []
        hit, held = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    held |= found
        out.append((len(w), len(hit), sorted(held)))
    return out


def as_rows(df, *columns: str) -> list[tuple]:
    """All rows in an order of their own."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def pandas_table(sf_dir: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def plain_collocations(rows: list[tuple], max_words: int = 5, min_count: int = 100, top: int = 2000, percent: int = 100) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, phrases counted one by one."""
    counts, totals, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, max_words + 1) if i + k <= len(w))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        most = Counter()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        most[p[i:j]] = max(most[p[i:j]], a)
        n, scored = totals[lang], []
        for p, a in candidates.items():
            if most[p] and 100 * most[p] >= percent * a:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return out


def plain_resampled(rows: list[tuple], target: list, percent: int = 10, max_run: int = 1, buckets: int = 10_000) -> list[tuple]:
    """(id, n_features, weight, score) of (id, text) rows, and how many are drawn: features hashed one by one."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = cut.findall(lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]

    every = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in every for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    out = []
    for (key, _), (_, f) in zip(rows, every, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = [i for i, (n, _) in enumerate(every) if n >= 20]
    order = sorted(may, key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: r for r, i in enumerate(order[: len(may) * percent // 100], 1)}
    return [(*row, rank.get(i)) for i, row in enumerate(out)]


def plain_winnow(text, gram: int = 3, window: int = 4) -> list[tuple[int, int]]:
    """(hash, position): the rightmost smallest hash of every window."""
    w = words(text)
    if not w:
        return []
    hashed = [zlib.crc32(" ".join(w[i : i + gram]).encode()) for i in range(max(1, len(w) - gram + 1))]
    chosen = {min((h, -i) for i, h in enumerate(hashed[s : s + window], s)) for s in range(max(1, len(hashed) - window + 1))}
    return sorted(((h, -i) for h, i in chosen), key=lambda x: x[1])


def plain_edited(rows: list[tuple], gram: int = 3, window: int = 4) -> list[tuple]:
    """(id, n_chars, edited text, fingerprint, its, near_edited, near_next) of (id, text) rows in their order."""
    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    out = []
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, third = plain_winnow(text, gram, window), plain_winnow(edited, gram, window), plain_winnow(following, gram, window)
        out.append((key, len(text), edited, own, other, near(own, other), near(own, third)))
    return out
