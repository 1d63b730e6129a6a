"""Language-model scores from a bigram trie in Elias-Fano form.

1. Blocks of documents send their distinct words with training counts to hash buckets and get the counts of
   the whole corpus back; the few totals (tokens, distinct words, mass of each word class) go to the driver.
2. Blocks send their bigrams, with the documents that hold them, to the bucket of the bigram's context. A
   bucket merges the training counts of all blocks, smooths them, builds its trie and looks every bigram up.
   What comes back is one sum for each document.

So the model is never whole anywhere: its size grows with the corpus and with it the number of buckets. The
successors of a context seen more than ``HOT`` times are dealt to several places by their hashes, so that no bucket holds
all of a frequent word. That is placement only: a probability needs the counts of the n-gram and of its context,
which travels with it, and nothing that is summed over a context's successors.

Smoothing is interpolated with the unigram: p(w | v) = (1 - s) c(v w) / c(v) + s u(w), where u is the unigram
probability (counts plus a half, one unknown word) and the share s = MU / (sqrt(c(v)) + MU) falls with the context's
count alone. So one formula holds at every size. Logarithms are kept in units of 1/1024.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage_table
from .blocks import Entries, Rows, by_block, by_bucket, numbered, send_texts, to_blocks, to_buckets
from .elias_fano import Trie

#: Documents whose hashed id has this remainder are held out.
FOLDS, HELD_OUT = 5, 1
#: Tokens of a context from which its successors are dealt to several places, up to 2^8; scores don't depend on it.
HOT = 1_000_000
PART_BITS = 8
#: Weight of the unigram: about half of it at a context seen MU^2 times.
MU = 20.0
#: Units of a decimal logarithm.
UNIT = 1024
#: Buckets of words and contexts for each shuffle partition; a task holds one at a time.
BUCKETS_A_PARTITION = 4

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
# White space is in no word, so these are free.
_END, _START = (_U(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b" "))


def held_out(key) -> bool:
    """Whether a document is kept out of training: by the hash of its id; a missing id counts as empty text."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD_OUT


class _Tokens:
    """Codes of the words of some texts, each text followed by an end."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        digest = xxhash.xxh3_64_intdigest
        each = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
        self.sizes = np.fromiter((len(w) + 1 for w in each), np.int64, len(each))
        ends = np.cumsum(self.sizes) - 1
        self.codes = np.empty(int(self.sizes.sum()), _U)
        is_word = np.ones(len(self.codes), bool)
        is_word[ends] = False
        self.codes[ends] = _END
        self.codes[is_word] = np.fromiter((digest(w) for words in each for w in words), _U, int(is_word.sum()))
        self.before = np.concatenate(([_START], self.codes[:-1]))[: len(self.codes)]
        self.first = ends - self.sizes + 1
        self.before[self.first] = _START
        self.doc = np.repeat(np.arange(len(each)), self.sizes)
        self.training = ~np.fromiter(map(held_out, ids), bool, len(ids))


def _join(arrays: list[np.ndarray]) -> bytes:
    """Arrays, compressed together, after their sizes in bytes."""
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _split(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    whole, at, out = zlib.decompress(memoryview(data)[sizes.nbytes :]), 0, []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(whole, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _send_words(buckets: int, rows: Rows):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in numbered(batches):
            tokens = _Tokens(ids, texts)
            entries = Entries(buckets, tokens.codes)
            counts = np.bincount(entries.entry, tokens.training[tokens.doc], len(entries.first)).astype(np.int64)
            yield from rows.batches(
                [{"block": block, "bucket": b, "packed": _join([entries.first[p], counts[p]])} for b, p in entries.by_bucket()]
            )

    return send


def _count_words(rows: Rows):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Corpus counts for each block's words; for each task a row of totals: tokens and distinct words."""
        sums = np.zeros(2, np.int64)
        for bucket, held in by_bucket(batches):
            parts = [_split(packed, ["u8", "i8"]) for _, packed in held]
            codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
            sums += [total.sum(), (total > 0).sum()]
            answers = np.split(total[inverse], np.cumsum([len(p[0]) for p in parts])[:-1])
            yield from rows.batches(
                [{"block": block, "bucket": bucket, "packed": _join([a])} for (block, _), a in zip(held, answers, strict=True)]
            )
        if sums.any():
            yield from rows.batches([{"totals": sums.tolist()}])

    return count


class _Unigram:
    """Totals of the training tokens."""

    def __init__(self, tokens: int, words: int) -> None:
        self.tokens, self.words = tokens, words
        self.whole = self.tokens + 0.5 * (self.words + 1)

    def log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.whole)


def _units(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round(logs * UNIT), -32_000, 32_000).astype(np.int16)


def _context_keys(before: np.ndarray, part: np.ndarray) -> np.ndarray:
    h = (before ^ (part.astype(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
    return ((h ^ (h >> _U(29))) >> _U(2)).astype(np.int64)


_KINDS = ["i8", "i8", "i4", "u4", "i2", "i4", "i4", "i4", "i4"]


def _send_bigrams(buckets: int, rows: Rows, unigram: _Unigram):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs, answers in by_block(batches):
            tokens = _Tokens([d["id"] for d in docs], [d["text"] for d in docs])
            entries = Entries(buckets, tokens.codes)
            known = np.empty(len(entries.first), np.int64)
            for bucket, place in entries.by_bucket():
                known[place] = _split(answers[bucket], ["i8"])[0]
            counts = known[entries.entry]
            logs = unigram.log(counts)
            ended = counts[np.cumsum(tokens.sizes) - 1]  # training documents, which is also how often one starts
            seen = np.concatenate(([0], counts[:-1]))[: len(counts)]
            seen[tokens.first] = ended
            own = _units(logs).astype(np.int64)
            n = len(docs)
            alone = np.bincount(tokens.doc, np.where(seen == 0, own, 0), n).astype(np.int64)
            base = np.bincount(tokens.doc, logs, n)
            n_known = np.bincount(tokens.doc, counts > 0, n).astype(np.int64)
            out = [
                d | {"text": None, "n_tokens": int(tokens.sizes[i]), "n_known": int(n_known[i]), "base": float(base[i]), "units": int(alone[i])}
                for i, d in enumerate(docs)
            ]
            yield from rows.batches(out)
            # Bigrams with a known context, by bucket, context and word; then by document.
            some = np.flatnonzero(seen > 0)
            split = np.ceil(np.log2(np.maximum(seen[some] / HOT, 1))).clip(0, PART_BITS).astype(np.int64)
            part = (tokens.codes[some] >> _U(64 - PART_BITS)).astype(np.int64) >> (PART_BITS - split)
            key = _context_keys(tokens.before[some], part)
            word = (tokens.codes[some] >> _U(32)).astype(np.int64)
            order = np.lexsort((word, key))  # stable, so that documents stay in order
            key, word, doc, some = (x[order] for x in (key, word, tokens.doc[some], some))
            home = ((key >> 30) * buckets) >> 32  # ranges of the keys, which have 62 bits
            new_key = np.diff(key, prepend=-1) != 0
            new_gram = new_key | (np.diff(word, prepend=-1) != 0)
            new_place = new_gram | (np.diff(doc, prepend=-1) != 0)
            contexts, grams, places = (np.flatnonzero(x) for x in (new_key, new_gram, new_place))
            trained = np.add.reduceat(tokens.training[doc].astype(np.int64), grams) if len(grams) else np.empty(0, np.int64)
            lengths = [np.diff(np.append(x, len(key))) for x in (contexts, grams, places)]
            packs = []
            cuts = [*np.flatnonzero(np.diff(home, prepend=-1)).tolist(), len(home)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                c, g, p = (slice(*np.searchsorted(x, [start, end])) for x in (contexts, grams, places))
                at_c, at_g, at_p = contexts[c], grams[g], places[p]
                packed = _join(
                    [
                        key[at_c], seen[some[at_c]],
                        np.diff(np.append(np.searchsorted(at_g, at_c), len(at_g))).astype(np.int32),
                        word[at_g].astype(np.uint32), own[some[at_g]].astype(np.int16), trained[g].astype(np.int32),
                        np.diff(np.append(np.searchsorted(at_p, at_g), len(at_p))).astype(np.int32),
                        doc[at_p].astype(np.int32), lengths[2][p].astype(np.int32),
                    ]
                )
                packs.append({"block": block, "bucket": int(home[start]), "packed": packed})
            yield from rows.batches(packs, 50)

    return send


def _share(seen: np.ndarray) -> np.ndarray:
    """The unigram's share in a context."""
    return MU / (np.sqrt(seen) + MU)


def build_trie(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, own: np.ndarray, seen: np.ndarray) -> Trie:
    """The trie of n-grams sorted by (context, word), all with counts over 0.

    ``own`` holds the words' unigram logarithms in units, ``seen`` for each n-gram its context's count.
    """
    start = np.flatnonzero(np.diff(contexts, prepend=-1))
    if not len(start):
        return Trie(Trie.build(contexts, words, counts, counts))
    share = _share(seen)
    p = (1 - share) * counts / seen + share * 10.0 ** (own / UNIT)
    return Trie(Trie.build(contexts, words, _units(np.log10(p)), _units(np.log10(share[start]))))


def _score(rows: Rows):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            bucket, held = found
            blocks = [_split(packed, _KINDS) for _, packed in held]
            held, n_entries = [block for block, _ in held], [len(b[7]) for b in blocks]
            key, seen, n_grams, word, own, trained, n_places, doc, times = (np.concatenate(x) for x in zip(*blocks, strict=True))
            del blocks, found
            key, seen = (np.repeat(x, n_grams) for x in (key, seen))
            word, own = word.astype(np.int64), own.astype(np.int64)
            # The bigrams of all blocks together make the model.
            order = np.lexsort((word, key))
            first = np.flatnonzero((np.diff(key[order], prepend=-1) != 0) | (np.diff(word[order], prepend=-1) != 0))
            counts = np.add.reduceat(trained[order].astype(np.int64), first)
            at = order[first[counts > 0]]
            trie = build_trie(key[at], word[at], counts[counts > 0], own[at], seen[at])
            context, place = trie.look_up(key, word)
            value = own + _units(np.log10(_share(seen)))  # no successor of the context is placed here
            if trie.contexts.n:
                value = np.where(context >= 0, trie.backoffs[np.maximum(context, 0)] + own, value)
                value = np.where(place >= 0, trie.values[np.maximum(place, 0)], value)
            block = np.repeat(np.arange(len(held)), n_entries)
            docs, inverse = np.unique(block << 32 | doc, return_inverse=True)
            sums = np.bincount(inverse, times * np.repeat(value, n_places)).astype(np.int64)
            cuts = np.searchsorted(docs >> 32, np.arange(1, len(held)))
            parts = zip(np.split((docs & 0xFFFFFFFF).astype(np.int32), cuts), np.split(sums, cuts), strict=True)
            yield from rows.batches(
                [{"block": b, "bucket": bucket, "packed": _join([d, x])} for b, (d, x) in zip(held, parts, strict=True)]
            )

    return score


def _finish(rows: Rows):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, answers in by_block(batches):
            units = np.array([d["units"] for d in docs], np.int64)
            for packed in answers.values():
                some, sums = _split(packed, ["i4", "i8"])
                units[some] += sums
            yield from rows.batches([d | {"units": int(u), "held": held_out(d["id"])} for d, u in zip(docs, units, strict=True)])

    return finish


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows that are not held out and scores all of them. Tokens are the words in lower case
    (A-Z), then one end. ``base_score`` is the unigram's log10 probability, ``score`` that of the bigram model;
    ``n_known`` counts the tokens that training has. Null, empty and blank texts are an end alone; a row without key
    is trained on; repeated rows count each time; an empty table gives an empty result; other columns are not
    looked at. ``docs`` is read twice and must give the same rows in the same partitions, as a stored table does.
    """
    rows = Rows(
        docs.schema[key].dataType,
        n_tokens="long", n_known="long", held="boolean", base="double", units="long", totals="array<bigint>",
    )
    buckets = BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(key).alias("id"), text)
    words = to_buckets(read.mapInArrow(_send_words(buckets, rows), rows.sql)).mapInArrow(_count_words(rows), rows.sql)
    words = stage_table(words)
    sums = [F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in (0, 1)]
    unigram = _Unigram(*words.where(F.col("totals").isNotNull()).agg(*sums).first())
    texts = read.mapInArrow(send_texts(rows), rows.sql)
    blocks = to_blocks(texts.unionAll(words.where(F.col("totals").isNull())))
    bigrams = blocks.mapInArrow(_send_bigrams(buckets, rows, unigram), rows.sql)
    scored = to_buckets(bigrams).mapInArrow(_score(rows), rows.sql)
    done = to_blocks(scored).mapInArrow(_finish(rows), rows.sql)
    return done.select(
        F.col("id").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(unigram.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("units") / UNIT).alias("score"),
    )
