"""Substring dedup on difference-cover anchors.

A window is ``WINDOW`` consecutive words; each word covered by a window that starts anywhere else too goes.
Hashing and shuffling all windows would move many times the corpus. Instead:

1. anchors: only at positions whose remainder by ``PERIOD`` is in a difference cover, the next ``ANCHOR`` words
   are hashed. For any two positions i and j there is a shift below the period that moves both into the
   cover, so two equal windows always share an anchor, aligned in both. Anchors found once are done with;
2. extension: windows around an anchor found again are hashed as a whole (128 bits) and looked up;
3. windows found again give the words to remove.

Texts are handled in blocks. A block sends each distinct anchor or window once, with a mark if it holds it
several times, so a passage that a third of the corpus shares is one entry a block and not a hot key. The
answer is one bit an entry. Texts travel once; those of documents with candidate windows once more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blocks import Entries, Rows, by_block, by_bucket, numbered, send_texts, to_blocks, to_buckets

#: Words of a window.
WINDOW = 35
#: A difference cover: every remainder by the period is a difference of two of its members (fixed values).
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Words of an anchor: with any shift below the period it lies inside the window.
ANCHOR = WINDOW - PERIOD + 1
#: Buckets of hashes for each shuffle partition; a task holds one at a time.
BUCKETS_A_PARTITION = 4

_U = np.uint64
_FACTORS = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def grams(words: np.ndarray, n: int, factor: int = 0) -> np.ndarray:
    """A hash of every run of ``n`` of the hashed words, by doubling: runs of 1, 2, 4, ... words are joined."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, _U)
    by, run, length, done, out = _FACTORS[factor], words, 1, 0, np.zeros(size, _U)
    while True:
        if n & length:
            out = _mixed(out * by + run[done : done + size])
            done += length
        if done == n:
            return out
        run = _mixed(run[:-length] * by + run[length:])
        length *= 2


class _Block:
    """The hashed words of some texts, one after the other."""

    def __init__(self, texts: list[str]) -> None:
        digest = xxhash.xxh3_64_intdigest
        each = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.ends = np.cumsum(self.sizes)
        total = int(self.sizes.sum())
        self.words = np.fromiter((digest(w) for words in each for w in words), _U, total)
        self.each = each
        self.doc = np.repeat(np.arange(len(each)), self.sizes)
        self.place = np.arange(total) - np.repeat(self.ends - self.sizes, self.sizes)

    def starts(self, n: int) -> np.ndarray:
        """Positions from which ``n`` words lie in one text of at least a window."""
        at = np.arange(len(self.words))
        return at[(at + n <= self.ends[self.doc]) & (self.sizes[self.doc] >= WINDOW)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts(ANCHOR)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, grams(self.words, ANCHOR)[at]

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors."""
        step = np.zeros(len(self.words) + 1, np.int64)
        first = self.ends[self.doc[anchors]] - self.sizes[self.doc[anchors]]
        np.add.at(step, np.maximum(anchors - (WINDOW - ANCHOR), first), 1)
        np.add.at(step, anchors + 1, -1)
        inside = np.cumsum(step[:-1]) > 0
        at = self.starts(WINDOW)
        return at[inside[at]]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return grams(self.words, WINDOW)[at], grams(self.words, WINDOW, 1)[at]


def _packed(entries: Entries, two: bool) -> Iterator[tuple[int, bytes]]:
    for bucket, part in entries.by_bucket():
        data = [np.array([part.stop - part.start], np.int64).tobytes(), entries.first[part].tobytes()]
        data += [entries.second[part].tobytes()] if two else []
        yield bucket, b"".join([*data, np.packbits(entries.several[part]).tobytes()])


def _answered(entries: Entries, answers: dict[int, bytes]) -> np.ndarray:
    """For each hash that went in: is it found again?"""
    again = np.zeros(len(entries.first), bool)
    for bucket, part in entries.by_bucket():
        again[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=part.stop - part.start)
    return again[entries.entry]


def _send_anchors(buckets: int, rows: Rows):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in numbered(batches):
            entries = Entries(buckets, _Block(texts).anchors()[1])
            yield from rows.batches([{"block": block, "bucket": b, "packed": p} for b, p in _packed(entries, False)])

    return send


def _answer(two: bool, rows: Rows):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which entries of a bucket do several blocks hold, or one several times?"""
        for part in by_bucket(batches):
            if isinstance(part, pa.RecordBatch):
                yield part
                continue
            bucket, held = part
            firsts, seconds, several, sizes = [], [], [], []
            for _, packed in held:
                n = int(np.frombuffer(packed, np.int64, 1)[0])
                firsts.append(np.frombuffer(packed, _U, n, 8))
                seconds.append(np.frombuffer(packed, _U, n, 8 + 8 * n) if two else np.zeros(n, _U))
                several.append(np.unpackbits(np.frombuffer(packed, np.uint8, offset=8 + 8 * n * (1 + two)), count=n))
                sizes.append(n)
            entries = Entries(1, np.concatenate(firsts), np.concatenate(seconds))
            inside = np.bincount(entries.entry, np.concatenate(several), len(entries.first)) > 0
            again = (entries.several | inside)[entries.entry]
            bits = np.split(again, np.cumsum(sizes)[:-1])
            yield from rows.batches(
                [{"block": block, "bucket": bucket, "packed": np.packbits(b).tobytes()} for (block, _), b in zip(held, bits, strict=True)]
            )

    return answer


def _done(doc: dict, words: list[bytes], gone: np.ndarray | None) -> dict:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    removed = 0 if gone is None else int(gone.sum())
    digest = hashlib.sha256(b" ".join(kept)).hexdigest()
    return doc | {"text": None, "packed": None, "n_words": len(words), "n_removed": removed, "kept_sha256": digest}


def _send_windows(buckets: int, rows: Rows):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around anchors found again; documents without any are done."""
        for block, docs, answers in by_block(batches):
            held = _Block([d["text"] for d in docs])
            at, hashes = held.anchors()
            starts = held.around(at[_answered(Entries(buckets, hashes), answers)])
            entries = Entries(buckets, *held.windows(starts))
            yield from rows.batches([{"block": block, "bucket": b, "packed": p} for b, p in _packed(entries, True)])
            of_doc = np.split(held.place[starts], np.searchsorted(held.doc[starts], np.arange(1, len(docs))))
            out = []
            for doc, words, places in zip(docs, held.each, of_doc, strict=True):
                steps = np.diff(places, prepend=0).astype(np.int32).tobytes()
                out.append(doc | {"packed": zlib.compress(steps, 1)} if len(places) else _done(doc, words, None))
            yield from rows.batches(out)

    return send


def _remove(buckets: int, rows: Rows):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, answers in by_block(batches):
            out = [d for d in docs if d["kept_sha256"] is not None]
            docs = [d for d in docs if d["kept_sha256"] is None]
            if docs:
                held = _Block([d["text"] for d in docs])
                first = held.ends - held.sizes
                places = [np.cumsum(np.frombuffer(zlib.decompress(d["packed"]), np.int32)) for d in docs]
                at = np.concatenate([s + p for s, p in zip(first, places, strict=True)])
                at = at[_answered(Entries(buckets, *held.windows(at)), answers)]
                step = np.zeros(len(held.words) + 1, np.int64)
                step[at] += 1
                step[at + WINDOW] -= 1
                gone = np.split(np.cumsum(step[:-1]) > 0, held.ends[:-1])
                out += [_done(d, w, g) for d, w, g in zip(docs, held.each, gone, strict=True)]
            yield from rows.batches(out)

    return remove


def remove_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every row: words left without repeated windows of 35 words.

    Words are runs without white space, unchanged. Windows are judged on the input: one that starts a second time, in
    the same or another row, is removed wherever it stands. ``kept_sha256`` is the digest of the other words,
    joined by one space. Null and blank texts have no words; keys may be null or repeat; texts of fewer words
    than a window stay whole; an empty table gives an empty result; other columns are not looked at.
    ``docs`` is read twice and must give the same rows in the same partitions, as a stored table does.
    """
    rows = Rows(docs.schema[key].dataType, n_words="long", n_removed="long", kept_sha256="string")
    buckets = BUCKETS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(key).alias("id"), text)
    again = to_buckets(read.mapInArrow(_send_anchors(buckets, rows), rows.sql)).mapInArrow(_answer(False, rows), rows.sql)
    texts = read.mapInArrow(send_texts(rows), rows.sql)
    windows = to_blocks(texts.unionAll(again)).mapInArrow(_send_windows(buckets, rows), rows.sql)
    found = to_buckets(windows).mapInArrow(_answer(True, rows), rows.sql)
    left = to_blocks(found).mapInArrow(_remove(buckets, rows), rows.sql)
    return left.select(F.col("id").alias(key), "n_words", "n_removed", "kept_sha256")
