"""Importance resampling of documents towards a target text, on hashed features.

A feature is a run of words; its bucket is the CRC-32 of its bytes modulo ``buckets``. A document's weight is the sum of its
features' log ratios between the target's and the corpus's bucket totals; Gumbel noise from the document's id
turns the highest scores into a draw without replacement in proportion to the weights.

CRCs are taken by a head and a tail. The head is a bounded table that every task holds: the CRC states of the words
that are frequent in some block of documents, and those of their frequent pairs. A feature in the head costs a look-up;
one that is not goes on from its first words' state, or from nothing, byte by byte. Both give the same number, so
bucket totals are exact whatever is in the head. Features are counted once and stored by document; nothing but
``buckets`` totals leaves a task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.staging import stage_table
from .blocks import numbered

BUCKETS = 10_000
#: A word or pair with 1/HEAD_SHARE of all words is in the head, which has at most so many words, and pairs. It has that share in some block.
HEAD_SHARE = 20_000
#: Longer words don't enter the head, which bounds its bytes.
HEAD_BYTES = 64
MIN_WORDS = 20
SEED = 2024

_END = b"\xff"  # in no UTF-8 text
_OTHERS = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z become lower case; all other ASCII characters but digits and a-z part words.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _OTHERS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_OTHERS))


def _tokens(texts: list[str]) -> list[bytes]:
    """The words of all texts, with an end after each text."""
    between = b" " + _END + b" "
    return [*between.join(t.encode().translate(_TABLE) for t in texts).split(), _END]


def _find_head(pairs: bool):
    schema = pa.schema([("first", pa.binary()), ("second", pa.binary()), ("n", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in numbered(batches):
            encoded = pa.array([_END, *_tokens(texts)], pa.binary()).dictionary_encode()
            codes, words = encoded.indices.to_numpy(), encoded.dictionary
            counts = np.bincount(codes)
            counts[0] = 0
            least = counts.sum() / HEAD_SHARE
            short = pc.binary_length(words).to_numpy() <= HEAD_BYTES
            often = np.flatnonzero((counts > 0) & (counts >= least) & short)
            yield pa.RecordBatch.from_pylist([{"n": int(counts.sum())}], schema)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(often)), pa.nulls(len(often), pa.binary()), pa.array(counts[often], pa.int64())], schema=schema)
            if pairs:
                place = np.full(len(words), -1)
                place[often] = np.arange(len(often))
                first, second = place[codes[:-1]], place[codes[1:]]
                both = (first >= 0) & (second >= 0)
                found, n = np.unique(first[both] * len(often) + second[both], return_counts=True)
                found, n = found[n >= least], n[n >= least]
                names = [words.take(pa.array(often[x])) for x in np.divmod(found, len(often) or 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n, pa.int64())], schema=schema)

    return find


class Head:
    """CRC states of frequent words, and of frequent pairs by the two words' places."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> None:
        self.words = pa.array(words, pa.binary())
        self.states = np.array([zlib.crc32(w) for w in words], np.uint32)
        place = {w: i for i, w in enumerate(words)}
        known = sorted((place[a] * len(words) + place[b], a, b) for a, b in pairs if a in place and b in place)
        self.pairs = np.array([k for k, _, _ in known], np.int64)
        self.pair_states = np.array([zlib.crc32(b" " + b, zlib.crc32(a)) for _, a, b in known], np.uint32)


def frequent_head(docs: DataFrame, max_run: int, text: str = "text") -> Head:
    """The head of a corpus: the words with a share of 1/HEAD_SHARE, and such pairs of them if runs have more than one word."""
    found = docs.select(F.lit(0), text).mapInArrow(_find_head(max_run > 1), "first binary, second binary, n long")
    counted = stage_table(found.groupBy("first", "second").agg(F.sum("n").alias("n")))
    total = counted.where("first IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # No more than HEAD_SHARE words, and pairs, can have that share.
    rows = counted.where(F.col("first").isNotNull() & (F.col("n") * HEAD_SHARE >= total)).collect()
    words = sorted(bytes(r["first"]) for r in rows if r["second"] is None)
    return Head(words, [(bytes(r["first"]), bytes(r["second"])) for r in rows if r["second"] is not None])


def _states(tokens: list[bytes], head: Head, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: where they start, and the CRC states of their bytes."""
    array = pa.array(tokens, pa.binary())
    place = pc.index_in(array, value_set=head.words).fill_null(-1).to_numpy()
    ends = np.fromiter((t == _END for t in tokens), bool, len(tokens))
    states = np.zeros(len(tokens), np.uint32)
    states[place >= 0] = head.states[place[place >= 0]]
    tail = np.flatnonzero((place < 0) & ~ends)
    states[tail] = np.fromiter((zlib.crc32(tokens[i]) for i in tail), np.uint32, len(tail))
    at = np.flatnonzero(~ends)
    yield at, states[at]
    for run in range(2, max_run + 1):
        at = at[at + run - 1 < len(tokens)]
        at = at[~ends[at + run - 1]]
        known = np.zeros(len(at), bool)
        longer = np.zeros(len(at), np.uint32)
        if run == 2 and len(head.pairs):
            key = np.where((place[at] >= 0) & (place[at + 1] >= 0), place[at].astype(np.int64) * len(head.words) + place[at + 1], -1)
            found = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            known = head.pairs[found] == key
            longer[known] = head.pair_states[found[known]]
        rest = np.flatnonzero(~known)
        longer[rest] = np.fromiter((zlib.crc32(b" " + tokens[i + run - 1], int(states[i])) for i in at[rest]), np.uint32, len(rest))
        states[at] = longer
        yield at, longer


def _count_features(head: Head, max_run: int, buckets: int, id_type: pa.DataType):
    schema = pa.schema(
        [("id", id_type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("total", pa.bool_())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for _, ids, texts in numbered(batches):
            tokens = _tokens(texts)
            doc = np.cumsum(np.fromiter((t == _END for t in tokens), np.int64, len(tokens)))
            runs = [(doc[at], states % np.uint32(buckets)) for at, states in _states(tokens, head, max_run)]
            n_words = np.bincount(runs[0][0], minlength=len(texts))
            n_features = sum(np.bincount(d, minlength=len(texts)) for d, _ in runs)
            keys, counts = np.unique(np.concatenate([d * buckets + b for d, b in runs]), return_counts=True)
            of_doc, bucket = np.divmod(keys, buckets)
            totals += np.bincount(bucket, counts, buckets).astype(np.int64)
            offsets = pa.array(np.searchsorted(of_doc, np.arange(len(texts) + 1)), pa.int32())
            columns = [pa.array(ids, id_type), pa.array(n_words), pa.array(n_features)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *lists, pa.array([False] * len(texts))], schema=schema)
        filled = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pylist([{"buckets": filled.tolist(), "counts": totals[filled].tolist(), "total": True}], schema)

    return count


def count_features(docs: DataFrame, head: Head, max_run: int = 1, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's ``id, n_words, n_features`` and filled ``buckets`` with their ``counts``; rows marked ``total`` sum a task's."""
    kind = docs.schema[key].dataType
    schema = f"id {kind.simpleString()}, n_words long, n_features long, buckets array<int>, counts array<bigint>, total boolean"
    return stage_table(docs.select(key, text).mapInArrow(_count_features(head, max_run, buckets, to_arrow_type(kind)), schema))


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The corpus's count in every bucket."""
    each = features.where("total").select(F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("counts").alias("n"))))
    out = [0] * buckets
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the corpus, rounded down."""
    size, all_raw, all_target = len(raw), sum(raw), sum(target)
    ratios = (float(t + 1) * float(all_raw + size) / (float(s + 1) * float(all_target + size)) for s, t in zip(raw, target, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def gumbel(label: str, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that a row's id fixes, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{label}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gains: np.ndarray, seed: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            values = gains[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = np.concatenate([[0], np.cumsum(values)])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            noise = np.array([gumbel(x or "", seed) for x in batch.column("label").to_pylist()], np.int64)
            columns = [batch.column(n) for n in ("id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight), pa.array(weight + noise)], schema=schema)

    return weigh


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Add ``rank`` (1, 2, 3, ...) in an order without ties: sorted ranges, and the rows in the ranges before."""
    number = F.monotonically_increasing_id()
    in_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(in_ranges.select("*", F.shiftright(number, 33).alias("_part"), (number.bitwiseAND((1 << 33) - 1) + 1).alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    max_run: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    text: str = "text",
    key: str = "doc_id",
    target_text: str = "text",
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row: ``percent`` of those with ``min_words`` are drawn.

    Words are runs of lower-case letters, digits and characters beyond ASCII; features are runs of 1 to ``max_run``
    of them, repeats counted. ``weight`` sums the gains (thousandths of log target over corpus share) of a row's
    features, ``score`` adds the id's noise. ``rank`` (from 1) orders the drawn rows by score, then by the smaller key;
    rows not drawn have none.

    Null and empty texts have no features, weight 0 and no rank. A null key's noise is that of an empty one, and it
    stands behind others in ties; repeated rows are drawn one by one, equal ones in any order. An empty table gives an
    empty result, an empty target weighs by the corpus alone; other columns are not looked at.
    """
    head = frequent_head(docs, max_run, text)
    features = count_features(docs, head, max_run, buckets, text, key)
    of_target = count_features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), head, max_run, buckets, "text", "id")
    gains = bucket_gains(bucket_totals(features, buckets), bucket_totals(of_target, buckets))
    kind = docs.schema[key].dataType
    rows = features.where(~F.col("total")).withColumn("label", F.col("id").cast("string"))
    schema = f"id {kind.simpleString()}, n_words long, n_features long, weight long, score long"
    weighed = rows.mapInArrow(_weigh(gains, seed, to_arrow_type(kind)), schema)
    scored = stage_table(weighed.withColumn("_tie", F.monotonically_increasing_id()))
    may = F.col("n_words") >= min_words
    drawn = scored.where(may).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_tie")]
    inside = ranked(scored.where(may), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = inside.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
