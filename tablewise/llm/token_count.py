"""Token counts without token ids.

Byte-level BPE never merges across the pieces that its pattern cuts a text into, its pre-tokens. So a
document's number of tokens is the sum, over its distinct pre-tokens, of frequency times pieces:

1. each block of documents becomes an inverted list of its pre-tokens (in which documents, how often),
   dealt into buckets by a hash of the pre-token;
2. a bucket meets all lists of its pre-tokens; the tokenizer is asked once for each distinct one, and
   the lists become partial sums for the documents of each block;
3. the partial sums of a block are added up.

A frequent pre-token costs one entry in each block, so no bucket grows hot, and texts are read once.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import numbered

#: The pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of pre-tokens for each shuffle partition.
BUCKETS_A_PARTITION = 2
LIMIT = 1024


def load_tokenizer(path: str) -> str:
    """The tokenizer file's content, checked to be one that this method counts rightly."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    kinds = json.loads(content)
    cut = kinds["pre_tokenizer"] or {}
    odd = [t["content"] for t in kinds["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if kinds["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or odd:
        raise ValueError("a byte-level tokenizer is needed, without normalizer, prefix space or stripping tokens")
    return content


def _specials(content: str) -> list[str]:
    return [t["content"] for t in json.loads(content)["added_tokens"]]


def _pack(names: list[bytes], lists: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Tokens, the lengths of their lists, and the lists (documents and counts); sizes first, all compressed together."""
    blob = b"".join(names)
    parts = [
        np.array([len(names), len(blob)], np.int64).tobytes(),
        np.fromiter(map(len, names), np.int32, len(names)).tobytes(),
        lists.astype(np.int32).tobytes(),
        blob,
        docs.astype(np.int32).tobytes(),
        counts.astype(np.int32).tobytes(),
    ]
    return zlib.compress(b"".join(parts), 1)


def _unpack(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(packed)
    n, size = np.frombuffer(data, np.int64, 2)
    name_ends = np.cumsum(np.frombuffer(data, np.int32, n, 16))
    lists = np.frombuffer(data, np.int32, n, 16 + 4 * n)
    at = 16 + 8 * n
    names = data[at : at + size]
    rest = np.frombuffer(data[at + size :], np.int32)
    half = len(rest) // 2
    cuts = [0, *name_ends.tolist()]
    return [names[a:b] for a, b in itertools.pairwise(cuts)], lists, rest[:half], rest[half:]


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


_ROW = "id {kind}, block long, bucket int, slot int, n_bytes long, n_tokens long, packed binary"


def _invert(buckets: int, specials: list[str], id_type: pa.DataType):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two kinds of rows: one for each document of a block, and one for each block and bucket."""
        cut = regex.compile(PATTERN).findall
        apart = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        for block, ids, texts in numbered(batches):
            sizes, special = [], []
            tokens, counts, found_in = [], [], []
            for text in texts:
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                pieces = [text]
                if apart is not None and any(s in text for s in specials):
                    pieces = apart.split(text)
                special.append(len(pieces) - 1)
                found = Counter(itertools.chain.from_iterable(map(cut, pieces)))
                tokens += found.keys()
                counts += found.values()
                found_in.append(len(found))
            n = len(ids)
            yield _rows(
                pa.array(ids, id_type), [block] * n, [-1] * n, range(n), sizes, special, [None] * n, id_type
            )
            # Distinct tokens by bucket, and the entries in their order.
            numbers = dict.fromkeys(tokens)
            names = [t.encode("utf-8", "surrogatepass") for t in numbers]
            home = np.fromiter((zlib.crc32(x) % buckets for x in names), np.int64, len(names))
            by_home = np.argsort(home, kind="stable")
            place = np.empty(len(names), np.int64)
            place[by_home] = np.arange(len(names))
            numbers.update(zip(numbers, place.tolist(), strict=True))
            token = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
            order = np.argsort(token, kind="stable")
            docs = np.repeat(np.arange(len(texts)), found_in)[order]
            times = np.array(counts, np.int64)[order]
            lists = np.bincount(token, minlength=len(names))
            ends = np.concatenate(([0], np.cumsum(lists)))
            cuts = [*np.flatnonzero(np.diff(home[by_home], prepend=-1)).tolist(), len(names)]
            dealt, packed = [], []
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                some = slice(ends[first], ends[last])
                dealt.append(int(home[by_home[first]]))
                packed.append(_pack([names[i] for i in by_home[first:last]], lists[first:last], docs[some], times[some]))
            n = len(dealt)
            none = [None] * n
            yield _rows(pa.nulls(n, id_type), [block] * n, dealt, none, none, none, packed, id_type)

    return invert


def _rows(ids, block, bucket, slot, n_bytes, n_tokens, packed, id_type: pa.DataType) -> pa.RecordBatch:
    types = {"block": pa.int64(), "bucket": pa.int32(), "slot": pa.int32(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "packed": pa.binary()}
    columns = [pa.array(x, t) for x, t in zip((block, bucket, slot, n_bytes, n_tokens, packed), types.values(), strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["id", *types])


def _sum_lists(content: str, id_type: pa.DataType):
    def sum_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of whole buckets become partial sums; rows of documents pass."""
        from tokenizers import Tokenizer

        pieces_of = Tokenizer.from_str(content).model.tokenize
        shown = _byte_letters()
        known: dict[bytes, int] = {}
        for batch in batches:
            passing = batch.filter(batch.column("packed").is_null())
            if passing.num_rows:
                yield passing
            packs = batch.filter(batch.column("packed").is_valid()).select(["block", "bucket", "packed"])
            for row in packs.to_pylist():
                tokens, lists, docs, counts = _unpack(row["packed"])
                for token in tokens:
                    if token not in known:
                        known[token] = len(pieces_of(token.decode("latin-1").translate(shown)))
                pieces = np.fromiter((known[t] for t in tokens), np.int64, len(tokens))
                sums = np.bincount(docs, weights=counts * np.repeat(pieces, lists)).astype(np.int64)
                some = np.flatnonzero(sums)
                packed = zlib.compress(np.concatenate((some, sums[some])).astype(np.int32).tobytes(), 1)
                yield _rows(pa.nulls(1, id_type), [row["block"]], [row["bucket"]], [None], [None], [None], [packed], id_type)

    return sum_lists


def _add_up(id_type: pa.DataType):
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the documents' own first and in their order."""
        block, ids, sizes, sums = None, [], [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if ids:
                        yield out()
                    block, ids, sizes, sums = row["block"], [], [], []
                if row["packed"] is None:
                    ids.append(row["id"])
                    sizes.append(row["n_bytes"])
                    sums.append(row["n_tokens"])
                else:
                    some, partial = np.frombuffer(zlib.decompress(row["packed"]), np.int32).reshape(2, -1)
                    sums = np.asarray(sums, np.int64)
                    sums[some] += partial
        if ids:
            yield out()

    return add_up


def token_counts(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row, as the byte-level tokenizer file ``tokenizer`` counts.

    No begin, end or other tokens are added; strings of special tokens inside a text count as one token each, as the
    library has it by default; nothing is cut off or padded. Null counts as empty (0 and 0); keys may be null
    or repeat; an empty table gives an empty result; other columns are not looked at.
    """
    content = load_tokenizer(tokenizer)
    spark = docs.sparkSession
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType
    id_type = to_arrow_type(kind)
    row = _ROW.format(kind=kind.simpleString())
    lists = docs.select(F.col(key).alias("id"), text).mapInArrow(_invert(buckets, _specials(content), id_type), row)
    dealt = lists.repartition(F.when(F.col("bucket") < 0, -F.xxhash64("block", "slot")).otherwise(F.col("bucket").cast("long")))
    sums = dealt.mapInArrow(_sum_lists(content, id_type), row)
    blocks = sums.repartition("block").sortWithinPartitions("block", F.col("packed").isNotNull(), "slot")
    counted = blocks.mapInArrow(_add_up(id_type), f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
