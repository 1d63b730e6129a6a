"""Blocks of documents, and rows that travel between blocks and hash buckets.

Operators that look up the words or windows of a text work on blocks of documents. A block sends what it
wants to know, packed, to buckets of a hash; a bucket meets the entries of all blocks and answers each of
them. All rows of such an operator have one schema: documents have a ``slot`` in their block and no
``bucket``, packed entries and answers have a ``bucket``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Documents, and about how many characters of them, that make one block.
BLOCK_DOCS = 2_000
BLOCK_CHARS = 8_000_000

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}


class Rows:
    """The schema of an operator's rows: the common columns and its own ones (name: SQL type)."""

    def __init__(self, id_type: DataType, **own: str) -> None:
        kinds = {"block": "long", "bucket": "int", "slot": "int", "text": "string", "packed": "binary", **own}
        self.sql = ", ".join([f"id {id_type.simpleString()}", *(f"{n} {k}" for n, k in kinds.items())])
        self.arrow = pa.schema([("id", to_arrow_type(id_type)), *((n, _ARROW[k]) for n, k in kinds.items())])

    def batches(self, rows: list[dict], size: int = 500) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), size):
            yield pa.RecordBatch.from_pylist(rows[at : at + size], self.arrow)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """Blocks of ids and texts (null: empty), numbered over all partitions; the same rows give the same blocks."""
    block, ids, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(key.as_py())
            texts.append(value.as_py() or "")
            chars += len(texts[-1])
            if len(ids) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield block, ids, texts
                block, ids, texts, chars = block + 1, [], [], 0
    if ids:
        yield block, ids, texts


def send_texts(rows: Rows):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in numbered(batches):
            out = [{"id": k, "block": block, "slot": i, "text": t} for i, (k, t) in enumerate(zip(ids, texts, strict=True))]
            yield from rows.batches(out)

    return send


def to_buckets(df: DataFrame) -> DataFrame:
    """Entries meet by bucket; documents that pass are spread evenly."""
    deal = F.coalesce(F.col("bucket").cast("long"), -F.xxhash64("block", "slot"))
    return df.repartition(deal).sortWithinPartitions("bucket", "block", "slot")


def to_blocks(df: DataFrame) -> DataFrame:
    """Blocks come together again: first the documents in order, then the answers."""
    return df.repartition("block").sortWithinPartitions("block", F.col("bucket").isNotNull(), "slot")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], dict[int, bytes]]]:
    """For rows sorted by block: its documents in order, and the answers by bucket."""
    block, docs, answers = None, [], {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                if block is not None:
                    yield block, docs, answers
                block, docs, answers = row["block"], [], {}
            if row["bucket"] is None:
                docs.append(row)
            else:
                answers[row["bucket"]] = row["packed"]
    if block is not None:
        yield block, docs, answers


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | tuple[int, list[tuple[int, bytes]]]]:
    """For rows sorted by bucket: batches of documents that pass, and each bucket with its (block, packed) entries."""
    current, held = None, []
    for batch in batches:
        is_entry = batch.column("bucket").is_valid()
        passing = batch.filter(batch.column("bucket").is_null())
        if passing.num_rows:
            yield passing
        entries = batch.filter(is_entry).select(["block", "bucket", "packed"])
        for block, bucket, packed in zip(*(c.to_pylist() for c in entries.columns), strict=True):
            if bucket != current:
                if held:
                    yield current, held
                current, held = bucket, []
            held.append((block, packed))
    if held:
        yield current, held


class Entries:
    """Distinct hashes of a block in a fixed order, cut into buckets."""

    def __init__(self, buckets: int, first: np.ndarray, second: np.ndarray | None = None) -> None:
        order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
        a = first[order]
        b = np.zeros(len(a), np.uint64) if second is None else second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.entry = np.empty(len(a), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first, self.second = a[new], b[new]
        # Buckets are ranges of the hashes, so that the order is theirs, too.
        self.bucket = ((self.first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.several = np.bincount(self.entry, minlength=len(self.first)) > 1

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        """Each bucket that has entries, and where they stand."""
        cuts = [0, *(np.flatnonzero(np.diff(self.bucket)) + 1).tolist(), len(self.bucket)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start < end:
                yield int(self.bucket[start]), slice(start, end)
