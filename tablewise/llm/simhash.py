"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into three blocks of 23, 23 and 18 bits. Fingerprints that differ
in at most four bits differ in at most one bit of the first block, or in at most one of the second, or
not at all in the third (else they would differ in 2 + 2 + 1 bits). Each block has its covering code:

* 23 bits: the perfect binary Golay code, 4096 anchors, covering radius 3. Every value lies within 3
  bits of exactly one anchor, its home; a value that differs from it in one bit lies within 3 + 1 bits
  of that anchor. So a fingerprint goes to all anchors within 4 bits: 5.3 on average.
* 18 bits: all values are anchors, covering radius 0, and no bit may differ: one anchor.

Per anchor, fingerprints at home are compared on all 64 bits with those replicated to it. Every linked
pair meets at the home of either one, so nothing is lost, and a fingerprint makes fewer than 14 rows.
Only distinct fingerprints take part: exact copies, however many, are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage_table
from .components import smallest_reachable

#: Words of a shingle.
SHINGLE = 4
#: Bits in which linked fingerprints differ at most. The block plan below is made for up to 4.
MAX_BITS = 4
#: Seed of the shingle hash.
SEED = 42
#: Replicated fingerprints of one anchor that one task compares; larger anchors are split.
ANCHOR_ROWS = 50_000
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
GOLAY_BITS = 23
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    if not text:
        return 0
    words = text.encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(64) if 2 * int(ones[b]) > n))


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Home anchor of every 23-bit value, and the patterns that lead from a value to anchors nearby.

    An anchor is a multiple of the generator; the remainder of a value (11 bits) tells where anchors lie.
    ``patterns[r]`` holds, padded with -1, all error patterns of up to 4 bits with remainder r.
    """
    remainder = np.zeros(1 << GOLAY_BITS, np.uint16)
    steps = []
    for bit in range(GOLAY_BITS):
        value = 1 << bit
        for high in range(GOLAY_BITS - 1, 10, -1):
            if value >> high & 1:
                value ^= GOLAY << (high - 11)
        steps.append(value)
        remainder[1 << bit : 2 << bit] = remainder[: 1 << bit] ^ value
    weights = np.bitwise_count(np.arange(1 << GOLAY_BITS, dtype=np.uint32))
    near = np.flatnonzero(weights <= 4).astype(np.int32)
    near = near[np.lexsort((near, weights[near], remainder[near]))]
    counts = np.bincount(remainder[near], minlength=2048)
    patterns = np.full((2048, counts.max()), -1, np.int32)
    order = np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)
    patterns[remainder[near], order] = near
    return remainder, patterns


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The tables, made once a process."""
    if not _tables:
        _tables.append(_golay_tables())
    return _tables[0]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)`` of fingerprints: all anchors they go to, and whether it is their home.

    Anchors are numbered over the blocks: the block in the bits from 24 on, the anchor in those below.
    """
    remainder, patterns = golay_tables()
    every = np.arange(len(prints))
    rows, found, homes = [], [], []
    for block, shift in enumerate((0, GOLAY_BITS)):
        value = ((prints >> np.uint64(shift)) & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64)
        ways = patterns[remainder[value]]
        row, way = np.nonzero(ways >= 0)
        rows.append(row)
        found.append((value[row] ^ ways[row, way]) | block << 24)
        homes.append(way == 0)  # the lightest pattern, of at most 3 bits, comes first
    rows.append(every)
    found.append((prints >> np.uint64(2 * GOLAY_BITS)).astype(np.int64) | 2 << 24)
    homes.append(np.ones(len(prints), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "print"])


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 4096):
            row, anchor, home = anchors(prints[at : at + 4096])
            columns = [pa.array(prints[at:][row].view(np.int64)), pa.array(anchor), pa.array(home)]
            yield pa.RecordBatch.from_arrays(columns, ["print", "anchor", "home"])


class _Anchor:
    """The fingerprints at home at one anchor, and which of them are known to be connected."""

    def __init__(self) -> None:
        self.prints = np.empty(0, np.uint64)
        self.label = np.empty(0, np.int64)

    def settle(self, prints: np.ndarray) -> None:
        self.prints = np.concatenate((self.prints, prints))
        self.label = np.arange(len(self.prints))

    def compare(self, prints: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links of replicated fingerprints: one for each that is near a home, whatever the number of homes near it."""
        found = []
        wide = max(1, (1 << 21) // max(1, len(self.prints)))
        for at in range(0, len(prints) if len(self.prints) else 0, wide):
            part = prints[at : at + wide]
            apart = np.bitwise_count(part[:, None] ^ self.prints[None, :])
            near = (apart <= bits) & (apart > 0)
            linked = np.flatnonzero(near.any(axis=1))
            if not len(linked):
                continue
            near = near[linked]
            found.append((part[linked], self.prints[near.argmax(axis=1)]))
            for homes in near[near.sum(axis=1) > 1]:
                labels = np.unique(self.label[homes])
                if len(labels) > 1:
                    self.label[np.isin(self.label, labels)] = labels[0]
        return found

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links among the homes themselves that replicated fingerprints have shown."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.prints[moved], self.prints[self.label[moved]]


def _compare_batches(bits: int):
    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]).view(np.int64)
        b = np.concatenate([x for _, x in found]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and part, homes first; links go out as they are found."""
        current, held = None, _Anchor()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, home, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            home, prints = home.astype(bool), prints.view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if key[start] != current:
                    found.append(held.links())
                    current, held = key[start], _Anchor()
                own, part = home[start:end], prints[start:end]
                if own.any():
                    held.settle(part[own])
                found += held.compare(part[~own], bits)
            if any(len(x) for x, _ in found):
                yield packed(found)
        if len(held.links()[0]):
            yield packed([held.links()])

    return compare


def near_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)``, a > b, among the distinct longs ``print``: those that differ in at most ``bits`` bits are connected.

    Not every near pair is listed, but every near pair is connected by links, and every link is a near pair
    or joins two prints that a third one is near to.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the blocks are made for 0 to {MAX_BITS} bits")
    spread = prints.select("print").mapInArrow(_anchor_batches, "print long, anchor long, home boolean")
    # Anchors with many fingerprints are compared in parts: each part sees all homes and a share of the others.
    # There are at most 2 * 4096 + 2^18 anchors, so their sizes may be broadcast.
    sizes = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ANCHOR_ROWS)
    parts = F.broadcast(sizes.select("anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("_parts")))
    split = spread.join(parts, "anchor", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # A home is sent as such to every part, and once to be compared with the other homes.
    own = F.pmod(F.xxhash64("print"), "_parts").cast("int")
    copies = F.concat(
        F.array(F.struct(own.alias("part"), F.lit(False).alias("home"))),
        F.when(
            F.col("home"),
            F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("home"))),
        ).otherwise(F.array().cast("array<struct<part:int,home:boolean>>")),
    )
    dealt = split.select("anchor", "print", F.inline(copies).alias("part", "home")).select(
        (F.col("anchor") * (1 << 32) + F.col("part")).alias("key"), "home", "print"
    )
    in_order = dealt.repartition("key").sortWithinPartitions("key", F.col("home").desc())
    return in_order.mapInArrow(_compare_batches(bits), "a long, b long").distinct()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, print)``, the print as a signed long; every row of ``docs`` has one."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), text).mapInArrow(_fingerprint_batches, f"id {kind}, print long").select(
        F.col("id").alias(key), "print"
    )


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = MAX_BITS) -> DataFrame:
    """``key, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest ``key`` that can be reached
    over fingerprints differing in at most ``bits`` bits, the row's own included. Null, empty and blank texts
    have fingerprint 0 and are linked like any other; a row without key is in the component of its
    fingerprint but does not name one (it is null if no row there has a key); repeated rows stay; an empty
    table gives an empty result; other columns are not looked at.
    """
    prints = stage_table(fingerprints(docs, text, key))
    nodes = stage_table(prints.groupBy("print").agg(F.min(key).alias("smallest")))
    roots = smallest_reachable(near_links(nodes, bits)).withColumnRenamed("node", "print")
    classes = nodes.join(roots, "print", "left").select("print", "smallest", F.coalesce("root", "print").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("smallest").alias("component_id")), "root")
    return prints.join(named.select("print", "component_id"), "print").select(
        key, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
