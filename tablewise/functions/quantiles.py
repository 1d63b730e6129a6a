"""Exact quantiles of columns of any length, by radix selection with counters of a fixed number.

``percentile`` keeps every distinct value of a column in one task, which cannot hold a long column. Here a double is
read as a whole number of 64 bits with the same order. Each round counts, in one scan, how many rows of each column
fall into equal cells of an interval, and the least and the greatest value in each cell. The cell that holds a wanted
rank is the next round's interval, from its least to its greatest value. A rank is found when its cell has one value,
or when it is the first or the last of its cell; so values that repeat take two rounds, and no data take more than the
bits allow.

All columns and ranks share the rounds. The counters' number depends on neither the rows nor the values: a task
sends what it has counted, sums are made for each cell, and the driver gets one row for each rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import col

#: Bits of a column's first cells, and of later ones at most.
FIRST_BITS = 16
#: Cells of all intervals of one round.
CELLS = 1 << 21
COLUMNS_PER_JOB = 25

#: An interval: column, first and last whole number.
Interval = tuple[int, int, int]

_SCHEMA = "target int, cell int, n long, lo long, hi long"
_ARROW = pa.schema([("target", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_ROWS = 1 << 16


def to_whole(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _HIGH)


def to_double(whole: int) -> float:
    bits = np.int64(whole)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(_HIGH))).view(np.float64))


def _shift(lo: int, hi: int, bits: int) -> int:
    """By how many bits a place in the interval is moved to give its cell."""
    return max((hi - lo).bit_length() - bits, 0)


class _Counters:
    """Rows, least and greatest value of the filled cells of an interval."""

    def __init__(self, interval: Interval, bits: int) -> None:
        self.column, self.lo, self.hi = interval
        self.shift = _shift(self.lo, self.hi, bits)
        size = ((self.hi - self.lo) >> self.shift) + 1
        self.n, self.least, self.most = np.zeros(size, np.int64), np.full(size, _HIGH), np.full(size, _LOW)

    def add(self, whole: np.ndarray) -> None:
        """Count sorted whole numbers."""
        inside = whole[np.searchsorted(whole, self.lo) : np.searchsorted(whole, self.hi, "right")]
        if not len(inside):
            return
        # Differences of up to 64 bits are right without a sign.
        cell = ((inside.view(np.uint64) - np.int64(self.lo).view(np.uint64)) >> np.uint64(self.shift)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        at = cell[start[:-1]]
        self.n[at] += np.diff(start)
        self.least[at] = np.minimum(self.least[at], inside[start[:-1]])
        self.most[at] = np.maximum(self.most[at], inside[start[1:] - 1])


def _count(intervals: list[Interval], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counters(i, bits) for i in intervals]

        def add(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            for c in range(table.num_columns):
                values = table.column(c).drop_null().to_numpy()
                whole = np.sort(to_whole(values[~np.isnan(values)]))
                for counter in counters:
                    if counter.column == c:
                        counter.add(whole)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _ROWS:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        for i, c in enumerate(counters):
            cell = np.flatnonzero(c.n)
            for at in range(0, len(cell), _ROWS):
                some = cell[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in (c.n, c.least, c.most))], schema=_ARROW)

    return count


def _histograms(values: DataFrame, intervals: list[Interval], bits: int) -> DataFrame:
    """``(target, cell, n, lo, hi, before)``: rows and extremes of a cell, and the rows in the cells before."""
    counted = values.mapInArrow(_count(intervals, bits), _SCHEMA).groupBy("target", "cell")
    cells = counted.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    earlier = F.sum("n").over(W.partitionBy("target").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    return cells.withColumn("before", F.coalesce(earlier, F.lit(0)))


def exact_quantiles(
    df: DataFrame, columns: list[str] | dict[str, Column], probs: list[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, ignoring NULL and NaN; ``None`` for an empty column.

    ``columns`` may map labels to expressions. All columns and probabilities share the scans.
    """
    inputs = columns if isinstance(columns, dict) else {c: col(c) for c in columns}
    result: dict[str, list[float | None]] = {}
    names = list(inputs)
    for start in range(0, len(names), COLUMNS_PER_JOB):
        part = names[start : start + COLUMNS_PER_JOB]
        found = _quantiles(df, [inputs[c].cast("double") for c in part], probs)
        result.update(zip(part, found, strict=True))
    return result


def _quantiles(df: DataFrame, inputs: list[Column], probs: list[float]) -> list[list[float | None]]:
    values = df.select(*[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    cells = _histograms(values, [(c, _LOW, _HIGH) for c in range(len(inputs))], FIRST_BITS)
    size = F.sum("n").over(W.partitionBy("target").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    position = (F.col("size") - 1) * F.col("prob")
    low = F.least(F.floor(position), F.col("size") - 1)
    asked = cells.withColumn("size", size).select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("k", "prob"))
    asked = asked.select("*", F.explode(F.array(low, F.least(low + 1, F.col("size") - 1))).alias("rank"))
    first = asked.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("target", "size", "rank", "before", "n", "lo", "hi")
    sizes: dict[int, int] = {}
    answers: dict[tuple[int, int], int] = {}
    #: Intervals with the ranks that are sought in them, from the interval's start.
    sought: dict[Interval, set[tuple[int, int]]] = {}

    def settle(column: int, rank: int, inner: int, n: int, lo: int, hi: int) -> None:
        if inner in (0, n - 1) or lo == hi:
            answers[column, rank] = lo if inner == 0 else hi
        else:
            sought.setdefault((column, lo, hi), set()).add((rank, inner))

    for r in first.distinct().collect():
        sizes[r["target"]] = r["size"]
        settle(r["target"], r["rank"], r["rank"] - r["before"], r["n"], r["lo"], r["hi"])
    spark = df.sparkSession
    while sought:
        intervals, ranks, sought = list(sought), list(sought.values()), {}
        names = sorted({c for c, _, _ in intervals})
        bits = max(min(FIRST_BITS, (CELLS // len(intervals)).bit_length() - 1), 1)
        local = [(names.index(c), lo, hi) for c, lo, hi in intervals]
        wanted = spark.createDataFrame([(i, rank, inner) for i, of in enumerate(ranks) for rank, inner in of], "target int, rank long, inner long")
        cells = _histograms(values.select(*[values.columns[c] for c in names]), local, bits)
        inner = F.col("inner") - F.col("before")
        hits = cells.join(F.broadcast(wanted), "target").where((inner >= 0) & (inner < F.col("n")))
        for r in hits.select("target", "rank", inner.alias("inner"), "n", "lo", "hi").collect():
            settle(intervals[r["target"]][0], r["rank"], r["inner"], r["n"], r["lo"], r["hi"])

    out: list[list[float | None]] = []
    for c in range(len(inputs)):
        if not sizes.get(c):
            out.append([None] * len(probs))
            continue
        out.append([])
        for p in probs:
            position = (sizes[c] - 1) * p
            low = min(math.floor(position), sizes[c] - 1)
            a, b = (to_double(answers[c, r]) for r in (low, min(low + 1, sizes[c] - 1)))
            weight = position - low
            out[-1].append(a if a == b or weight == 0 else a + (b - a) * weight)
    return out
