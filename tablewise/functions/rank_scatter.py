"""Products of average ranks of many columns, with two shuffles at any number of columns.

1. Rows are numbered and taken apart into (column, value, row), which one range partitioning sorts by column and value.
   A task's cells arrive sorted by Spark and are ranked a slab at a time: runs of neighbouring values, whose number of
   cells is fixed however many a task has. Equal values may lie in several slabs and tasks: the first and the last value
   of a run stay open until every slab has told their counts.
2. Ranks return to chunks of rows, packed, one batch for each chunk a slab has met. A chunk is a dense table of
   columns and rows whose size is fixed, and adds its products to the sums of its task.

Two columns are ranked on the rows that both fill. For a column with missing cells each cell carries one bit, and the
sorted bits' running totals are the ranks of all other columns on its rows: a row travels once a column, never once a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .slices import sliced_aggregate
from .staging import stage_table

#: Cells (columns x row groups x rows) of one chunk, and its rows at most.
CHUNK_CELLS = 1 << 22
CHUNK_ROWS = 1 << 16
#: Cells (times row groups) that Python ranks at once, and cells at least.
SLAB_CELLS = 1 << 20
SLAB_LEAST = 1 << 16
#: Slabs of a task are numbered in this many bits, below the task's own number.
SLAB_BITS = 32
#: Bits in one whole number of a row's mask.
BITS = 62

_RANKED = (
    "chunk long, part long, col int, at binary, flag binary, twice binary,"
    " first double, last double, total array<bigint>, of_first array<bigint>, of_last array<bigint>"
)
_LISTS = pa.list_(pa.int64())
_RANKED_ARROW = pa.schema(
    [("chunk", pa.int64()), ("part", pa.int64()), ("col", pa.int32()), ("at", pa.binary()), ("flag", pa.binary()), ("twice", pa.binary()),
     ("first", pa.float64()), ("last", pa.float64()), ("total", _LISTS), ("of_first", _LISTS), ("of_last", _LISTS)]
)


def _cells(values: DataFrame, gaps: list[int]) -> DataFrame:
    """``(col, value, row, mask)`` of every filled cell; a mask has one bit for each column with gaps."""
    bits = [F.when(F.col(values.columns[c]).isNotNull(), F.lit(1 << (k % BITS))).otherwise(F.lit(0)).cast("long") for k, c in enumerate(gaps)]
    words = [sum(bits[i : i + BITS], F.lit(0).cast("long")) for i in range(0, len(bits), BITS)]
    numbered = values.select("*", F.monotonically_increasing_id().alias("_row"), F.array(*words).cast("array<bigint>").alias("_mask"))
    # 0.0 is added so that both zeros are one value.
    cells = [F.struct(F.lit(i).alias("col"), (F.col(c) + 0.0).alias("value"), F.col("_row").alias("row"), F.col("_mask").alias("mask")) for i, c in enumerate(values.columns)]
    return numbered.select(F.inline(F.array(*cells))).where("value IS NOT NULL")


def _groups(batch: pa.Table, n_gaps: int) -> np.ndarray:
    """For each cell: does it count among all rows, and among those that each column with gaps fills?"""
    out = np.ones((batch.num_rows, 1 + n_gaps), bool)
    if n_gaps:
        words = batch.column("mask").combine_chunks().flatten().to_numpy().reshape(batch.num_rows, -1)
        for k in range(n_gaps):
            out[:, 1 + k] = (words[:, k // BITS] >> (k % BITS)) & 1
    return out


def _slabs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The cells in the order they come, ``size`` at a time."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= size:
            yield pa.Table.from_batches([*held, batch.slice(0, size - n)])
            batch, held, n = batch.slice(size - n), [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _rank(n_gaps: int, shift: int, size: int):
    """Ranks cells sorted by column and value within each slab of ``size`` cells."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << SLAB_BITS
        for slab, table in enumerate(_slabs(batches, size)):
            yield from rank_slab(task + slab, table)

    def rank_slab(part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        col, value, row = (table.column(c).to_numpy() for c in ("col", "value", "row"))
        inside = _groups(table, n_gaps)
        edges = [0, *(np.flatnonzero(np.diff(col)) + 1).tolist(), len(col)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            v, r = value[start:end], row[start:end]
            running = np.zeros((end - start + 1, inside.shape[1]), np.int64)
            np.cumsum(inside[start:end], axis=0, out=running[1:])
            ties = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])
            less, upto = running[ties[:-1]], running[ties[1:]]
            # Twice the average rank, less one.
            twice = np.repeat((less + upto).astype(np.int64), np.diff(ties), axis=0)
            flag = np.zeros(len(v), np.uint8)
            flag[ties[-2] :] = 2
            flag[: ties[1]] = 1
            summary = {
                "part": part, "col": int(col[start]), "first": v[0], "last": v[-1], "total": running[-1].tolist(),
                "of_first": running[ties[1]].tolist(), "of_last": (running[-1] - running[ties[-2]]).tolist(),
            }
            yield pa.RecordBatch.from_pylist([summary], _RANKED_ARROW)
            back = np.argsort(r >> shift, kind="stable")
            chunk = (r >> shift)[back]
            at = (r & ((1 << shift) - 1))[back].astype(np.int32)
            twice, flag = twice[back], flag[back]
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            for i in range(0, len(spans), 200):
                rows = [
                    {"chunk": int(chunk[s]), "part": part, "col": int(col[start]), "at": at[s:e].tobytes(), "flag": flag[s:e].tobytes(), "twice": twice[s:e].tobytes()}
                    for s, e in spans[i : i + 200]
                ]
                yield pa.RecordBatch.from_pylist(rows, _RANKED_ARROW)

    return ranked


def _corrections(summaries: list) -> tuple[dict, dict[int, np.ndarray]]:
    """By (slab, column): twice what lies before its run, and twice the open ranks (less one); by column: its cells by group."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    totals: dict[int, np.ndarray] = {}
    for column, runs in groupby(sorted(summaries, key=lambda r: (r["col"], r["part"])), key=lambda r: r["col"]):
        before, value, less, equal, waiting = 0, None, None, None, []

        def close() -> None:
            for key, place in waiting:
                found[key][place] = 2 * less + equal

        for run in runs:
            key, total = (run["part"], column), np.array(run["total"])
            found[key] = [2 * before + np.zeros_like(total), None, None]
            if waiting and value == run["first"]:
                equal = equal + np.array(run["of_first"])
                waiting.append((key, 1))
            else:
                close()
                value, less, equal, waiting = run["first"], before + np.zeros_like(total), np.array(run["of_first"]), [(key, 1)]
            if run["first"] != run["last"]:
                close()
                of_last = np.array(run["of_last"])
                value, less, equal, waiting = run["last"], before + total - of_last, of_last, [(key, 2)]
            before = before + total
        close()
        totals[column] = before
    return found, totals


def _multiply(width: int, gaps: list[int], shift: int, found: dict, n: np.ndarray):
    """Sums over a task's chunks: for columns a and b, products of their ranks on common rows, and squares of a's."""
    group = np.zeros(width, np.int64)
    group[gaps] = 1 + np.arange(len(gaps))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = np.zeros((width, width)), np.zeros((width, width))
        ranks = np.zeros((width, 1 + len(gaps), 1 << shift))
        filled = np.zeros((width, 1 << shift), bool)

        def add() -> None:
            for a in range(width):
                both = filled & filled[a]
                # Twice a rank less one, less its mean: twice the centred rank.
                mine = (ranks[a, group] - n[a][:, None]) * both
                theirs = (ranks[:, group[a]] - n[:, a][:, None]) * both
                p[a] += np.einsum("br,br->b", mine, theirs)
                q[a] += np.einsum("br,br->b", mine, mine)
            filled[:] = False

        current = None
        for batch in batches:
            packs = (batch.column(c) for c in ("at", "flag", "twice"))  # one pack at a time leaves Arrow's memory
            for chunk, part, col, at, flag, twice in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "col")), *packs, strict=True):
                if chunk != current:
                    if current is not None:
                        add()
                    current = chunk
                at, flag = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(flag.as_buffer(), np.uint8)
                own = np.frombuffer(twice.as_buffer(), np.int64).reshape(len(at), -1)
                before, first, last = found[part, col]
                own = own + before
                own[flag == 1] = first
                if last is not None:
                    own[flag == 2] = last
                ranks[col][:, at] = own.T
                filled[col, at] = True
        if current is not None:
            add()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in (p, q))], ["a", "p", "q"])

    return multiply


def rank_correlations(df: DataFrame, inputs: list[Column]) -> np.ndarray:
    """Rank correlations of double columns, each pair on the rows that both fill; NaN where a column does not vary there.

    Missing cells are null. What reaches the driver is a few numbers for each slab and column, and for each pair of columns.
    """
    width = len(inputs)
    values = df.select(*[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    counts = [F.struct(F.lit(i).alias("i"), (F.count(c) < F.count(F.lit(1))).alias("gaps")) for i, c in enumerate(values.columns)]
    gaps = sorted(r["i"] for r in sliced_aggregate(values, counts).collect() if r["gaps"])
    shift = min(CHUNK_ROWS, max(1 << 8, CHUNK_CELLS // (width * (1 + len(gaps))))).bit_length() - 1
    # Spark sorts, with its disk at hand: Python's memory holds a slab, whatever the size of a partition.
    cells = _cells(values, gaps).repartitionByRange("col", "value", "row").sortWithinPartitions("col", "value")
    size = max(SLAB_LEAST, SLAB_CELLS // (1 + len(gaps)))
    ranked = stage_table(cells.mapInArrow(_rank(len(gaps), shift, size), _RANKED))
    found, totals = _corrections(ranked.where("chunk IS NULL").select("part", "col", "first", "last", "total", "of_first", "of_last").collect())
    group = [1 + gaps.index(c) if c in gaps else 0 for c in range(width)]
    n = np.array([[totals[a][group[b]] if a in totals else 0 for b in range(width)] for a in range(width)], float)
    packs = ranked.where("chunk IS NOT NULL").select("chunk", "part", "col", "at", "flag", "twice").repartition("chunk").sortWithinPartitions("chunk")
    sums = packs.mapInArrow(_multiply(width, gaps, shift, found, n), "a int, p array<double>, q array<double>")
    p, q = np.zeros((width, width)), np.zeros((width, width))
    each = sums.select("a", F.posexplode(F.arrays_zip("p", "q")).alias("b", "t"))
    for r in each.groupBy("a", "b").agg(F.sum("t.p").alias("p"), F.sum("t.q").alias("q")).collect():  # columns squared
        p[r["a"], r["b"]], q[r["a"], r["b"]] = r["p"], r["q"]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((q > 0) & (q.T > 0), np.clip(p / np.sqrt(q) / np.sqrt(q.T), -1.0, 1.0), np.nan)
