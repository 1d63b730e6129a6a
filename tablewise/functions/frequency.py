"""Value counts of many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..schema import as_double, present
from .staging import stage_table

#: Cells that a task holds before it packs what it has counted.
CELLS_AT_ONCE = 4_000_000
#: Most frequent hashes of a column that are broadcast; columns that are looked at together.
FEW_TIED, COLUMNS_AT_ONCE = 1_000, 50
#: Most frequent hashes of a column that are compared one by one.
COMPARED = 8
#: Characters with which the search for the smallest of many most frequent texts begins.
FIRST_CHARACTERS = 64


def value_counts_by_id(df: DataFrame, inputs: list[Column]) -> DataFrame:
    """(id, value, n): distinct values of every input expression, which must share a type.

    Inputs are numbered, which keeps the grouping key short. Counts are combined before the
    shuffle, so a value that fills most of a column arrives as one partial count per input split.
    """
    cells = [F.struct(F.lit(i).alias("id"), x.alias("value")) for i, x in enumerate(inputs)]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("id", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequency_table(df: DataFrame, columns: list[str], as_type: str = "string") -> DataFrame:
    """(column, value, n) with one row per distinct value, NULL included."""
    pick = as_double if as_type == "double" else present
    counts = value_counts_by_id(df, [pick(df, c).cast(as_type) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.get(names, F.col("id")).alias("column"), "value", "n")


class _Counts:
    """Distinct pairs of hashes, sorted, with their counts."""

    def __init__(self, h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> None:
        order = np.argsort(h, kind="stable")
        if len(h) and ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
            order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        start = np.flatnonzero(new)
        self.h, self.g = h[start], g[start]
        self.n = np.diff(start, append=len(h)) if n is None else np.add.reduceat(n[order], start) if len(start) else n

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> _Counts:
        tables = [np.frombuffer(p, np.int64).reshape(3, -1) for p in parts]
        return cls(*(np.concatenate([t[k] for t in tables]) for k in range(3)))

    def packed(self, part: slice) -> bytes:
        return np.concatenate([self.h[part], self.g[part], self.n[part].astype(np.int64)]).tobytes()


def _count_cells(width: int, buckets: int):
    """Each task's distinct cells as one batch for each column and range of hashes; column ``width`` counts the rows."""
    schema = pa.schema([("id", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table, rows = pa.Table.from_batches(held), []
            for i in range(width):
                h, g = (table.column(2 * i + k).drop_null().to_numpy() for k in (0, 1))
                found = _Counts(h, g)
                cuts = np.searchsorted((found.h >> 32) + (1 << 31), [-(-b * (1 << 32) // buckets) for b in range(buckets + 1)])
                rows += [{"id": i, "bucket": b, "packed": found.packed(slice(s, e))} for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if s < e]
            rows.append({"id": width, "bucket": 0, "packed": np.array([0, 0, table.num_rows], np.int64).tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows * width >= CELLS_AT_ONCE:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return count


def _merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct cells and their number for each column and range, with the most frequent ones."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64()), ("n_unique", pa.int64()), ("best", pa.int64()), ("n_tied", pa.int64()), ("tied", pa.binary())])

    def merged(key: tuple[int, int], parts: list[bytes]) -> pa.RecordBatch:
        found = _Counts.unpacked(parts)
        best = int(found.n.max())
        tied = found.n == best
        row = {"id": key[0], "n": int(found.n.sum()), "n_unique": len(found.n), "best": best, "n_tied": int(tied.sum())}
        return pa.RecordBatch.from_pylist([row | {"tied": np.column_stack([found.h[tied], found.g[tied]]).tobytes()}], schema)

    current, parts = None, []
    for batch in batches:
        for i, bucket, packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (i, bucket) != current and parts:
                yield merged(current, parts)
                parts = []
            current = (i, bucket)
            parts.append(packed)
    if parts:
        yield merged(current, parts)


def _cell_counts(df: DataFrame, inputs: list[Column]) -> DataFrame:
    """``(id, n, n_unique, best, n_tied, tied)``: a row for each input and range of hashes; the last id counts the rows.

    Values travel as 128-bit hashes with their counts, packed: a task sends a batch for each column and range, not a row
    for each cell, and no text.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.when(x.isNotNull(), h).alias(f"{k}{i}") for i, x in enumerate(inputs) for k, h in (("h", F.xxhash64(x)), ("g", F.xxhash64(F.lit(1), x)))]
    sent = df.select(*hashed).mapInArrow(_count_cells(len(inputs), buckets), "id int, bucket int, packed binary")
    together = sent.repartition("id", "bucket").sortWithinPartitions("id", "bucket")
    return together.mapInArrow(_merge_cells, "id int, n long, n_unique long, best long, n_tied long, tied binary")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique) without missing values, for columns of any type."""
    names = F.array(*[F.lit(c) for c in columns])
    counts = _cell_counts(df, [present(df, c) for c in columns]).groupBy("id").agg(F.sum("n_unique").alias("n_unique"))
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("id"))
    return every.join(counts, "id", "left").select(F.get(names, F.col("id")).alias("column"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def _unpack_tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, tied in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pairs = np.frombuffer(tied.as_buffer(), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), i, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "h", "g"])


def _smallest_tied(df: DataFrame, inputs: list[Column], counts: DataFrame, best: dict[int, Row]) -> dict[int, str]:
    """The smallest of each input's most frequent texts.

    Where all values of an input are equally frequent it is the smallest of all. Else the tied hashes pick the rows: they
    are compared or broadcast if they are few, or meet the beginnings of the texts, of which those that begin like the
    smallest one are looked at again, further on, until one ends.
    """
    pair = lambda i: (F.xxhash64(inputs[i]), F.xxhash64(F.lit(1), inputs[i]))
    texts = lambda ids, upto: F.inline(F.array(*[F.struct(F.lit(i).alias("id"), pair(i)[0].alias("h"), pair(i)[1].alias("g"), upto(i).alias("v")) for i in ids]))
    smallest = lambda rows: {r["id"]: r["v"] for r in rows.groupBy("id").agg(F.min("v").alias("v")).collect()}
    out: dict[int, str] = {}
    at_once, few, many = {}, {}, []
    for i, r in best.items():
        tied = np.frombuffer(b"".join(map(bytes, r["tied"])), np.int64).reshape(-1, 2).tolist()
        if r["n_tied"] == r["n_unique"]:
            at_once[i] = inputs[i]
        elif r["n_tied"] > FEW_TIED:
            many.append(i)
        elif len(tied) > COMPARED:
            few[i] = tied
        else:
            h, g = pair(i)
            found = reduce(Column.__or__, [(h == x) & (g == y) for x, y in tied])
            at_once[i] = F.when(found, inputs[i])
    if at_once:
        row = df.agg(*[F.min(x).alias(f"v{i}") for i, x in at_once.items()]).first()
        out |= {i: row[f"v{i}"] for i in at_once}
    spark = df.sparkSession
    for at in range(0, len(few), COLUMNS_AT_ONCE):  # so many broadcast rows at most
        some = dict(list(few.items())[at : at + COLUMNS_AT_ONCE])
        tied = spark.createDataFrame([(i, *p) for i, pairs in some.items() for p in pairs], "id int, h long, g long")
        out |= smallest(df.select(texts(some, lambda i: inputs[i])).join(F.broadcast(tied), ["id", "h", "g"], "left_semi"))
    if many:
        levels = spark.createDataFrame([(i, best[i]["best"]) for i in many], "id int, best long")
        tied = stage_table(counts.join(F.broadcast(levels), ["id", "best"]).select("id", "tied").mapInArrow(_unpack_tied, "id int, h long, g long"))
    seen, size = dict.fromkeys(many, ""), FIRST_CHARACTERS
    while many:
        begins = lambda i: F.when(F.startswith(inputs[i], F.lit(seen[i])), F.substring(inputs[i], 1, size))  # noqa: E731, B023
        rows = df.select(texts(many, begins)).where("v IS NOT NULL").distinct()
        seen = smallest(rows.join(tied, ["id", "h", "g"], "left_semi"))
        # A beginning shorter than was asked for is a whole text.
        out |= {i: v for i, v in seen.items() if len(v) < size}
        many, size = [i for i in many if i not in out], 4 * size
    return out


def summarise_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, missing, distinct values (as texts) and the smallest most frequent one, with its count."""
    inputs = [present(df, c).cast("string") for c in columns]
    counts = _cell_counts(df, inputs)
    of_input = Window.partitionBy("id")
    top = counts.select("id", "best", "n_tied", "tied", F.sum("n").over(of_input).alias("n"), F.sum("n_unique").over(of_input).alias("n_unique"), F.max("best").over(of_input).alias("_top"))
    level = top.where(F.col("best") == F.col("_top")).withColumn("_tied", F.sum("n_tied").over(of_input))
    known = F.when((F.col("_tied") <= FEW_TIED) & (F.col("_tied") < F.col("n_unique")), F.col("tied"))
    rows = level.groupBy("id", "n", "n_unique", "best").agg(F.sum("n_tied").alias("n_tied"), F.collect_list(known).alias("tied"))
    found = {r["id"]: r for r in rows.collect()}  # one row for each column, with few hashes
    n_rows = found.pop(len(columns))["n"] if len(columns) in found else 0
    modes_ = _smallest_tied(df, inputs, counts, found)
    out = []
    for i, c in enumerate(columns):
        r = found.get(i)
        out.append((c, n_rows, n_rows - (r["n"] if r else 0), r["n_unique"] if r else 0, modes_.get(i), r["best"] if r else 0))
    return df.sparkSession.createDataFrame(out, "column string, n_rows bigint, n_missing bigint, n_unique bigint, mode string, mode_count bigint")


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The smallest most frequent value of each column as text."""
    if not columns:
        return {}
    return {r["column"]: r["mode"] for r in summarise_texts(df, columns).collect()}
