"""Pearson and Spearman correlations of all numeric column pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rank_scatter import rank_correlations
from ..schema import as_double, numeric_columns

TOP_PAIRS = 5  # fixed value
CONSTANT = 1e-14  # a deviation below this share of the mean is rounding
GUESS_ROWS = 256  # rows from which numbers near the columns are guessed
FAR = 1e4  # a mean this many variances away takes the guess's place
NATIVE_COLUMNS = 5  # up to this width one compiled aggregate holds all pairs
SCHEMA = "var1 string, var2 string, correlation double, abs_correlation double"

Pairs = dict[tuple[str, str], float | None]


def _first_guess(values: DataFrame) -> np.ndarray:
    """Numbers near the columns: the means of a few rows. They keep the sums small and don't change them otherwise."""
    rows = values.limit(GUESS_ROWS).collect()
    filled = [[x for x in column if x is not None and math.isfinite(x)] for column in zip(*rows, strict=True)] or [[]] * len(values.columns)
    return np.array([sum(x) / len(x) if x else 0.0 for x in filled])


def _native(values: DataFrame, names: list[str]) -> Pairs:
    """The coefficients of few columns from one compiled aggregate; each pair's deviations are those of its common rows."""
    pairs = list(combinations(range(len(names)), 2))
    spread = lambda i, j: F.stddev_pop(F.when(F.col(f"x{j}").isNotNull(), F.col(f"x{i}")))
    cells = [c for i, j in pairs for c in (F.covar_pop(f"x{i}", f"x{j}"), spread(i, j), spread(j, i))]
    row = values.agg(*[c.alias(f"r{k}") for k, c in enumerate(cells)]).first()
    out: Pairs = {}
    for k, (i, j) in enumerate(pairs):
        together, a, b = row[3 * k : 3 * k + 3]
        r = together / a / b if a and b else math.nan
        out[names[i], names[j]] = max(-1.0, min(1.0, r)) if math.isfinite(r) else None
    return out


def _products(shift: np.ndarray):
    """Sums over the rows of a task, for each column a and all columns b: of filled pairs, and with a less its shift, of a, a*a and a*b."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(shift)
        sums = np.zeros((4, width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                filled = ~np.isnan(raw)
                x = np.where(filled, raw - shift, 0.0)
                mask = filled.astype(float)
                for total, left, right in zip(sums, (mask, x, x * x, x), (mask, mask, mask, x), strict=True):
                    total += left.T @ right
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in sums)], ["a", "n", "s", "q", "p"]
        )

    return products


def _sums(values: DataFrame, shift: np.ndarray) -> np.ndarray:
    width = len(shift)
    sums = values.mapInArrow(_products(shift), "a int, n array<double>, s array<double>, q array<double>, p array<double>")
    cells = sums.select("a", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("b", "t"))
    total = np.zeros((4, width, width))
    for r in cells.groupBy("a", "b").agg(*[F.sum(f"t.{k}").alias(k) for k in "nsqp"]).collect():  # columns squared
        total[:, r["a"], r["b"]] = r["n"], r["s"], r["q"], r["p"]
    return total


def pearson_values(df: DataFrame, inputs: dict[str, Column]) -> Pairs:
    """Pairwise-complete Pearson coefficients; ``None`` where a column does not vary.

    Both ways work with deviations from a number near the column: Spark's aggregate with those from the running mean, for
    few columns; for many, a pass adds up the products of all pairs, less numbers near the columns, over the rows that
    both columns fill. Where a number proves far from its column, the column's mean takes its place and the pass is
    repeated. Only matrices of the columns' number leave a task.
    """
    names = list(inputs)
    if len(names) < 2:
        return {}
    values = df.select(*[inputs[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    shift = _first_guess(values)
    if len(names) <= NATIVE_COLUMNS:
        return _native(values.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(values.columns, shift, strict=True)]), names)
    for _ in range(3):
        n, s, q, p = _sums(values, shift)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = s / n
            variance = q / n - off**2
            own, spread = np.diag(off), np.diag(variance)
            far = np.isfinite(own) & (own**2 > FAR * np.maximum(spread, 0)) & (np.abs(own) > CONSTANT * np.abs(shift))
        if not far.any():
            break
        shift = np.where(far, shift + own, shift)
    with np.errstate(divide="ignore", invalid="ignore"):
        deviation = np.sqrt(np.maximum(variance, 0))
        varies = deviation > CONSTANT * np.abs(shift[:, None] + off)
        ratio = (p / n - off * off.T) / (deviation * deviation.T)
    out: Pairs = {}
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        known = n[i, j] > 0 and varies[i, j] and varies[j, i] and np.isfinite(ratio[i, j])
        out[(a, b)] = float(np.clip(ratio[i, j], -1.0, 1.0)) if known else None
    return out


def spearman_values(df: DataFrame, inputs: dict[str, Column]) -> Pairs:
    """Spearman coefficients; each pair is ranked on the rows that both columns fill. ``None`` where a column does not vary."""
    names = list(inputs)
    if len(names) < 2:
        return {}
    found = rank_correlations(df, [inputs[c].cast("double") for c in names])
    return {(a, b): None if np.isnan(found[i, j]) else float(found[i, j]) for (i, a), (j, b) in combinations(enumerate(names), 2)}


def correlations(
    df: DataFrame, method: str = "pearson", columns: list[str] | None = None
) -> DataFrame:
    """(var1, var2, correlation, abs_correlation) of every pair that has a coefficient."""
    columns = numeric_columns(df) if columns is None else columns
    if method not in ("pearson", "spearman"):
        raise ValueError(f"Unknown method: {method!r}")
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    if method == "pearson":
        values = pearson_values(df, {c: as_double(df, c) for c in columns})
    else:
        values = spearman_values(df, {c: as_double(df, c) for c in columns})
    rows = [(a, b, r, abs(r)) for (a, b), r in values.items() if r is not None]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def top_correlations(pairs: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """The ``k`` strongest pairs; ties by name."""
    return pairs.orderBy(F.desc("abs_correlation"), "var1", "var2").limit(k)


def correlation_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Square form of a pair table: one row and one column per variable, 1 on the diagonal."""
    both = pairs.select("var1", "var2", "correlation").unionAll(
        pairs.select(F.col("var2"), F.col("var1"), "correlation")
    )
    spark = pairs.sparkSession
    same = spark.createDataFrame([(c, c, 1.0) for c in columns], "var1 string, var2 string, correlation double")
    return (
        both.unionAll(same)
        .groupBy(F.col("var1").alias("column"))
        .pivot("var2", columns)
        .agg(F.first("correlation"))
    )
