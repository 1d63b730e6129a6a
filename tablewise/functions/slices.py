"""Aggregates over many columns, in slices that the JVM still compiles as one method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CELLS_PER_SLICE = 40


def sliced_aggregate(df: DataFrame, cells: list[Column]) -> DataFrame:
    """One row for each struct of aggregates; all slices are one job."""
    slices = [df.agg(F.array(*cells[i : i + CELLS_PER_SLICE]).alias("cells")) for i in range(0, len(cells), CELLS_PER_SLICE)]
    return reduce(DataFrame.unionAll, slices).select(F.inline("cells"))
