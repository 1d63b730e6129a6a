"""Descriptive statistics and the data behind distribution charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import frequency
from ..functions.frequency import frequency_table, summarise_texts
from ..functions.moments import adjust_kurtosis, adjust_skewness
from ..functions.parse import percent
from ..functions.quantiles import exact_quantiles
from ..functions.staging import stage_table
from ..schema import (
    as_double,
    categorical_columns,
    col,
    numeric_columns,
    present,
    require_columns,
)
from .outliers import iqr_bounds

QUARTILES = [0.25, 0.5, 0.75]
MAX_PIVOT = 1_000  # widest crosstab spread over columns; the long form has no limit
#: Cells of a full grid, empty ones included, at most.
MAX_GRID = 100_000_000
COLUMNS_PER_JOB = 4


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max, skewness and excess kurtosis per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    schema = (
        "column string, count bigint, mean double, std double, min double, p25 double, "
        "p50 double, p75 double, max double, skewness double, kurtosis double"
    )
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    quartiles = exact_quantiles(df, {c: as_double(df, c) for c in columns}, QUARTILES)
    parts = []
    # Seven moments of many columns exceed what the JVM compiles as one method. Slices stay below
    # that, each reads its own columns, and their union still runs as one job.
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[start : start + COLUMNS_PER_JOB]
        raw = df.agg(F.array(*[_raw_moments(as_double(df, c), c) for c in part]).alias("rows"))
        parts.append(raw.select(F.inline("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # From here on there is one row per column, so the adjustments are evaluated once each.
    quartile = F.create_map(
        *[
            e
            for c in columns
            for e in (F.lit(c), F.array(*[F.lit(v).cast("double") for v in quartiles[c]]))
        ]
    )[F.col("column")]
    n = F.col("count").cast("double")
    return out.select(
        "column",
        "count",
        "mean",
        "std",
        "min",
        *[quartile[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))],
        "max",
        adjust_skewness(n, F.col("g")).alias("skewness"),
        adjust_kurtosis(n, F.col("k")).alias("kurtosis"),
    )


def _raw_moments(x: Column, name: str) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.skewness(x).alias("g"),
        F.kurtosis(x).alias("k"),
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, missing, distinct values and mode per categorical column.

    One count of all columns' hashes serves every figure; texts are read for the modes only. A column without values has the
    mode ``N/A`` with frequency 0.
    """
    columns = categorical_columns(df) if columns is None else columns
    schema = (
        "column string, data_type string, total_rows bigint, missing bigint, missing_pct double, "
        "unique_values bigint, mode string, mode_frequency bigint, mode_pct double"
    )
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    types = F.create_map(
        *[e for c in columns for e in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))]
    )
    return summarise_texts(df, columns).select(
        "column",
        types[F.col("column")].alias("data_type"),
        F.col("n_rows").alias("total_rows"),
        F.col("n_missing").alias("missing"),
        percent(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"),
        F.col("n_unique").alias("unique_values"),
        F.coalesce("mode", F.lit("N/A")).alias("mode"),
        F.col("mode_count").alias("mode_frequency"),
        percent(F.col("mode_count"), F.col("n_rows")).alias("mode_pct"),
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_unique) without missing values, from hashes of the values."""
    return frequency.distinct_counts(df, df.columns if columns is None else columns)


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, value) with exact, linearly interpolated quantiles."""
    found = exact_quantiles(df, {c: as_double(df, c) for c in columns}, probs)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) without missing values, most frequent first, ties by value."""
    require_columns(df, column)
    return (
        df.select(present(df, column).alias("value"))
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, count) over equal-width bins; empty bins included."""
    require_columns(df, column)
    x = as_double(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    schema = "bin int, lower double, upper double, count bigint"
    if lo is None:
        return df.sparkSession.createDataFrame([], schema)
    if lo == hi:
        return df.agg(F.count(x).alias("count")).select(
            F.lit(1).alias("bin"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), "count"
        )
    width = (hi - lo) / bins
    # The maximum belongs to the last bin.
    bucket = F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins))
    counts = (
        df.where(x.isNotNull())
        .select(F.least(bucket, F.lit(bins)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * width).alias("lower"),
        (F.lit(lo) + F.col("bin") * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whisker ends (the extreme values inside the fences) and outlier counts."""
    bounds = iqr_bounds(df, columns)
    rows = []
    for c, b in bounds.items():
        x = as_double(df, c)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(b.q1).alias("q1"),
                F.lit(b.median).alias("median"),
                F.lit(b.q3).alias("q3"),
                F.min(F.when(x >= b.lower, x)).alias("whisker_low"),
                F.max(F.when(x <= b.upper, x)).alias("whisker_high"),
                F.count_if(b.mask(x)).alias("n_outliers"),
            )
        )
    if not rows:
        raise ValueError("No numeric column with values to summarise.")
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table of the observed combinations of two columns."""
    require_columns(df, a, b)
    return (
        df.select(present(df, a).alias("a"), present(df, b).alias("b"))
        .na.drop()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab_wide(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table with one row per value of ``a`` and one column per value of ``b``.

    Combinations that never occur are 0. The values of ``b`` become columns, so there must be few (``MAX_PIVOT``); the
    long forms have no such limit.
    """
    cells = crosstab(df, a, b)
    levels = [r["b"] for r in cells.select("b").distinct().limit(MAX_PIVOT + 1).collect()]
    if len(levels) > MAX_PIVOT:
        raise ValueError(f"{b!r} has more than {MAX_PIVOT} values; use the long form.")
    levels.sort()
    wide = cells.groupBy("a").pivot("b", levels).agg(F.sum("n"))
    return wide.na.fill(0).withColumnRenamed("a", a)


def crosstab_full(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with the empty combinations as 0 rows: the grid of both columns' values.

    A grid of more than ``MAX_GRID`` cells is refused; ``crosstab`` has the cells that occur at any size.
    """
    cells = stage_table(crosstab(df, a, b))
    n_a, n_b = (cells.select(c).distinct().count() for c in ("a", "b"))
    if n_a * n_b > MAX_GRID:
        raise ValueError(f"{a!r} and {b!r} have {n_a} x {n_b} values; use the cells that occur.")
    grid = cells.select("a").distinct().crossJoin(cells.select("b").distinct())  # the result has these rows
    return grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def group_means(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, n, mean) on rows where both columns are present."""
    require_columns(df, category, value)
    return (
        df.select(present(df, category).alias("category"), as_double(df, value).alias("value"))
        .na.drop()
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    )


def column_options(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, option): the distinct values of categorical columns as text, sorted."""
    columns = categorical_columns(df) if columns is None else columns
    return (
        frequency_table(df, columns)
        .where("value IS NOT NULL")
        .select("column", F.col("value").alias("option"))
        .orderBy("column", "option")
    )


def numeric_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, median) of numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    found = exact_quantiles(df, {c: as_double(df, c) for c in columns}, [0.0, 0.5, 1.0])
    rows = [(c, found[c][0], found[c][2], found[c][1]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, max double, median double"
    )


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*[col(k) for k in keys]).limit(n)
