"""Cleaning: duplicate rows, numbers stored as text, missing values."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.frequency import modes
from ..functions.parse import text_to_number
from ..functions.quantiles import exact_quantiles
from ..functions.staging import stage_table
from ..schema import as_double, categorical_columns, col, column_roles, normalise_missing, numeric_columns, present
from .audit import anomalous_columns

NUMERIC_PER_SLICE = 8
SKEW_LIMIT = 1.0  # fixed value: beyond this |skewness| the median fills instead of the mean
ACTION_SCHEMA = "step string, column string, action string, n_affected bigint, value string"

Action = tuple[str, str | None, str, int, str | None]


@dataclass
class CleanResult:
    """A lazily evaluated cleaned table and the actions that produced it."""

    table: DataFrame
    log: list[Action] = field(default_factory=list)

    @property
    def actions(self) -> DataFrame:
        rows = list(dict.fromkeys(self.log))
        return self.table.sparkSession.createDataFrame(rows, ACTION_SCHEMA)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that differ somewhere; missing cells are equal, whether NULL or NaN, and leave as NULL."""
    return normalise_missing(df).dropDuplicates()


def convert_numeric_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace flagged text columns by the numbers they spell; the rest becomes missing."""
    columns = anomalous_columns(df) if columns is None else columns
    return df.withColumns({c: text_to_number(col(c)) for c in columns}) if columns else df


@dataclass
class NumericFill:
    n_missing: int
    skewness: float | None
    strategy: str
    value: float | None


@dataclass
class ColumnProfile:
    """What imputation needs to know, from one aggregate over all columns."""

    n_rows: int
    missing: dict[str, int]
    means: dict[str, float | None]
    skewness: dict[str, float | None]

    @classmethod
    def of(cls, df: DataFrame, numeric: list[str], categorical: list[str]) -> ColumnProfile:
        # Slices stay below the size the JVM compiles as one method; their union is one job.
        slices = []
        for start in range(0, max(len(numeric), 1), NUMERIC_PER_SLICE):
            part = numeric[start : start + NUMERIC_PER_SLICE]
            cells = [_moment_cell(as_double(df, c), c) for c in part]
            if start == 0:
                cells.append(_count_cell(F.count(F.lit(1)), None))
                cells += [_count_cell(F.count(present(df, c)), c) for c in categorical]
            slices.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
        found = {r["column"]: r for r in reduce(DataFrame.unionAll, slices).collect()}
        n = found[None]["n"]
        missing = {c: n - found[c]["n"] for c in [*numeric, *categorical]}
        skewness = {c: _sample_skewness(found[c]["n"], found[c]["g"]) for c in numeric}
        return cls(n, missing, {c: found[c]["mean"] for c in numeric}, skewness)


def _moment_cell(x: Column, name: str) -> Column:
    return F.struct(
        F.lit(name).alias("column"),
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.skewness(x).alias("g"),
    )


def _count_cell(n: Column, name: str | None) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(
        F.lit(name).cast("string").alias("column"), n.alias("n"), nothing.alias("mean"), nothing.alias("g")
    )


def _sample_skewness(n: int, g: float | None) -> float | None:
    return (g or 0.0) * math.sqrt(n * (n - 1)) / (n - 2) if n >= 3 else None


def numeric_fills(
    df: DataFrame, strategy: str, columns: list[str], profile: ColumnProfile
) -> dict[str, NumericFill]:
    """Fill values of the numeric columns that have missing cells.

    Exact medians are searched only for the columns that need one.
    """
    fills: dict[str, NumericFill] = {}
    for c in columns:
        skew = profile.skewness[c]
        if profile.missing[c] == 0:
            continue
        chosen = strategy if strategy in ("mean", "median") else "mean"
        if strategy == "skew_based" and skew is not None and abs(skew) > SKEW_LIMIT:
            chosen = "median"
        fills[c] = NumericFill(profile.missing[c], skew, chosen, profile.means[c])
    by_median = [c for c, f in fills.items() if f.strategy == "median"]
    medians = exact_quantiles(df, {c: as_double(df, c) for c in by_median}, [0.5])
    for c in by_median:
        fills[c].value = medians[c][0]
    return fills


def _filled(df: DataFrame, name: str, value: float | None) -> Column:
    x = as_double(df, name)
    return x if value is None else F.coalesce(x, F.lit(float(value)))


def impute_numeric(
    df: DataFrame,
    strategy: str = "skew_based",
    columns: list[str] | None = None,
    profile: ColumnProfile | None = None,
) -> CleanResult:
    """Fill missing numbers by mean or median; ``skew_based`` picks by skewness.

    A filled column becomes double; a column without any value stays missing.
    """
    columns = numeric_columns(df) if columns is None else columns
    profile = profile or ColumnProfile.of(df, columns, [])
    fills = numeric_fills(df, strategy, columns, profile)
    log: list[Action] = [
        ("impute_numeric", c, f.strategy, f.n_missing, repr(f.value))
        for c, f in fills.items()
        if f.value is not None
    ]
    table = df.withColumns({c: _filled(df, c, f.value) for c, f in fills.items()}) if fills else df
    return CleanResult(table, log)


def impute_categorical(
    df: DataFrame,
    strategy: str = "mode",
    columns: list[str] | None = None,
    profile: ColumnProfile | None = None,
) -> CleanResult:
    """Fill missing categories by the mode (``Unknown`` if there is none) or by ``Missing``.

    The constants are text, so boolean and temporal columns are filled by their mode only.
    """
    columns = categorical_columns(df) if columns is None else columns
    profile = profile or ColumnProfile.of(df, [], columns)
    missing = {c: profile.missing[c] for c in columns if profile.missing[c]}
    roles = column_roles(df)
    if strategy == "mode":
        values = modes(df, list(missing))
        values = {
            c: ("Unknown" if v is None and roles[c] == "string" else v) for c, v in values.items()
        }
    else:
        values = {c: "Missing" if roles[c] == "string" else None for c in missing}
    filled: dict[str, Column] = {}
    log: list[Action] = []
    for c, v in values.items():
        if v is not None:
            filled[c] = F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType))
            log.append(("impute_categorical", c, strategy, missing[c], v))
    return CleanResult(df.withColumns(filled) if filled else df, log)


def clean_table(
    df: DataFrame,
    impute_num: str = "skew_based",
    impute_cat: str = "mode",
    convert_anomalies: bool = True,
    remove_duplicates: bool = True,
) -> CleanResult:
    """Drop duplicate rows, correct numeric text, then fill missing numbers and categories.

    The deduplicated table is staged because the aggregates and the result all read it; what
    follows is one lazy projection over it.
    """
    log: list[Action] = []
    table = stage_table(drop_duplicate_rows(_storable(df))) if remove_duplicates else df
    converted: list[Action] = []
    if convert_anomalies:
        flagged = anomalous_columns(table)
        table = convert_numeric_text(table, flagged)
    numeric, categorical = numeric_columns(table), categorical_columns(table)
    profile = ColumnProfile.of(table, numeric, categorical)
    if convert_anomalies:  # cells that became numbers
        converted = [("convert_text", c, "to_number", profile.n_rows - profile.missing[c], None) for c in flagged]
    removed = df.count() - profile.n_rows if remove_duplicates else 0
    if removed:
        log.append(("deduplicate", None, "drop", removed, None))
    numbers = impute_numeric(table, impute_num, numeric, profile)
    # Numeric fills leave the categories as they were, so their modes are read from ``table``.
    texts = impute_categorical(table, impute_cat, categorical, profile)
    fills = {
        c: F.coalesce(col(c), F.lit(v).cast(table.schema[c].dataType))
        for _, c, _, _, v in texts.log
    }
    result = numbers.table.withColumns(fills) if fills else numbers.table
    return CleanResult(result, log + converted + numbers.log + texts.log)


def _storable(df: DataFrame) -> DataFrame:
    """Columns of the untyped NULL type cannot be written; read them as text."""
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.withColumns({c: col(c).cast("string") for c in void}) if void else df
