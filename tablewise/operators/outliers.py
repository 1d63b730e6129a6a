"""Outlier treatment by interquartile-range bounds or by an isolation forest."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..schema import as_double, column_roles
from .clean import ACTION_SCHEMA, Action

FENCE = 1.5  # fixed value: width of the fences in interquartile ranges
OUTLIER_SCHEMA = (
    "column string, q1 double, q3 double, lower double, upper double, n_outliers bigint"
)


@dataclass
class Bounds:
    q1: float
    median: float
    q3: float
    lower: float
    upper: float

    def mask(self, x: Column) -> Column:
        return (x < self.lower) | (x > self.upper)


@dataclass
class TreatResult:
    table: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    log: list[Action] = field(default_factory=list)

    @property
    def actions(self) -> DataFrame:
        return self.table.sparkSession.createDataFrame(list(dict.fromkeys(self.log)), ACTION_SCHEMA)


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Unknown and non-numeric columns are skipped."""
    roles = column_roles(df)
    return [c for c in dict.fromkeys(columns) if roles.get(c) == "numeric"]


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, Bounds]:
    """Fences of every column that has values, from exact quartiles of the whole column."""
    columns = usable_columns(df, columns)
    quartiles = exact_quantiles(df, {c: as_double(df, c) for c in columns}, [0.25, 0.5, 0.75])
    bounds = {}
    for c, (q1, median, q3) in quartiles.items():
        if q1 is not None:
            spread = FENCE * (q3 - q1)
            bounds[c] = Bounds(q1, median, q3, q1 - spread, q3 + spread)
    return bounds


def outlier_mask(df: DataFrame, column: str, bounds: Bounds | None = None) -> Column:
    """True strictly outside the fences; never for missing values or non-numeric columns."""
    if bounds is None:
        bounds = iqr_bounds(df, [column]).get(column)
    if bounds is None:
        return F.lit(False)
    return F.coalesce(bounds.mask(as_double(df, column)), F.lit(False))


def outlier_counts(df: DataFrame, bounds: dict[str, Bounds]) -> dict[str, int]:
    if not bounds:
        return {}
    row = df.agg(
        *[F.count_if(b.mask(as_double(df, c))).alias(f"n{i}") for i, (c, b) in enumerate(bounds.items())]
    ).first()
    return {c: row[i] for i, c in enumerate(bounds)}


def outlier_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, q1, q3, lower, upper, n_outliers), one row per usable column."""
    bounds = iqr_bounds(df, columns)
    counts = outlier_counts(df, bounds)
    rows = [(c, b.q1, b.q3, b.lower, b.upper, counts[c]) for c, b in bounds.items()]
    return df.sparkSession.createDataFrame(rows, OUTLIER_SCHEMA)


def _capped(df: DataFrame, column: str, b: Bounds) -> Column:
    x = as_double(df, column)
    return F.when(x < b.lower, F.lit(b.lower)).when(x > b.upper, F.lit(b.upper)).otherwise(x)


def iqr_cap(df: DataFrame, columns: list[str]) -> TreatResult:
    """Clip to the fences; columns without outliers keep their type and values."""
    bounds = iqr_bounds(df, columns)
    counts = outlier_counts(df, bounds)
    hit = {c: b for c, b in bounds.items() if counts[c]}
    table = df.withColumns({c: _capped(df, c, b) for c, b in hit.items()}) if hit else df
    log: list[Action] = [
        ("outliers", c, "iqr_cap", counts[c], f"[{b.lower!r}, {b.upper!r}]") for c, b in hit.items()
    ]
    return TreatResult(table, counts, log)


def iqr_remove(df: DataFrame, columns: list[str]) -> TreatResult:
    """Drop rows outside the fences of any column; all fences come from the input table."""
    bounds = iqr_bounds(df, columns)
    if not bounds:
        return TreatResult(df)
    counts = outlier_counts(df, bounds)
    flagged = reduce(or_, [outlier_mask(df, c, b) for c, b in bounds.items()])
    log: list[Action] = [("outliers", c, "iqr_remove", n, None) for c, n in counts.items() if n]
    return TreatResult(df.where(~flagged), counts, log)


def treat_outliers(
    df: DataFrame,
    columns: list[str],
    method: str = "iqr",
    action: str = "cap",
    contamination: float = 0.05,
    keys: list[str] | None = None,
) -> TreatResult:
    """Dispatch to a treatment. ``action='none'`` or an empty column list leaves the table as is."""
    if not columns or action == "none":
        return TreatResult(df)
    if action not in ("cap", "remove"):
        raise ValueError(f"Unknown action: {action!r}")
    if method == "iqr":
        return iqr_cap(df, columns) if action == "cap" else iqr_remove(df, columns)
    if method != "isolation_forest":
        raise ValueError(f"Unknown method: {method!r}")

    from .isolation import flag_isolated

    usable = usable_columns(df, columns)
    if not usable:
        return TreatResult(df)
    flagged = flag_isolated(df, usable, contamination=contamination, keys=keys)
    n = flagged.where("is_outlier").count()
    counts = {"multivariate_isolation_forest": n}
    if n == 0:
        return TreatResult(df, counts)
    if action == "remove":
        log: list[Action] = [("outliers", None, "isolation_forest_remove", n, str(contamination))]
        table = flagged.where(~F.col("is_outlier")).drop("isolation_score", "is_outlier")
        return TreatResult(table, counts, log)
    # Multivariate flags give no bounds to clip to, so every column is clipped to its fences.
    bounds = iqr_bounds(df, usable)
    table = df.withColumns({c: _capped(df, c, b) for c, b in bounds.items()})
    log = [("outliers", c, "iqr_cap", n, f"[{b.lower!r}, {b.upper!r}]") for c, b in bounds.items()]
    return TreatResult(table, counts, log)
