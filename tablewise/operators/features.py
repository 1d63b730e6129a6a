"""Task detection and feature selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.frequency import distinct_counts
from ..functions.slices import sliced_aggregate
from ..schema import col, column_roles, present, require_columns

# Fixed values.
MAX_MISSING = 0.9
ID_SHARE = 0.95
ID_SIZE = 50
MAX_CLASSES = 10

SELECTION_SCHEMA = (
    "column string, missing_pct double, n_unique bigint, kept boolean, reason string"
)


def detect_task_type(df: DataFrame, target: str | None) -> str:
    """Clustering without a target; a number with more than 10 values is a regression target.

    A sketch far above 10 settles the question without a shuffle (up to 10 values occupy at most
    10 of its registers, so it cannot overstate them that much); otherwise the values are few and
    are counted exactly.
    """
    if not target:
        return "clustering"
    require_columns(df, target)
    values = df.select(present(df, target).alias("v")).where("v IS NOT NULL")
    n, estimate = values.agg(F.count("v"), F.approx_count_distinct("v")).first()
    if n == 0:
        raise ValueError(f"Target {target!r} has no values.")
    if column_roles(df)[target] != "numeric":
        return "classification"
    if estimate > 100 * MAX_CLASSES:
        return "regression"
    return "classification" if values.distinct().count() <= MAX_CLASSES else "regression"


def task_types(df: DataFrame, targets: list[str]) -> DataFrame:
    """(target, task_type) for several candidate targets."""
    rows = [(t, detect_task_type(df, t)) for t in targets]
    return df.sparkSession.createDataFrame(rows, "target string, task_type string")


@dataclass
class FeatureVerdict:
    column: str
    missing_share: float
    n_unique: int
    reason: str | None


def judge_features(df: DataFrame, columns: list[str] | None = None) -> list[FeatureVerdict]:
    """Why each column is dropped, if it is: too empty, constant, or an identifier."""
    roles = column_roles(df)
    columns = [c for c in (columns or df.columns) if roles[c] != "complex"]
    if not columns:
        return []
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count(present(df, c)).alias("filled")) for c in columns]
    found = {r["column"]: r for r in sliced_aggregate(df, cells).collect()}
    unique = {r["column"]: r["n_unique"] for r in distinct_counts(df, columns).collect()}
    verdicts = []
    for c in columns:
        n = found[c]["n"]
        missing = 1.0 - found[c]["filled"] / n if n else 0.0
        n_unique = unique[c]
        reason = None
        if missing > MAX_MISSING:
            reason = "too many missing values"
        elif n_unique <= 1:
            reason = "single unique value"
        elif roles[c] == "string" and n_unique / n > ID_SHARE and n_unique > ID_SIZE:
            reason = "looks like an identifier"
        verdicts.append(FeatureVerdict(c, missing, n_unique, reason))
    return verdicts


def feature_selection(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column, missing_pct, n_unique, kept, reason) of every candidate feature."""
    columns = [c for c in df.columns if c != target]
    rows = [
        (v.column, round(100.0 * v.missing_share, 6), v.n_unique, v.reason is None, v.reason)
        for v in judge_features(df, columns)
    ]
    return df.sparkSession.createDataFrame(rows, SELECTION_SCHEMA)


def select_features(df: DataFrame, target: str | None = None) -> DataFrame:
    kept = [v.column for v in judge_features(df, [c for c in df.columns if c != target]) if not v.reason]
    return df.select(*[col(c) for c in kept], *([col(target)] if target else []))
