"""Data-quality audit: missing cells, duplicate rows, numbers stored as text, table figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.parse import percent, text_to_number
from ..functions.slices import sliced_aggregate
from ..schema import categorical_columns, col, column_roles, normalise_missing, numeric_columns, present, string_columns

ANOMALY_SHARE = 0.8  # fixed value: text columns above this numeric share are flagged

AUDIT_SCHEMA = (
    "column string, role string, dtype string, n_rows bigint, n_missing bigint, "
    "missing_pct double, is_type_anomaly boolean"
)


def missing_by_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing cells and their percentage per column, in one job."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(present(df, c).isNull()).alias("n_missing"))
        for c in df.columns
    ]
    out = sliced_aggregate(df, cells).withColumn("missing_pct", percent(F.col("n_missing"), F.col("n_rows")))
    return out.where("n_missing > 0") if only_missing else out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, and their percentage.

    Equal rows are counted together before the shuffle; missing cells are equal, NULL or NaN.
    """
    df = normalise_missing(df)
    per_row = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return per_row.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")
    ).select(
        "n_rows",
        (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
        percent(F.col("n_rows") - F.col("n_distinct"), F.col("n_rows")).alias("duplicate_pct"),
    )


def anomaly_rates(df: DataFrame) -> DataFrame:
    """For each text column, the share of non-missing values that parse as numbers."""
    columns = string_columns(df)
    schema = "column string, n_values bigint, parse_rate double, is_type_anomaly boolean"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    cells = [
        F.struct(F.lit(c).alias("column"), F.count(col(c)).alias("n_values"), F.count(text_to_number(col(c))).alias("_parsed"))
        for c in columns
    ]
    rate = F.coalesce(F.try_divide(F.col("_parsed"), F.col("n_values")), F.lit(0.0))
    return sliced_aggregate(df, cells).select("column", "n_values", rate.alias("parse_rate"), (rate > ANOMALY_SHARE).alias("is_type_anomaly"))


def anomalous_columns(df: DataFrame) -> list[str]:
    flagged = {r["column"] for r in anomaly_rates(df).where("is_type_anomaly").collect()}
    return [c for c in df.columns if c in flagged]


def audit_columns(df: DataFrame) -> DataFrame:
    """One row per column: role, type, missing cells and the numeric-text flag, in one job."""
    roles = column_roles(df)
    texts = string_columns(df)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(roles[c]).alias("role"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(present(df, c).isNull()).alias("n_missing"),
            (F.count(text_to_number(col(c))) if c in texts else F.lit(0).cast("long")).alias("_parsed"),
        )
        for c in df.columns
    ]
    share = F.try_divide(F.col("_parsed"), F.col("n_rows") - F.col("n_missing"))
    return sliced_aggregate(df, cells).select(
        "column",
        "role",
        "dtype",
        "n_rows",
        "n_missing",
        percent(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"),
        F.coalesce(share > ANOMALY_SHARE, F.lit(False)).alias("is_type_anomaly"),
    )


def audit_table(df: DataFrame) -> DataFrame:
    """Whole-table figures in one row.

    Rows, missing cells and duplicates come from one pass: equal rows are grouped once, and each
    group contributes its missing cells times its copies.
    """
    df = normalise_missing(df)
    width = len(df.columns)
    missing = sum((F.when(present(df, c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    grouped = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    totals = grouped.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(missing * F.col("_copies")), F.lit(0)).alias("n_missing"),
    )
    n_rows, duplicates = F.col("n_rows"), F.col("n_rows") - F.col("n_distinct")
    return totals.select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        (n_rows * width).alias("n_cells"),
        "n_missing",
        percent(F.col("n_missing"), n_rows * width).alias("missing_pct"),
        duplicates.alias("n_duplicates"),
        percent(duplicates, n_rows).alias("duplicate_pct"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("n_categorical"),
    )


def table_kpis(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Headline figures of the raw and the cleaned table side by side."""
    before = audit_table(raw).select(
        F.col("n_rows").alias("raw_rows"),
        F.col("n_duplicates").alias("duplicates_removed"),
        F.col("n_missing").alias("raw_missing_cells"),
    )
    missing = sum(
        (F.when(present(cleaned, c).isNull(), 1).otherwise(0) for c in cleaned.columns), F.lit(0)
    )
    after = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("missing_cells"),
    )
    # Both sides are single-row aggregates.
    both = after.withColumn("_one", F.lit(1)).join(before.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "rows",
        (F.col("rows") - F.col("raw_rows")).alias("rows_delta"),
        F.lit(len(cleaned.columns)).cast("bigint").alias("columns"),
        "duplicates_removed",
        "raw_missing_cells",
        "missing_cells",
    )
