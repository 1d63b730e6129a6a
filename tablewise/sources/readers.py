"""Table sources: CSV with single-pass typing, and Parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.parse import NUMBER
from ..schema import col, normalise_missing

# Cell texts read as missing, and the accepted integer and boolean texts.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER = r"^[+-]?\d+$"
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read CSV with a header; each column gets the narrowest type all its values fit.

    The types tried are bigint, double, boolean and string; dates stay text. One aggregate over
    the file decides for all columns. Set ``multi_line`` only for files with quoted line breaks,
    because such files cannot be split between tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    texts = raw.withColumns({c: _token_to_null(col(c)) for c in raw.columns})
    exprs = []
    for i, c in enumerate(raw.columns):
        exprs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(_integer(col(c))).alias(f"i{i}"),
            F.count(_number(col(c))).alias(f"f{i}"),
            F.count(_boolean(col(c))).alias(f"b{i}"),
        ]
    counts = texts.agg(*exprs).first()
    typed: dict[str, Column] = {}
    for i, c in enumerate(raw.columns):
        n = counts[f"n{i}"]
        if n == 0:
            typed[c] = col(c).cast("double")
        elif counts[f"i{i}"] == n:
            typed[c] = _integer(col(c))
        elif counts[f"f{i}"] == n:
            typed[c] = _number(col(c))
        elif counts[f"b{i}"] == n:
            typed[c] = _boolean(col(c))
    return texts.withColumns(typed) if typed else texts


def _token_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def _integer(c: Column) -> Column:
    return F.when(F.trim(c).rlike(INTEGER), F.trim(c).try_cast("bigint"))


def _number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))


def _boolean(c: Column) -> Column:
    return F.when(c.isin(TRUE_TOKENS), True).when(c.isin(FALSE_TOKENS), False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet with NaN as NULL; filters and column selection reach the scan."""
    return normalise_missing(spark.read.parquet(path))


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a table by the lower-cased file extension, or by ``fmt``; unknown means CSV."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind in ("parquet", "pq"):
        return read_parquet(spark, path)
    if kind in ("xlsx", "xls"):
        raise ValueError("Excel workbooks are not supported; export the sheet as CSV or Parquet.")
    return read_csv(spark, path)
