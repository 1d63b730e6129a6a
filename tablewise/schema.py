"""Column roles and the missing-value rule shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, STRING_TYPES):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, TEMPORAL_TYPES):
        return "temporal"
    return "complex"


def column_roles(df: DataFrame) -> dict[str, str]:
    """Map each column to numeric, string, boolean, temporal or complex; reads the schema only."""
    return {f.name: role_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, role in column_roles(df).items() if role == "numeric"]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything audited as a category: strings, booleans and temporal columns."""
    return [n for n, r in column_roles(df).items() if r in ("string", "boolean", "temporal")]


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, role in column_roles(df).items() if role == "string"]


def require_columns(df: DataFrame, *names: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"Unknown column(s): {', '.join(map(repr, unknown))}")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL, so that one test for missing covers both."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN read as NULL."""
    return present(df, name).cast("double")


def normalise_missing(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float and double column."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({n: present(df, n) for n in floats}) if floats else df


def role_summary(df: DataFrame) -> DataFrame:
    """One row per column: name, role, Spark type and whether it counts as numeric."""
    rows = [
        (f.name, role_of(f.dataType), f.dataType.simpleString(), role_of(f.dataType) == "numeric")
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, role string, dtype string, is_numeric boolean"
    )
