"""Narrower column types, decided from one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.frequency import distinct_counts
from ..functions.slices import sliced_aggregate
from ..schema import INTEGER_TYPES, col, present, string_columns

# Integer widths tried in order, the float range and the dictionary rule.
WIDTHS = (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))
FLOAT_MAX = 3.4028234663852886e38
DICTIONARY_SHARE = 0.5
DICTIONARY_SIZE = 1_000

ADVICE_SCHEMA = (
    "column string, from_type string, to_type string, min bigint, max bigint, "
    "n_unique bigint, dictionary_candidate boolean"
)


def _integer_width(low: int, high: int) -> str:
    """The first width whose bounds lie strictly outside the values."""
    for name, bits in WIDTHS:
        if -(1 << (bits - 1)) < low and high < (1 << (bits - 1)) - 1:
            return name
    return "bigint"


def _advice(df: DataFrame, narrow_floats: bool) -> list[tuple]:
    integers = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGER_TYPES)]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    texts = string_columns(df)
    n_rows = df.count()
    limits = {}
    for kind, columns in (("bigint", integers), ("double", doubles)):
        cells = [
            F.struct(F.lit(c).alias("column"), F.min(present(df, c)).cast(kind).alias("low"), F.max(present(df, c)).cast(kind).alias("high"))
            for c in columns
        ]
        if cells:
            limits.update({r["column"]: (r["low"], r["high"]) for r in sliced_aggregate(df, cells).collect()})
    unique: dict[str, int] = {}
    if texts:
        unique = {r["column"]: r["n_unique"] for r in distinct_counts(df, texts).collect()}
    out = []
    for field in df.schema.fields:
        c, from_type = field.name, field.dataType.simpleString()
        low = high = n_unique = None
        to_type, candidate = from_type, False
        if c in integers and limits[c][0] is not None:
            low, high = limits[c]
            to_type = _integer_width(low, high)
        elif c in doubles and narrow_floats and limits[c][0] is not None:
            if -FLOAT_MAX < limits[c][0] and limits[c][1] < FLOAT_MAX:
                to_type = "float"
        elif c in texts:
            n_unique = unique.get(c, 0)
            share = n_unique / n_rows if n_rows else 1.0
            candidate = share < DICTIONARY_SHARE and n_unique < DICTIONARY_SIZE
        out.append((c, from_type, to_type, low, high, n_unique, candidate))
    return out


def schema_advice(df: DataFrame, narrow_floats: bool = False) -> DataFrame:
    """Present and proposed type per column, and which text columns suit dictionary encoding."""
    return df.sparkSession.createDataFrame(_advice(df, narrow_floats), ADVICE_SCHEMA)


def tighten_schema(df: DataFrame, narrow_floats: bool = False) -> DataFrame:
    """Cast integers to the smallest type that holds them; doubles to float only on request."""
    casts = {c: col(c).cast(to) for c, frm, to, *_ in _advice(df, narrow_floats) if frm != to}
    return df.withColumns(casts) if casts else df
