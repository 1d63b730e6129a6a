"""Date detection, resampling to a regular grid, gap filling and lag features.

A series is a table with ``keys`` (none for a single series), ``ts`` (the bin's label),
``position`` (0, 1, 2, ... along the grid) and ``y``. Rows are binned before anything else, so
windows only ever see one row per calendar bin and series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parse import date_format_rates, plain_number, text_to_timestamp
from ..functions.staging import stage_table
from ..schema import as_double, col, column_roles, require_columns, string_columns

# Fixed values.
DATE_SHARE = 0.8
MIN_POINTS = 5
MIN_SERIES = 6
N_LAGS = 3
FREQUENCIES = ("D", "W", "M")


def detect_date_columns(df: DataFrame) -> list[str]:
    """Temporal columns, and text columns of which more than 80 % parse as dates."""
    if df.limit(1).count() == 0:
        return []
    rates = date_format_rates(df, string_columns(df))
    roles = column_roles(df)
    return [
        c
        for c in df.columns
        if roles[c] == "temporal" or (c in rates and rates[c][1] > DATE_SHARE)
    ]


def date_column_rates(df: DataFrame) -> DataFrame:
    """(column, parse_rate, is_date) of every text column under its best date format."""
    rates = date_format_rates(df, string_columns(df))
    rows = [(c, float(r), r > DATE_SHARE) for c, (_, r) in rates.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, parse_rate double, is_date boolean"
    )


def calendar_day(df: DataFrame, column: str) -> Column:
    """The column as a date; text is parsed by the one format that fits most of its values."""
    role = column_roles(df)[column]
    if role == "temporal":
        return F.to_date(col(column))
    if role != "string":
        raise ValueError(f"{column!r} holds neither dates nor text.")
    fmt, _ = date_format_rates(df, [column])[column]
    if fmt is None:
        return F.lit(None).cast("date")
    return F.to_date(text_to_timestamp(col(column), fmt))


def _bin_start(day: Column, freq: str) -> Column:
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")  # the Sunday that ends the week
    return F.trunc(day, "MM")


def _step_back(start: Column, freq: str) -> Column:
    return {"D": F.date_sub(start, 1), "W": F.date_sub(start, 7), "M": F.add_months(start, -1)}[freq]


def _label(start: Column, freq: str) -> Column:
    return F.last_day(start) if freq == "M" else start


def _steps_between(first: Column, start: Column, freq: str) -> Column:
    if freq == "M":
        return F.months_between(start, first).cast("bigint")
    return (F.datediff(start, first) / (7 if freq == "W" else 1)).cast("bigint")


def future_label(ts: Column, steps: Column, freq: str) -> Column:
    """The label ``steps`` bins after ``ts``."""
    if freq == "M":
        return F.last_day(F.add_months(ts, steps.cast("int")))
    return F.date_add(ts, (steps * (7 if freq == "W" else 1)).cast("int"))


def series_window(keys: list[str]):
    """All windows over a series are partitioned by its keys; a single series is its bins only."""
    return Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)]))


def resample_grid(
    df: DataFrame,
    date_col: str,
    target_col: str,
    freq: str = "D",
    agg_func: str = "mean",
    keys: list[str] | None = None,
) -> DataFrame:
    """Aggregate to a dense grid: (keys, ts, position, y, n_points), gaps not yet filled.

    Every observed bin also emits the empty bins up to the next one, so no join with a calendar
    is needed. Empty bins are 0 for ``sum`` and NULL otherwise.
    """
    keys = keys or []
    require_columns(df, date_col, target_col, *keys)
    if freq not in FREQUENCIES:
        raise ValueError(f"Unknown frequency: {freq!r}")
    numeric = column_roles(df)[target_col] == "numeric"
    y = as_double(df, target_col) if numeric else plain_number(F.trim(col(target_col).cast("string")))
    rows = df.select(
        *[col(k) for k in keys],
        _bin_start(calendar_day(df, date_col), freq).alias("_bin"),
        y.alias("_y"),
    ).na.drop(subset=["_bin", "_y"])
    total = F.sum("_y") if agg_func == "sum" else F.avg("_y")
    binned = rows.groupBy(*[col(k) for k in keys], "_bin").agg(
        total.alias("_y"), F.count(F.lit(1)).alias("_n")
    )
    w = series_window(keys)
    after = F.lead("_bin").over(w.orderBy("_bin"))
    spread = binned.withColumns(
        {
            "_until": F.coalesce(_step_back(after, freq), F.col("_bin")),
            "_first": F.min("_bin").over(w),
        }
    )
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}[freq]
    grid = spread.withColumn("_at", F.explode(F.sequence("_bin", "_until", F.expr(step))))
    seen = F.col("_at") == F.col("_bin")
    empty = F.lit(0.0) if agg_func == "sum" else F.lit(None).cast("double")
    return grid.select(
        *[col(k) for k in keys],
        _label(F.col("_at"), freq).alias("ts"),
        _steps_between(F.col("_first"), F.col("_at"), freq).alias("position"),
        F.when(seen, F.col("_y")).otherwise(empty).alias("y"),
        F.when(seen, F.col("_n")).otherwise(F.lit(0)).alias("n_points"),
    )


def interpolate_gaps(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fill missing ``y`` linearly by position, and with the nearest value at the ends."""
    w = series_window(keys or [])
    known = F.when(F.col("y").isNotNull(), F.struct("position", "y"))
    # Both frames grow row by row; a frame that shrinks from the end would cost its square.
    before = F.last(known, True).over(w.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, True).over(
        w.orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = series.withColumns({"_b": before, "_a": after})
    span = F.col("_a.position") - F.col("_b.position")
    share = F.try_divide((F.col("position") - F.col("_b.position")).cast("double"), span)
    linear = F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * share
    filled = F.coalesce("y", linear, F.col("_b.y"), F.col("_a.y"))
    return ends.withColumn("y", filled).drop("_a", "_b")


def resample_series(
    df: DataFrame,
    date_col: str,
    target_col: str,
    freq: str = "D",
    agg_func: str = "mean",
    keys: list[str] | None = None,
    short_series: str = "raise",
) -> DataFrame:
    """Regular, gap-free series (keys, ts, position, y), staged because it is small and reused.

    A series with fewer than 5 usable rows is an error, or left out with ``short_series='drop'``.
    """
    keys = keys or []
    grid = resample_grid(df, date_col, target_col, freq, agg_func, keys)
    points = F.sum("n_points").over(series_window(keys))
    staged = stage_table(interpolate_gaps(grid, keys).withColumn("_points", points))
    if short_series == "drop":
        staged = staged.where(F.col("_points") >= MIN_POINTS)
    else:
        fewest = staged.agg(F.min("_points")).first()[0]
        if fewest is None or fewest < MIN_POINTS:
            raise ValueError(f"A series needs at least {MIN_POINTS} rows with a date and a number.")
    return staged.select(*[col(k) for k in keys], "ts", "position", "y")


def lag_features(series: DataFrame, keys: list[str] | None = None, complete: bool = True) -> DataFrame:
    """Add lag_1 to lag_3 and their mean; the first three rows lack lags and are dropped."""
    w = series_window(keys or []).orderBy("position")
    lags = {f"lag_{k}": F.lag("y", k).over(w) for k in range(1, N_LAGS + 1)}
    mean = F.avg("y").over(w.rowsBetween(-N_LAGS, -1))
    out = series.withColumns({**lags, "rolling_mean_3": mean})
    return out.na.drop(subset=list(lags)) if complete else out


def half_split_growth(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, first_half_avg, second_half_avg, historical_growth_pct); 0 % from a zero start."""
    keys = keys or []
    n = F.count(F.lit(1)).over(series_window(keys))
    early = F.col("position") < F.floor(F.col("_n") / 2)
    halves = series.withColumn("_n", n).groupBy(*[col(k) for k in keys]).agg(
        F.avg(F.when(early, F.col("y"))).alias("first_half_avg"),
        F.avg(F.when(~early, F.col("y"))).alias("second_half_avg"),
    )
    first, second = F.col("first_half_avg"), F.col("second_half_avg")
    growth = F.when(first == 0, 0.0).otherwise(F.try_divide(second - first, first) * 100.0)
    return halves.withColumn("historical_growth_pct", growth)


def future_dates(series: DataFrame, horizon: int, freq: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, step, ts): the labels that follow each series."""
    keys = keys or []
    last = series.groupBy(*[col(k) for k in keys]).agg(F.max("ts").alias("_last"))
    return last.select(
        *[col(k) for k in keys],
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
        "_last",
    ).select(*[col(k) for k in keys], "step", future_label(F.col("_last"), F.col("step"), freq).alias("ts"))
