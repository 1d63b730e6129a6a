"""Recursive forecasts from an autoregression on three lags, linear or random forest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.parse import trend_label
from ..functions.staging import stage_table
from ..schema import col
from .series import MIN_SERIES, future_label, half_split_growth, lag_features, series_window

# Fixed values.
N_TREES = 100
Z_95 = 1.96
SEED = 42
FOREST_DEPTH = 30  # the deepest tree Spark grows
FOREST_BINS = 128  # thresholds tried for a feature
LAGS = ["lag_1", "lag_2", "lag_3"]


@dataclass
class Forecast:
    """``history`` (ts, actual, fitted), ``forecast`` (ts, forecast, bounds) and ``metrics``."""

    history: DataFrame
    forecast: DataFrame
    metrics: DataFrame


def _solve(means: pd.Series, cov: pd.Series, cross: pd.Series) -> pd.Series:
    """Least squares per series from centred moments: [intercept, b1, b2, b3].

    The mean of the lags is a fourth, collinear regressor of the least-norm solution; its
    coefficient is folded into the three lags.
    """
    spread = np.vstack([np.eye(3), np.full((1, 3), 1.0 / 3.0)])
    out = []
    for m, c, y in zip(means, cov, cross):
        c = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]])
        wide = spread @ c @ spread.T
        beta = np.linalg.pinv(wide, rcond=1e-12, hermitian=True) @ (spread @ np.asarray(y))
        b = spread.T @ beta
        out.append([float(m[3] - b @ np.asarray(m[:3])), *map(float, b)])
    return pd.Series(out)


def linear_coefficients(lagged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, beta) by grouped moments: one row per series reaches Python."""
    pairs = [(a, b) for i, a in enumerate(LAGS) for b in LAGS[i:]]
    moments = lagged.groupBy(*[col(k) for k in keys]).agg(
        F.array(*[F.avg(c) for c in [*LAGS, "y"]]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
        F.array(*[F.covar_pop(a, "y") for a in LAGS]).alias("cross"),
    )
    solve = F.pandas_udf(_solve, "array<double>")
    return moments.select(*[col(k) for k in keys], solve("means", "cov", "cross").alias("beta"))


def _linear(lagged: DataFrame, keys: list[str], horizon: int) -> tuple[DataFrame, DataFrame]:
    """Fitted rows, and one row per series with its array of predictions."""
    beta = linear_coefficients(lagged, keys)
    b = F.col("beta")
    fit = b[0] + b[1] * F.col("lag_1") + b[2] * F.col("lag_2") + b[3] * F.col("lag_3")
    fitted = lagged.join(beta, keys).withColumn("fitted", fit).drop("beta")
    last = lagged.groupBy(*[col(k) for k in keys]).agg(
        F.max_by(F.array("y", "lag_1", "lag_2"), "position").alias("_recent")
    )
    start = F.struct(F.col("_recent").alias("recent"), F.array().cast("array<double>").alias("made"))

    def advance(state, _):
        r = state["recent"]
        y = b[0] + b[1] * r[0] + b[2] * r[1] + b[3] * r[2]
        return F.struct(
            F.array(y, r[0], r[1]).alias("recent"), F.concat(state["made"], F.array(y)).alias("made")
        )

    made = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda s: s["made"])
    return fitted, last.join(beta, keys).select(*[col(k) for k in keys], made.alias("made"))


def _forest(lagged: DataFrame, keys: list[str], horizon: int) -> tuple[DataFrame, DataFrame]:
    """Fitted rows, and one row per series with its array of predictions, from one Spark forest of all series.

    Each series is brought to mean 0 and deviation 1, and its place among the sorted keys is a feature, so that trees
    part the series where these differ. A single series is the case of one place.
    """
    named = [col(k) for k in keys]
    scales = lagged.groupBy(*named).agg(F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_sd"), F.max_by(F.array("y", "lag_1", "lag_2"), "position").alias("_recent"))
    placed = scales.orderBy(*named).withColumn("_place", F.monotonically_increasing_id().cast("double"))
    series = stage_table(placed.withColumn("_sd", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)))
    scaled = lambda x: (x - F.col("_mean")) / F.col("_sd")
    # Rounded, as the last digits of a mean tell the order of its summands, which a tree would learn.
    whole = lambda x: F.round(x, 9)
    features = lambda recent: array_to_vector(F.array(*map(whole, recent), whole(sum(recent[1:], recent[0]) / 3.0), F.col("_place")))
    rows = lagged.join(series.drop("_recent"), keys)
    data = rows.select("*", scaled(F.col("y")).alias("_y"), features([scaled(F.col(c)) for c in LAGS]).alias("_x"))
    forest = RandomForestRegressor(
        featuresCol="_x",
        labelCol="_y",
        predictionCol="_fit",
        numTrees=N_TREES,
        maxDepth=FOREST_DEPTH,
        maxBins=FOREST_BINS,
        featureSubsetStrategy="all",
        seed=SEED,
    ).fit(data)
    back = lambda x: x * F.col("_sd") + F.col("_mean")
    fitted = forest.transform(data).select(*lagged.columns, back(F.col("_fit")).alias("fitted"))
    state = series.select("*", F.array(*[scaled(F.col("_recent")[i]) for i in range(3)]).alias("_r"), F.array().cast("array<double>").alias("made"))
    for _ in range(horizon):
        r = F.col("_r")
        state = forest.transform(state.withColumn("_x", features([r[0], r[1], r[2]])))
        made = F.concat("made", F.array(back(F.col("_fit")))).alias("made")
        state = state.select(*series.columns, F.array(F.col("_fit"), r[0], r[1]).alias("_r"), made)
    return fitted, state.select(*named, "made")


def fit_metrics(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_r2, model_mae, model_rmse, residual_std) of ``y`` against ``fitted``."""
    residual = F.col("y") - F.col("fitted")
    sums = fitted.groupBy(*[col(k) for k in keys]).agg(
        F.sum(residual * residual).alias("_sse"),
        (F.var_pop("y") * F.count("y")).alias("_sst"),
        F.avg(F.abs(residual)).alias("model_mae"),
        F.sqrt(F.avg(residual * residual)).alias("model_rmse"),
        F.stddev_pop(residual).alias("residual_std"),
    )
    r2 = F.when(F.col("_sst") > 0, 1.0 - F.try_divide(F.col("_sse"), F.col("_sst"))).otherwise(
        F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    )
    return sums.withColumn("model_r2", r2).drop("_sse", "_sst")


def forecast_future(
    series: DataFrame,
    horizon: int = 12,
    model_type: str = "rf",
    freq: str = "D",
    keys: list[str] | None = None,
) -> Forecast:
    """Fit on the lag features and feed predictions back for ``horizon`` steps.

    The 95 % interval widens with the square root of the step. ``freq`` is the frequency the
    series was resampled to.
    """
    user_keys = keys or []
    keys = user_keys or ["_series"]
    if not user_keys:
        series = series.withColumn("_series", F.lit(0))
    length = F.count(F.lit(1)).over(series_window(keys))
    shortest = series.select(length.alias("n")).agg(F.min("n")).first()[0]
    if shortest is None or shortest < MIN_SERIES:
        raise ValueError(f"A forecast needs at least {MIN_SERIES} points per series.")
    lagged = stage_table(lag_features(series, keys))
    if model_type == "rf":
        fitted, made = _forest(lagged, keys, horizon)
    else:
        fitted, made = _linear(lagged, keys, horizon)
    # The model is fitted once; history, intervals and metrics all read these small tables.
    fitted = stage_table(fitted.select(*[col(k) for k in keys], "position", "y", "fitted"))
    metrics = fit_metrics(fitted, keys)

    history = series.join(fitted.drop("y"), [*keys, "position"], "left").select(
        *[col(k) for k in user_keys], "ts", F.col("y").alias("actual"), "fitted"
    )
    last = series.groupBy(*[col(k) for k in keys]).agg(
        F.max("ts").alias("_last_ts"), F.max_by("y", "position").alias("_last_y")
    )
    whole = stage_table(made.join(metrics, keys).join(last, keys))
    steps = whole.select("*", F.posexplode("made").alias("_i", "forecast"))
    step = F.col("_i") + 1
    margin = F.lit(Z_95) * F.col("residual_std") * F.sqrt(step)
    forecast = steps.select(
        *[col(k) for k in user_keys],
        future_label(F.col("_last_ts"), step, freq).alias("ts"),
        "forecast",
        (F.col("forecast") - margin).alias("lower_bound"),
        (F.col("forecast") + margin).alias("upper_bound"),
    )
    average = F.aggregate("made", F.lit(0.0), lambda a, v: a + v) / horizon
    change = F.when(F.col("_last_y") == 0, 0.0).otherwise(
        F.try_divide(F.col("forecast_average") - F.col("_last_y"), F.col("_last_y")) * 100.0
    )
    summary = (
        whole.withColumn("forecast_average", average)
        .withColumn("forecast_pct_change", change)
        .join(half_split_growth(series, keys), keys)
        .select(
            *[col(k) for k in user_keys],
            "model_r2",
            "model_mae",
            "model_rmse",
            "historical_growth_pct",
            "forecast_average",
            trend_label(F.col("forecast_pct_change")).alias("forecast_direction"),
            "forecast_pct_change",
        )
    )
    return Forecast(history, forecast, summary)
