"""Queries for date detection, resampling, gap filling and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, series
from ..schema import normalise_missing
from .dirty import EVENTS_DIRTY, ORDERS_DIRTY, events_dirty, orders_dirty
from .quality import _union
from .registry import query, r, rounded, table

_BIN = {
    "D": ("CAST({t} AS DATE)", "INTERVAL 1 DAY", "{b}"),
    "W": ("CAST(date_trunc('week', {t}) + INTERVAL 6 DAY AS DATE)", "INTERVAL 7 DAY", "{b}"),
    "M": ("CAST(date_trunc('month', {t}) AS DATE)", "INTERVAL 1 MONTH", "last_day({b})"),
}


def grid_sql(source: str, ts: str, y: str, freq: str, agg: str) -> str:
    """CTEs ending in grid(pos, bin, ts, y): the dense series before gap filling."""
    start, step, label = _BIN[freq]
    empty = "coalesce(o.y, 0.0)" if agg == "sum" else "o.y"
    return (
        f"obs AS (SELECT {start.format(t=ts)} AS bin, {'sum' if agg == 'sum' else 'avg'}({y}) AS y FROM {source} "
        f"WHERE {ts} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1), "
        f"cal AS (SELECT CAST(unnest(generate_series(CAST(min(bin) AS TIMESTAMP), CAST(max(bin) AS TIMESTAMP), {step})) AS DATE) AS bin FROM obs), "
        f"grid AS (SELECT row_number() OVER (ORDER BY cal.bin) - 1 AS pos, cal.bin, {label.format(b='cal.bin')} AS ts, {empty} AS y "
        "FROM cal LEFT JOIN obs o ON o.bin = cal.bin)"
    )


# Linear by position between the nearest known points.
_FILLED = (
    "ends AS (SELECT pos, ts, y, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos) AS p0, "
    "last_value(y IGNORE NULLS) OVER (ORDER BY pos) AS y0, "
    "first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1, "
    "first_value(y IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1 FROM grid), "
    "filled AS (SELECT pos, ts, coalesce(y, y0 + (y1 - y0) * (pos - p0) * 1.0 / nullif(p1 - p0, 0), y0, y1) AS y FROM ends)"
)


# Means of cents often end in exactly half a cent, where rounding depends on the last bit; both
# sides move them by this much before rounding.
_OFF_TIE = 0.00001


def _resample_sql(freq: str, agg: str) -> str:
    grid = grid_sql("orders", "o_orderdate", "o_totalprice", freq, agg)
    y = r("y" if agg == "sum" else f"y + {_OFF_TIE}", 2)
    return f"WITH {grid}, {_FILLED} SELECT ts, pos AS position, {y} AS y FROM filled"


def _resample(freq, agg):
    def run(spark, sf):
        df = table(spark, sf, "orders")
        out = series.resample_series(df, "o_orderdate", "o_totalprice", freq, agg)
        return rounded(out if agg == "sum" else out.withColumn("y", F.col("y") + _OFF_TIE), 2)

    return run


for _freq, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    for _agg in ("mean", "sum"):
        query(f"resample_{_name}_{_agg}", _resample_sql(_freq, _agg))(_resample(_freq, _agg))


def _by_type_sql(agg: str) -> str:
    """CTEs ending in filled(event_type, ts, pos, y): a daily series of every event type."""
    made, empty = ("sum", "coalesce(y, 0.0)") if agg == "sum" else ("avg", "y")
    return (
        f"obs AS (SELECT event_type, CAST(ts AS DATE) AS d, {made}(value) AS y FROM events_dirty WHERE value IS NOT NULL GROUP BY 1, 2), "
        "span AS (SELECT event_type, min(d) AS lo, max(d) AS hi FROM obs GROUP BY 1), "
        "cal AS (SELECT event_type, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span), "
        f"grid AS (SELECT cal.event_type, cal.d, row_number() OVER (PARTITION BY cal.event_type ORDER BY cal.d) - 1 AS pos, {empty} AS y "
        "FROM cal LEFT JOIN obs o ON o.event_type = cal.event_type AND o.d = cal.d), "
        "ends AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p0, last_value(y IGNORE NULLS) OVER w AS y0, "
        "first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS p1, first_value(y IGNORE NULLS) OVER v AS y1 FROM grid "
        "WINDOW w AS (PARTITION BY event_type ORDER BY pos), "
        "v AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
        "filled AS (SELECT event_type, d AS ts, pos, coalesce(y, y0 + (y1 - y0) * (pos - p0) * 1.0 / nullif(p1 - p0, 0)) AS y FROM ends)"
    )


_BY_TYPE = _by_type_sql("mean")


def _all_types(agg):
    def run(spark, sf):
        return series.resample_series(normalise_missing(events_dirty(spark, sf)), "ts", "value", "D", agg, ["event_type"])

    return run


@query(
    "resample_gaps",
    f"WITH {EVENTS_DIRTY}, {_BY_TYPE} SELECT event_type, d AS ts, pos AS position, {r('y')} AS y FROM grid",
)
def resample_gaps(spark, sf):
    df = normalise_missing(events_dirty(spark, sf))
    return rounded(series.resample_grid(df, "ts", "value", "D", "mean", ["event_type"]).drop("n_points"))


@query(
    "resample_text_target",
    f"WITH {ORDERS_DIRTY}, x AS (SELECT o_orderdate AS t, CASE WHEN priority IS NULL THEN NULL ELSE TRY_CAST(substr(priority, 1, 1) AS DOUBLE) END AS v FROM orders_dirty), "
    f"{grid_sql('x', 't', 'v', 'M', 'mean')}, {_FILLED} SELECT ts, pos AS position, {r('y')} AS y FROM filled",
)
def resample_text_target(spark, sf):
    df = orders_dirty(spark, sf).withColumn("level", F.substring("priority", 1, 1))
    return rounded(series.resample_series(df, "o_orderdate", "level", "M", "mean"))


@query("gap_fill", f"WITH {EVENTS_DIRTY}, {_BY_TYPE} SELECT event_type, ts, pos AS position, {r('y')} AS y FROM filled")
def gap_fill(spark, sf):
    return rounded(_all_types("mean")(spark, sf))


@query("gap_sum_zero", f"WITH {EVENTS_DIRTY}, {_by_type_sql('sum')} SELECT event_type, ts, pos AS position, {r('y', 4)} AS y FROM filled")
def gap_sum_zero(spark, sf):
    return rounded(_all_types("sum")(spark, sf), 4)


@query(
    "resample_text_dates",
    f"WITH {EVENTS_DIRTY}, x AS (SELECT TRY_CAST(ts_text AS TIMESTAMP) AS t, value FROM events_dirty), "
    f"{grid_sql('x', 't', 'value', 'W', 'mean')}, {_FILLED} SELECT ts, pos AS position, {r('y')} AS y FROM filled",
)
def resample_text_dates(spark, sf):
    return rounded(series.resample_series(events_dirty(spark, sf), "ts_text", "value", "W", "mean"))


@query(
    "resample_by_type",
    f"WITH {EVENTS_DIRTY}, {_BY_TYPE} SELECT event_type, ts, pos AS position, {r('y')} AS y FROM filled",
)
def resample_by_type(spark, sf):
    return rounded(_all_types("mean")(spark, sf))


_LAGS = (
    "lags AS (SELECT event_type, ts, pos, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3 "
    "FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY pos))"
)


@query(
    "lag_features",
    f"WITH {EVENTS_DIRTY}, {_BY_TYPE}, {_LAGS} SELECT event_type, ts, pos AS position, {r('y')} AS y, {r('l1')} AS lag_1, "
    f"{r('l2')} AS lag_2, {r('l3')} AS lag_3, {r('(l1 + l2 + l3) / 3')} AS rolling_mean_3 FROM lags WHERE l3 IS NOT NULL",
)
def lag_features(spark, sf):
    s = series.resample_series(events_dirty(spark, sf), "ts", "value", "D", "mean", ["event_type"])
    return rounded(series.lag_features(s, ["event_type"]))


_MONTHLY = f"{grid_sql('orders', 'o_orderdate', 'o_totalprice', 'M', 'sum')}, {_FILLED}"


def _monthly(spark, sf):
    return series.resample_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "M", "sum")


@query(
    "trend_summary",
    f"WITH {_MONTHLY}, h AS (SELECT avg(CASE WHEN pos < n // 2 THEN y END) AS a, avg(CASE WHEN pos >= n // 2 THEN y END) AS b "
    f"FROM (SELECT pos, y, count(*) OVER () AS n FROM filled)) SELECT {r('a', 2)} AS first_half_avg, {r('b', 2)} AS second_half_avg, "
    f"{r('(b - a) / a * 100')} AS historical_growth_pct FROM h",
)
def trend_summary(spark, sf):
    return rounded(series.half_split_growth(_monthly(spark, sf)), 2, historical_growth_pct=6)


@query(
    "future_dates",
    f"WITH {_MONTHLY}, l AS (SELECT max(ts) AS ts FROM filled) SELECT CAST(step AS INTEGER) AS step, "
    "last_day(CAST(date_trunc('month', ts) + to_months(CAST(step AS INTEGER)) AS DATE)) AS ts FROM l, (SELECT unnest(range(1, 13)) AS step)",
)
def future_dates(spark, sf):
    return series.future_dates(_monthly(spark, sf), 12, "M")


# Least squares on three lags by Cramer's rule, then twelve recursive steps.
_DET = "({0}11 * ({0}22 * {0}33 - {0}23 * {0}23) - {0}12 * ({0}12 * {0}33 - {0}23 * {0}13) + {0}13 * ({0}12 * {0}23 - {0}22 * {0}13))"
_AR = (
    f"{_MONTHLY}, lags AS (SELECT pos, ts, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3 "
    "FROM filled WINDOW w AS (ORDER BY pos)), tr AS (SELECT * FROM lags WHERE l3 IS NOT NULL), "
    "mo AS (SELECT avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, avg(l3) AS m3, "
    + ", ".join(f"covar_pop(l{i}, l{j}) AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    + ", covar_pop(l1, y) AS d1, covar_pop(l2, y) AS d2, covar_pop(l3, y) AS d3 FROM tr), "
    f"det AS (SELECT *, {_DET.format('c')} AS dt FROM mo), "
    "be AS (SELECT *, (d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / dt AS b1, "
    "(c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / dt AS b2, "
    "(c11 * (c22 * d3 - d2 * c23) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / dt AS b3 FROM det), "
    "co AS (SELECT my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, b1, b2, b3 FROM be), "
    "fit AS (SELECT ts, pos, y, b0 + b1 * l1 + b2 * l2 + b3 * l3 AS f FROM tr, co), "
    "q AS (SELECT 1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - f)) AS mae, "
    "sqrt(avg((y - f) * (y - f))) AS rmse, stddev_pop(y - f) AS sd FROM fit), "
    "la AS (SELECT ts, y, l1, l2 FROM lags ORDER BY pos DESC LIMIT 1), "
    "rec AS (SELECT 0 AS h, y AS a, l1 AS b, l2 AS c FROM la UNION ALL "
    "SELECT h + 1, b0 + b1 * a + b2 * b + b3 * c, a, b FROM rec, co WHERE h < 12)"
)


@query(
    "ar_linear_forecast",
    f"WITH RECURSIVE {_AR} SELECT last_day(CAST(date_trunc('month', la.ts) + to_months(CAST(h AS INTEGER)) AS DATE)) AS ts, "
    f"{r('a', 0)} AS forecast, {r('a - 1.96 * sd * sqrt(h)', 0)} AS lower_bound, {r('a + 1.96 * sd * sqrt(h)', 0)} AS upper_bound "
    "FROM rec, q, la WHERE h > 0",
)
def ar_linear_forecast(spark, sf):
    return rounded(forecast.forecast_future(_monthly(spark, sf), 12, "lr", "M").forecast, 0)


@query(
    "ar_linear_history",
    f"WITH RECURSIVE {_AR} SELECT filled.ts, {r('filled.y', 2)} AS actual, {r('f', 0)} AS fitted FROM filled LEFT JOIN fit ON fit.pos = filled.pos",
)
def ar_linear_history(spark, sf):
    history = forecast.forecast_future(_monthly(spark, sf), 12, "lr", "M").history
    return rounded(history, 2, fitted=0)


@query(
    "ar_linear_metrics",
    f"WITH RECURSIVE {_AR}, av AS (SELECT avg(a) AS fa FROM rec WHERE h > 0), "
    "hs AS (SELECT avg(CASE WHEN pos < n // 2 THEN y END) AS a, avg(CASE WHEN pos >= n // 2 THEN y END) AS b "
    "FROM (SELECT pos, y, count(*) OVER () AS n FROM filled)), pc AS (SELECT (fa - y) / y * 100 AS p FROM av, la) "
    f"SELECT {r('r2')} AS model_r2, {r('mae', 0)} AS model_mae, {r('rmse', 0)} AS model_rmse, {r('(b - hs.a) / hs.a * 100', 4)} AS historical_growth_pct, "
    f"{r('fa', 0)} AS forecast_average, CASE WHEN p > 2 THEN 'Upward / Growth Trend' WHEN p < -2 THEN 'Downward / Decline Trend' "
    f"ELSE 'Stable / Sideways Trend' END AS forecast_direction, {r('p', 4)} AS forecast_pct_change FROM q, av, hs, pc",
)
def ar_linear_metrics(spark, sf):
    out = forecast.forecast_future(_monthly(spark, sf), 12, "lr", "M").metrics
    return rounded(
        out, 0, model_r2=6, historical_growth_pct=4, forecast_pct_change=4
    )


# The same least squares and recursion for every event type.
_AR_KEYED = (
    f"{_BY_TYPE}, {_LAGS}, tr AS (SELECT * FROM lags WHERE l3 IS NOT NULL), "
    "mo AS (SELECT event_type, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, avg(l3) AS m3, "
    + ", ".join(f"covar_pop(l{i}, l{j}) AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    + ", covar_pop(l1, y) AS d1, covar_pop(l2, y) AS d2, covar_pop(l3, y) AS d3 FROM tr GROUP BY event_type), "
    f"det AS (SELECT *, {_DET.format('c')} AS dt FROM mo), "
    "be AS (SELECT *, (d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / dt AS b1, "
    "(c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / dt AS b2, "
    "(c11 * (c22 * d3 - d2 * c23) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / dt AS b3 FROM det), "
    "co AS (SELECT event_type, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, b1, b2, b3 FROM be), "
    "q AS (SELECT event_type, stddev_pop(y - (b0 + b1 * l1 + b2 * l2 + b3 * l3)) AS sd FROM tr JOIN co USING (event_type) GROUP BY event_type), "
    "la AS (SELECT event_type, ts, y, l1, l2 FROM lags QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY pos DESC) = 1), "
    "rec AS (SELECT event_type, 0 AS h, y AS a, l1 AS b, l2 AS c FROM la UNION ALL "
    "SELECT event_type, h + 1, b0 + b1 * a + b2 * b + b3 * c, a, b FROM rec JOIN co USING (event_type) WHERE h < 12)"
)


@query(
    "ar_linear_by_type",
    f"WITH RECURSIVE {EVENTS_DIRTY}, {_AR_KEYED} SELECT event_type, CAST(la.ts + to_days(CAST(h AS INTEGER)) AS DATE) AS ts, {r('a')} AS forecast, "
    f"{r('a - 1.96 * sd * sqrt(h)')} AS lower_bound, {r('a + 1.96 * sd * sqrt(h)')} AS upper_bound "
    "FROM rec JOIN q USING (event_type) JOIN la USING (event_type) WHERE h > 0",
)
def ar_linear_by_type(spark, sf):
    keys = ["event_type"]
    return rounded(forecast.forecast_future(_all_types("mean")(spark, sf), 12, "lr", "D", keys).forecast)


@query("ar_forest_forecast")
def ar_forest_forecast(spark, sf):
    return forecast.forecast_future(_monthly(spark, sf), 12, "rf", "M").forecast


@query("ar_forest_by_type")
def ar_forest_by_type(spark, sf):
    return forecast.forecast_future(_all_types("mean")(spark, sf), 12, "rf", "D", ["event_type"]).forecast


# Steps that the lags tell exactly: two months high, two months low; and three levels in turn, far above.
_MONTH = "(year({d}) * 12 + month({d}))"
_STEPS = "CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN {m} % 4 < 2 THEN 10 ELSE 30 END ELSE 1000 + 100 * ({m} % 3) END"
_STEPS_AT = {
    "even": "CASE WHEN {m} % 4 < 2 THEN 10 ELSE 30 END",
    "odd": "1000 + 100 * ({m} % 3)",
}


def _steps_sql(half: str) -> str:
    month = _MONTH.format(d="ts")
    return (
        f"SELECT half, last_day(ts) AS ts, CAST({_STEPS_AT[half].format(m=month)} AS DOUBLE) AS forecast FROM ("
        f"SELECT '{half}' AS half, CAST(unnest(generate_series(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH, "
        f"date_trunc('month', max(o_orderdate)) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ts FROM orders WHERE o_custkey % 2 = {int(half == 'odd')})"
    )


@query(
    "ar_forest_steps",
    f"WITH f AS ({_steps_sql('even')} UNION ALL {_steps_sql('odd')}) "
    "SELECT half, ts, forecast, forecast AS lower_bound, forecast AS upper_bound FROM f",
)
def ar_forest_steps(spark, sf):
    """A forest of two series that are known in advance: every tree must find the rule, and part the series."""
    steps = F.expr(_STEPS.format(m=_MONTH.format(d="o_orderdate"))).cast("double")
    df = table(spark, sf, "orders").withColumn("half", F.expr("if(o_custkey % 2 = 0, 'even', 'odd')")).withColumn("steps", steps)
    s = series.resample_series(df, "o_orderdate", "steps", "M", "mean", ["half"])
    return rounded(forecast.forecast_future(s, 12, "rf", "M", ["half"]).forecast)


_DATE_OK = "count(TRY_CAST({c} AS TIMESTAMP)) * 1.0 / count({c})"


@query(
    "date_detection",
    f"WITH {EVENTS_DIRTY}, d AS ("
    + _union(
        [
            f"SELECT '{c}' AS \"column\", {r(_DATE_OK.format(c=c))} AS parse_rate FROM events_dirty"
            for c in ("event_type", "ts_text")
        ]
    )
    + ') SELECT "column", parse_rate, parse_rate > 0.8 AS is_date FROM d',
)
def date_detection(spark, sf):
    return rounded(series.date_column_rates(events_dirty(spark, sf)))


def _date_column(c: str, date: str) -> str:
    """A text column is one of dates if more than 80 % of its values are."""
    return f"SELECT '{c}' AS \"column\", count({date}) AS n_dates FROM events_dirty HAVING count({date}) > 0.8 * count({c})"


@query(
    "date_columns",
    f"WITH {EVENTS_DIRTY} " + _union([_date_column(c, f"TRY_CAST({c} AS TIMESTAMP)") for c in ("ts", "ts_text", "event_type")]),
)
def date_columns(spark, sf):
    df = events_dirty(spark, sf)
    found = series.detect_date_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.count(series.calendar_day(df, c)).alias("n_dates")) for c in found]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
