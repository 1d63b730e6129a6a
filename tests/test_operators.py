"""Operators on small edge tables, against pandas, brute force and invariants."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewise.operators import (
    audit,
    automl,
    clean,
    correlation,
    describe,
    features,
    forecast,
    forest,
    hypothesis,
    isolation,
    metrics,
    outliers,
    report,
    series,
    tighten,
)
from tablewise.functions import rank_scatter
from tablewise.plans import QUERIES
from tablewise.schema import column_roles, normalise_missing
from tablewise.sources import load_table, write_csv


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- audit and cleaning --------------------------------------------------------------------------


def test_empty_table(spark):
    df = frame(spark, [], "x double, s string, i int")
    row = audit.audit_table(df).first()
    assert (row["n_rows"], row["missing_pct"], row["duplicate_pct"], row["n_numeric"]) == (0, 0.0, 0.0, 2)
    assert audit.missing_by_column(df, only_missing=True).count() == 0
    assert [r["is_type_anomaly"] for r in audit.audit_columns(df).collect()] == [False] * 3
    assert clean.clean_table(df).table.count() == 0
    assert describe.describe_numeric(df).where("column = 'x'").first()["mean"] is None
    assert series.detect_date_columns(df) == []


def test_one_row(spark):
    df = frame(spark, [(1.0, "a")], "x double, s string")
    row = describe.describe_numeric(df).first()
    assert row["count"] == 1 and row["std"] is None and row["skewness"] is None and row["kurtosis"] is None


def test_duplicates_count_repeats_after_the_first(spark):
    rows = [(1, None), (1, None), (1, None), (2, "a"), (2, "a"), (3, "b")]
    df = frame(spark, rows, "i int, s string")
    row = audit.duplicate_rows(df).first()
    assert row["n_duplicates"] == 3 and row["duplicate_pct"] == 50.0
    assert clean.drop_duplicate_rows(df).count() == 3


def test_clean_edges(spark):
    rows = [
        (1, None, "$1,000", None, None, float("nan")),
        (2, None, "12 %", None, "b", 1.0),
        (3, None, "7", None, "a", 2.0),
        (4, None, "8", None, "b", 3.0),
        (5, None, "9", None, "a", 100.0),
        (6, None, "oops", None, None, 4.0),
    ]
    df = frame(spark, rows, "i int, none string, t string, empty double, s string, x double")
    result = clean.clean_table(df)
    out = result.table.orderBy("i").toPandas()
    assert set(out["none"]) == {"Unknown"}
    assert out["s"][0] == "a"  # the smaller of two equally frequent values
    assert out["empty"].isna().all()
    assert out["x"][0] == 3.0  # skewed: the median of 1, 2, 3, 4, 100
    assert out["t"][:5].tolist() == [1000.0, 12.0, 7.0, 8.0, 9.0]
    steps = [(r["step"], r["column"]) for r in result.actions.collect()]
    assert ("convert_text", "t") in steps and ("impute_numeric", "x") in steps
    again = clean.clean_table(result.table)
    assert again.log == []


def test_categorical_fill_respects_types(spark):
    df = frame(spark, [(True, "a"), (None, None), (True, "b")], "b boolean, s string")
    assert clean.impute_categorical(df, "mode").table.where("b IS NULL").count() == 0
    constant = clean.impute_categorical(df, "constant").table
    assert constant.where("s = 'Missing'").count() == 1 and constant.where("b IS NULL").count() == 1


def test_mean_fill_turns_integers_into_doubles(spark):
    out = clean.impute_numeric(frame(spark, [(1,), (2,), (None,)], "i int"), "mean").table
    assert dict(out.dtypes)["i"] == "double"
    assert sorted(r[0] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_iqr_cap_and_remove(spark):
    df = frame(spark, [(float(v), "s") for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]] + [(None, "s")], "x double, s string")
    bounds = outliers.iqr_bounds(df, ["x", "s", "unknown"])
    assert list(bounds) == ["x"]
    cap = outliers.treat_outliers(df, ["x", "s"])
    assert cap.counts == {"x": 1}
    top = cap.table.agg(F.max("x")).first()[0]
    assert top == bounds["x"].upper and cap.table.where("x IS NULL").count() == 1
    gone = outliers.treat_outliers(df, ["x"], action="remove").table
    assert gone.count() == 9 and gone.agg(F.max("x")).first()[0] == 8.0
    assert outliers.treat_outliers(df, []).table is df
    assert outliers.treat_outliers(df, ["x"], action="none").table is df
    with pytest.raises(ValueError):
        outliers.treat_outliers(df, ["x"], method="guess")


def test_isolation_forest_finds_planted_points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))]
    rows += [(9000 + i, 30.0 + i, -30.0 - i) for i in range(5)]
    df = frame(spark, rows, "id long, x double, y double")
    flagged = isolation.flag_isolated(df, ["x", "y"], contamination=0.05, keys=["id"])
    share = flagged.where("is_outlier").count() / len(rows)
    assert 0.04 < share < 0.06
    assert flagged.where("id >= 9000 AND is_outlier").count() == 5
    again = isolation.flag_isolated(df.repartition(5), ["x", "y"], contamination=0.05, keys=["id"])
    a = {r["id"]: r["isolation_score"] for r in flagged.collect()}
    b = {r["id"]: r["isolation_score"] for r in again.collect()}
    assert a == pytest.approx(b)


# --- description ---------------------------------------------------------------------------------


def test_describe_equals_pandas(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice")
    got = describe.describe_numeric(df).toPandas().set_index("column")
    pdf = df.toPandas()
    want = pdf.describe().T
    for c in pdf:
        for mine, theirs in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("max", "max")):
            assert got.loc[c, mine] == pytest.approx(want.loc[c, theirs])
        assert got.loc[c, "skewness"] == pytest.approx(pdf[c].skew())
        assert got.loc[c, "kurtosis"] == pytest.approx(pdf[c].kurt())


def test_categorical_without_values(spark):
    df = frame(spark, [(None, "b"), (None, "a"), (None, None)], "e string, s string")
    rows = {r["column"]: r for r in describe.describe_categorical(df).collect()}
    assert rows["e"]["mode"] == "N/A" and rows["e"]["mode_frequency"] == 0 and rows["e"]["missing_pct"] == 100.0
    assert rows["s"]["mode"] == "a" and rows["s"]["mode_pct"] == 33.33


def test_histogram_covers_all_values(spark):
    df = frame(spark, [(float(v),) for v in range(11)] + [(None,)], "x double")
    rows = describe.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 2, 2, 2, 3]
    flat = describe.histogram(frame(spark, [(2.0,), (2.0,)], "x double"), "x", 5).collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(1, 2)]


def test_names_with_dots_and_spaces(spark):
    df = frame(spark, [(1.0, "a"), (2.0, "b"), (None, "b")], "`a.b` double, `my col` string")
    assert describe.describe_numeric(df).first()["count"] == 2
    assert clean.clean_table(df).table.where("`a.b` IS NULL").count() == 0
    assert describe.describe_categorical(df).first()["mode"] == "b"


# --- correlation ---------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_equal_pandas(spark, method):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 9, (300, 3)).astype(float), columns=["a", "b", "c"])
    pdf["c"] += pdf["a"]
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::11, "c"] = np.nan
    pdf["k"] = 1.0
    df = normalise_missing(spark.createDataFrame(pdf))
    got = correlation.correlations(df, method)
    want = pdf.corr(method=method)
    rows = got.collect()
    assert {(r["var1"], r["var2"]) for r in rows} == {("a", "b"), ("a", "c"), ("b", "c")}
    for r in rows:
        assert r["correlation"] == pytest.approx(want.loc[r["var1"], r["var2"]], abs=1e-12)
    top = correlation.top_correlations(got).collect()
    strengths = [r["abs_correlation"] for r in top]
    assert strengths == sorted(strengths, reverse=True)
    assert correlation.correlations(df.select("a")).count() == 0


def test_wide_tables_use_one_matrix(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(200, 10)) * 1e3 + 1e6, columns=list("abcdefghij"))
    pdf["k"] = 2.0
    pdf["n"] = pdf["a"].where(pdf.index % 3 > 0)
    got = correlation.correlations(normalise_missing(spark.createDataFrame(pdf)))
    want = pdf.corr()
    rows = got.collect()
    assert len(rows) == 55 and not any("k" in (r["var1"], r["var2"]) for r in rows)
    for r in rows:
        assert r["correlation"] == pytest.approx(want.loc[r["var1"], r["var2"]], abs=1e-10)


def test_ranks_take_two_shuffles_at_any_width(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_tax", "l_discount", "l_quantity", "l_partkey")
    cells = rank_scatter._cells(df, []).repartitionByRange("col", "value", "row")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "SinglePartition" not in plan and "Join" not in plan


@pytest.mark.parametrize(("rows", "gaps"), [(256, 0), (256, 3), (1 << 16, 70)])
def test_rank_correlations_of_ties_over_many_tasks(spark, monkeypatch, rows, gaps):
    """Two values fill most of the cells, so that their ranks are settled over several tasks; small chunks; more gaps than bits in a mask."""
    monkeypatch.setattr(rank_scatter, "CHUNK_ROWS", rows)
    rng = np.random.default_rng(4)
    width, n = max(5, gaps), 900
    pdf = pd.DataFrame({f"c{i}": rng.choice([0.0, -0.0, 1.0, *rng.normal(size=9)], n, p=[0.3, 0.3, 0.31, *[0.01] * 9]) for i in range(width)})
    for i in range(gaps):
        pdf.loc[rng.random(n) < 0.2, f"c{i}"] = np.nan
    pdf["c4"] = 5.0
    data = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(width))).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = {(r["var1"], r["var2"]): r["correlation"] for r in correlation.correlations(df, "spearman").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = (pdf + 0.0).corr("spearman")
    kept = [c for c in pdf.columns if c != "c4"]
    assert set(got) == {(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :]}
    assert all(got[k] == pytest.approx(want.loc[k], abs=1e-12) for k in got)


@pytest.mark.parametrize("gaps", [0, 2])
def test_ranks_hold_a_slab_of_a_task(spark, monkeypatch, gaps):
    """A task with far more cells than a slab ranks no more than a slab at once, and ties over slabs are settled."""
    monkeypatch.setattr(rank_scatter, "SLAB_CELLS", 64)
    monkeypatch.setattr(rank_scatter, "SLAB_LEAST", 64)
    seen = spark.sparkContext.accumulator(0)
    inner = rank_scatter._groups

    def groups(table, n_gaps):
        assert table.num_rows <= 64
        seen.add(1)
        return inner(table, n_gaps)

    monkeypatch.setattr(rank_scatter, "_groups", groups)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({f"c{i}": rng.choice([0.0, 1.0, *rng.normal(size=20)], 2000, p=[0.3, 0.3, *[0.02] * 20]) for i in range(3)})
    for i in range(gaps):
        pdf.loc[rng.random(2000) < 0.2, f"c{i}"] = np.nan
    data = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(data, "c0 double, c1 double, c2 double").repartition(3)
    got = {(r["var1"], r["var2"]): r["correlation"] for r in correlation.correlations(df, "spearman").collect()}
    want = pdf.corr("spearman")
    assert len(got) == 3 and all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-12) for a, b in got)
    assert seen.value >= int(pdf.notna().sum().sum()) // 64


def test_rank_correlations_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert correlation.correlations(empty, "spearman").collect() == []
    none = spark.createDataFrame([(None, 1.0), (None, 2.0), (3.0, None)], "a double, b double")
    assert correlation.correlations(none, "spearman").collect() == [] and correlation.correlations(none).collect() == []


@pytest.mark.parametrize("width", [3, 8])
def test_pearson_far_from_the_first_rows(spark, width):
    """The first rows tell nothing about the others, which are large beside their spread."""
    rng = np.random.default_rng(2)
    rows = [tuple(float(x) for x in rng.normal(0, 1, width)) for _ in range(300)]
    x = rng.normal(0, 1, (4000, 1))
    rows += [tuple(float(v) for v in r) for r in 1e8 + x + rng.normal(0, 0.5, (4000, width))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(width))).coalesce(1)
    late = df.where("c0 > 1e7")
    for part in (df, late):
        want = np.corrcoef(np.array([tuple(r) for r in part.collect()]).T)
        for r in correlation.correlations(part).collect():
            # Running means lose some digits where the first rows lie 1e8 deviations from the others.
            digits = 1e-6 if width <= correlation.NATIVE_COLUMNS and part is df else 1e-9
            assert r["correlation"] == pytest.approx(want[int(r["var1"][1]), int(r["var2"][1])], abs=digits)


# --- hypothesis tests ----------------------------------------------------------------------------


def test_router_guards(spark):
    df = frame(spark, [(1.0, 2.0, "a", "b")] * 4, "x double, y double, s string, t string")
    for a, b in (("x", "y"), ("s", "t"), ("s", "x")):
        result = hypothesis.run_hypothesis_test(df, a, b)
        assert result.p_value == 1.0 and not result.null_rejected and result.interpretation
    with pytest.raises(ValueError):
        hypothesis.run_hypothesis_test(df, "x", "nope")


def test_yates_only_for_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    result = hypothesis.chi_square_test(frame(spark, rows, "s string, t string"), "s", "t")
    n, (a, b, c, d) = 65, (10, 20, 30, 5)
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert result.statistic == pytest.approx(want) and result.figures["dof"] == 1
    rows += [("b", "z")] * 7  # one empty cell
    result = hypothesis.chi_square_test(frame(spark, rows, "s string, t string"), "s", "t")
    table = np.array([[10, 20, 0], [30, 5, 7]], dtype=float)
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert result.statistic == pytest.approx(((table - e) ** 2 / e).sum())


def _groups(spark, *groups):
    rows = [(chr(97 + i), float(v)) for i, g in enumerate(groups) for v in g]
    return frame(spark, rows, "c string, x double")


def test_small_mann_whitney_is_exact(spark):
    df = _groups(spark, [1.1, 2.2, 3.3], [4.4, 5.5, 6.6, 7.7])
    u, p, _ = hypothesis.mann_whitney(df, "c", "x")
    assert u == 0.0 and p == pytest.approx(2 / 35)
    tied = _groups(spark, [1, 2, 2], [2, 5, 6, 7])
    assert hypothesis.mann_whitney(tied, "c", "x")[1] != pytest.approx(2 / 35)


def test_normal_groups_choose_parametric_tests(spark):
    rng = np.random.default_rng(7)
    a, b, c = (rng.normal(m, 1, 40) for m in (0, 3, 6))
    two = hypothesis.compare_groups(_groups(spark, a, b), "c", "x")
    assert two.test_name == hypothesis.WELCH and two.null_rejected
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 40 + b.var(ddof=1) / 40)
    assert two.statistic == pytest.approx(t)
    many = hypothesis.run_hypothesis_test(_groups(spark, a, b, c), "x", "c")
    assert many.test_name == hypothesis.ANOVA and (many.var1, many.var2) == ("x", "c")


def test_tiny_group_is_not_normal(spark):
    rng = np.random.default_rng(8)
    result = hypothesis.compare_groups(_groups(spark, rng.normal(size=30), [1.0, 2.0]), "c", "x")
    assert result.test_name == hypothesis.MANN_WHITNEY


def test_kruskal_with_ties(spark):
    groups = [[1, 2, 2, 5], [2, 6, 7], [8, 8, 9, 9, 3]]
    h, dof, _ = hypothesis.kruskal_wallis(_groups(spark, *groups), "c", "x")
    pooled = pd.Series([v for g in groups for v in g], dtype=float)
    ranks, n = pooled.rank(), len(pooled)
    at, total = 0, 0.0
    for g in groups:
        total += ranks[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    ties = sum(k**3 - k for k in pooled.value_counts())
    want = (12 / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert h == pytest.approx(want) and dof == 2


def test_correlation_test_of_a_line(spark):
    df = frame(spark, [(float(v), 2.0 * v + 1) for v in range(20)], "x double, y double")
    result = hypothesis.correlation_test(df, "x", "y")
    assert result.statistic == pytest.approx(1.0) and result.p_value < 1e-12


def test_group_normality_methods(spark, monkeypatch):
    monkeypatch.setattr(hypothesis, "SHAPIRO_LIMIT", 50)
    rng = np.random.default_rng(9)
    df = _groups(spark, rng.normal(size=200), rng.normal(size=20), [1.0])
    rows = {r["category"]: r for r in hypothesis.group_normality(df, "c", "x").collect()}
    assert [rows[c]["method"] for c in "abc"] == ["k_squared", "shapiro", "none"]
    assert not rows["c"]["is_normal"]


# --- series and forecast -------------------------------------------------------------------------


def _days(spark, pairs):
    return frame(spark, pairs, "d string, y double").withColumn("d", F.to_timestamp("d"))


@pytest.mark.parametrize("freq,rule", [("D", "D"), ("W", "W"), ("M", "ME")])
@pytest.mark.parametrize("agg", ["mean", "sum"])
def test_resample_equals_pandas(spark, sf_dir, freq, rule, agg):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate < '1996-06-01'")
    got = series.resample_series(df, "o_orderdate", "o_totalprice", freq, agg).orderBy("ts").toPandas()
    pdf = df.select("o_orderdate", "o_totalprice").toPandas().set_index("o_orderdate")["o_totalprice"]
    want = getattr(pdf.resample(rule), agg)().interpolate()
    assert [pd.Timestamp(t) for t in got["ts"]] == list(want.index)
    assert got["y"].tolist() == pytest.approx(want.tolist())
    assert got["position"].tolist() == list(range(len(want)))


def test_sunday_evening_stays_in_its_week(spark):
    days = [("2024-01-07 23:30:00", 1.0), ("2024-01-08 00:10:00", 5.0)] + [("2024-01-10 00:00:00", 5.0)] * 3
    rows = series.resample_series(_days(spark, days), "d", "y", "W").orderBy("ts").collect()
    assert [(str(r["ts"]), r["y"]) for r in rows] == [("2024-01-07", 1.0), ("2024-01-14", 5.0)]


def test_month_gap_is_filled_by_position(spark):
    days = [("2024-01-15 00:00:00", 1.0)] * 3 + [("2024-04-02 00:00:00", 10.0)] * 2
    rows = series.resample_series(_days(spark, days), "d", "y", "M").orderBy("ts").collect()
    assert [r["y"] for r in rows] == [1.0, 4.0, 7.0, 10.0]
    assert str(rows[1]["ts"]) == "2024-02-29"


def test_edges_are_filled_with_the_nearest_value(spark):
    df = frame(spark, [(0, None), (1, 3.0), (2, None), (3, 5.0), (4, None)], "position long, y double")
    assert [r["y"] for r in series.interpolate_gaps(df).orderBy("position").collect()] == [3, 3, 4, 5, 5]


def test_short_series_are_errors(spark):
    df = _days(spark, [("2024-01-01 00:00:00", 1.0)] * 4)
    with pytest.raises(ValueError):
        series.resample_series(df, "d", "y")
    five = _days(spark, [(f"2024-01-0{i} 00:00:00", float(i)) for i in range(1, 6)])
    with pytest.raises(ValueError):
        forecast.forecast_future(series.resample_series(five, "d", "y"))


def _line(spark, n=40):
    rng = np.random.default_rng(1)
    y = [0.0, 1.0, 3.0]
    for _ in range(n - 3):
        y.append(0.5 * y[-1] - 0.2 * y[-2] + 0.1 * y[-3] + 2.0 + float(rng.normal()))
    base = pd.Timestamp("2024-01-01")
    return y, _days(spark, [(str(base + pd.Timedelta(days=i)), float(v)) for i, v in enumerate(y)])


def test_linear_forecast_equals_hand_recursion(spark):
    y, df = _line(spark)
    out = forecast.forecast_future(series.resample_series(df, "d", "y"), 6, "lr", "D")
    x = np.column_stack([y[2:-1], y[1:-2], y[:-3], np.ones(len(y) - 3)])
    beta, *_ = np.linalg.lstsq(x, np.array(y[3:]), rcond=None)
    state, want = y[-3:][::-1], []
    for _ in range(6):
        step = float(np.dot(beta, [*state, 1.0]))
        want.append(step)
        state = [step, *state[:2]]
    rows = out.forecast.orderBy("ts").collect()
    assert [r["forecast"] for r in rows] == pytest.approx(want, rel=1e-8)
    sd = float(np.std(np.array(y[3:]) - x @ beta))
    widths = [r["upper_bound"] - r["lower_bound"] for r in rows]
    assert widths == pytest.approx([2 * 1.96 * sd * math.sqrt(h) for h in range(1, 7)])
    history = out.history.orderBy("ts").collect()
    assert [r["fitted"] is None for r in history[:4]] == [True, True, True, False]
    assert str(rows[0]["ts"]) == str((pd.Timestamp("2024-01-01") + pd.Timedelta(days=len(y))).date())


def test_constant_series(spark):
    df = _days(spark, [(f"2024-01-{i:02d} 00:00:00", 4.0) for i in range(1, 13)])
    out = forecast.forecast_future(series.resample_series(df, "d", "y"), 3, "lr", "D")
    assert [r["forecast"] for r in out.forecast.collect()] == pytest.approx([4.0] * 3)
    m = out.metrics.first()
    assert m["model_r2"] == 1.0 and m["forecast_direction"] == "Stable / Sideways Trend"


def test_keyed_forecast_equals_single_series(spark):
    _, df = _line(spark)
    both = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("k", F.lit("b")))
    keyed = series.resample_series(both, "d", "y", keys=["k"])
    single = forecast.forecast_future(series.resample_series(df, "d", "y"), 4, "lr", "D")
    want = [r["forecast"] for r in single.forecast.orderBy("ts").collect()]
    out = forecast.forecast_future(keyed, 4, "lr", "D", ["k"])
    for k in "ab":
        got = [r["forecast"] for r in out.forecast.where(F.col("k") == k).orderBy("ts").collect()]
        assert got == pytest.approx(want)
    trees = forecast.forecast_future(keyed, 4, "rf", "D", ["k"])
    assert trees.forecast.count() == 8 and trees.metrics.where("model_r2 > 0.5").count() == 2


def test_date_columns(spark):
    rows = [("2024-01-05", "x", "1.5"), ("2024-02-05", "y", "2.5"), (None, "z", None)]
    df = frame(spark, rows, "d string, s string, n string").withColumn("t", F.current_date())
    assert series.detect_date_columns(df) == ["d", "t"]


# --- schema, sources, report ---------------------------------------------------------------------


def test_tighten_uses_strict_bounds(spark):
    df = frame(spark, [(126, -127, 127, 1), (0, 0, 0, 40_000)], "a long, b long, c long, d long")
    assert [t for _, t in tighten.tighten_schema(df).dtypes] == ["tinyint", "tinyint", "smallint", "int"]


def test_csv_types(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        'i,f,b,s,d,e\n1,1.5,True,"a, ""q""",2024-01-05,\n2,NA,false,n/a,2024-01-06,null\n-3,1e3,TRUE,z,2024-01-07,\n'
    )
    df = load_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    rows = df.orderBy("i").collect()
    assert rows[1]["s"] == 'a, "q"' and rows[2]["f"] is None and rows[2]["s"] is None
    out = str(tmp_path / "out.csv")
    write_csv(df, out)
    assert load_table(spark, out).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        load_table(spark, "book.xlsx")


def test_roles(spark):
    df = frame(spark, [], "a int, b decimal(9,2), c boolean, d date, e array<int>, f string")
    assert list(column_roles(df).values()) == ["numeric", "numeric", "boolean", "temporal", "complex", "string"]


def test_report_sections(spark, tmp_path):
    df = frame(spark, [(1.0, "a", None), (2.0, "b", "x")], "x double, s string, t string")
    findings = report.combine_findings(
        spark, report.audit_findings(audit.audit_table(df), audit.audit_columns(df)), None
    )
    lines = report.render_markdown(findings, "Brief", "Checked by hand.")
    texts = [r["text"] for r in lines.orderBy("line_no").collect()]
    assert texts[0] == "# Brief" and texts[-1] == "Checked by hand."
    assert "*No forecast was made.*" in texts and "**Shape:** 2 rows, 3 columns" in texts
    assert texts[texts.index("| Column | Missing | Share |") :][:3] == ["| Column | Missing | Share |", "|---|---|---|", "| t | 1 | 50.0% |"]
    report.write_markdown(lines, str(tmp_path / "brief"))
    assert spark.read.text(str(tmp_path / "brief")).first()[0] == "# Brief"


# --- models --------------------------------------------------------------------------------------


def test_task_detection(spark):
    df = frame(spark, [(i % 10, i % 11, "s") for i in range(50)], "ten int, eleven int, s string")
    kinds = [features.detect_task_type(df, c) for c in ("ten", "eleven", "s", None)]
    assert kinds == ["classification", "regression", "classification", "clustering"]
    with pytest.raises(ValueError):
        features.detect_task_type(frame(spark, [(None,)], "x int"), "x")


def test_macro_metrics_with_unpredicted_class(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    m = metrics.classification_metrics(frame(spark, rows, "y string, p string"), "y", "p").first()
    assert m["accuracy"] == 0.5
    assert m["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert m["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert m["f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_auc_by_pairs(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8)]
    df = frame(spark, rows, "y int, s double").withColumn("scores", F.array(1 - F.col("s"), "s"))
    wins = [1.0 if p > q else 0.5 if p == q else 0.0 for y, p in rows if y for z, q in rows if not z]
    assert metrics.roc_auc(df, "y", [0, 1], "scores").first()[0] == pytest.approx(np.mean(wins))
    one = df.where("y = 1")
    assert metrics.roc_auc(one, "y", [0, 1], "scores").first()[0] == 0.5


def test_split_ignores_partitioning(spark):
    df = spark.range(1000).toDF("id")
    a = {r["id"] for r in df.where(automl.split_rows(df, ["id"])).collect()}
    b = {r["id"] for r in df.repartition(7).where(automl.split_rows(df, ["id"])).collect()}
    assert a == b and 150 < len(a) < 250


def test_hashed_levels_and_unseen_categories(spark):
    df = frame(spark, [(float(i), f"v{i % 7}", "ab"[i % 2]) for i in range(40)], "x double, many string, few string")
    p = automl.fit_preprocessor(df, ["x"], ["many", "few"], ["many"])
    assert p.hashed == ["many"] and p.names[:3] == ["x", "few_a", "few_b"]
    unseen = p.transform(frame(spark, [("zz",)], "few string")).first()["features"].toArray()
    assert list(unseen[1:3]) == [0.0, 0.0]


def test_automl_classification_learns_a_rule(spark, monkeypatch):
    monkeypatch.setattr(automl, "N_TREES", 5)
    monkeypatch.setattr(automl, "BOOST_ROUNDS", 3)
    monkeypatch.setitem(automl.GRIDS, "Random Forest", {"trees": [3], "depth": [4]})
    monkeypatch.setitem(automl.GRIDS, "Gradient Boosting", {"rounds": [2], "step": [0.1]})
    rng = np.random.default_rng(3)
    rows = [
        (i, float(a), "uv"[int(b > 0)], "yes" if a + 2 * b > 0 else "no", None)
        for i, (a, b) in enumerate(rng.normal(size=(400, 2)))
    ]
    df = frame(spark, rows, "id long, a double, g string, y string, nothing string")
    model = automl.run_automl(df, "y", ["id"])
    assert model.task_type == "classification" and model.labels == ["no", "yes"]
    assert model.feature_columns == ["a", "g"]
    assert model.metrics["F1-Score"] > 0.7 and model.metrics["ROC-AUC"] > 0.8
    total = model.feature_importance().agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)
    scored = model.score(df.drop("g"))
    assert {r["prediction"] for r in scored.select("prediction").distinct().collect()} <= {"yes", "no"}
    label, probabilities = model.predict({"a": "$3.5", "g": "v", "extra": 1})
    assert label == "yes" and sum(probabilities) == pytest.approx(1.0)
    board = model.leaderboard()
    assert board.where("stage = 'baseline'").count() == 3


def test_automl_regression_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(automl, "N_TREES", 5)
    monkeypatch.setattr(automl, "BOOST_ROUNDS", 3)
    rows = [(i, float(i % 23), float(i % 7), 3.0 * (i % 23) - (i % 7)) for i in range(300)]
    df = frame(spark, rows, "id long, a double, b double, y double")
    model = automl.run_automl(df, "y", ["id"])
    assert model.model_name == "Tuned Linear Regression" and model.metrics["R-squared"] > 0.999
    assert model.predict({"a": 2.0, "b": 1.0})[0] == pytest.approx(5.0, abs=1e-6)
    rng = np.random.default_rng(5)
    points = [(float(x + c), float(y + c)) for c in (0, 20, 40) for x, y in rng.normal(size=(40, 2))]
    blobs = frame(spark, points, "x double, y double")
    clusters = automl.run_automl(blobs)
    assert clusters.metrics["Clusters"] == 3.0
    assert [r["count"] for r in automl.cluster_sizes(clusters, blobs).collect()] == [40, 40, 40]


def test_automl_regression_reads_the_whole_table(spark, sf_dir, monkeypatch, tmp_path):
    """Names that are identifiers are found to be so and stay in the result; names that tell the balance are a feature."""
    monkeypatch.setattr(automl, "N_TREES", 5)
    monkeypatch.setattr(automl, "BOOST_ROUNDS", 3)
    monkeypatch.setitem(automl.GRIDS, "Random Forest", {"trees": [3], "depth": [4]})
    monkeypatch.setitem(automl.GRIDS, "Gradient Boosting", {"rounds": [2], "step": [0.1]})
    judged = []
    inner = automl.judge_features

    def judge_features(df, columns):
        judged.append({v.column: v.reason for v in inner(df, columns)})
        return inner(df, columns)

    monkeypatch.setattr(automl, "judge_features", judge_features)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    scored = QUERIES["automl_regression"](spark, sf_dir)
    assert scored.columns == [*customer.columns, "prediction"]
    given = sorted(map(tuple, customer.collect()))
    assert sorted(tuple(r)[:-1] for r in scored.collect()) == given
    assert judged[0] == {"c_name": "looks like an identifier", "c_nationkey": None, "c_mktsegment": None}

    told = customer.withColumns({"c_name": F.concat(F.lit("name "), F.col("c_custkey") % 6), "c_acctbal": F.col("c_custkey") % 6 * 100.0 + F.col("c_nationkey")})
    told.write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["automl_regression"](spark, str(tmp_path)).collect()
    assert len(found) == len(given) and judged[1]["c_name"] is None
    assert all(abs(r["prediction"] - r["c_acctbal"]) < 0.01 for r in found)


def test_vectors_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    """A source of one partition and few bytes leaves no estimator with all rows in one task, and no row is lost."""
    monkeypatch.setattr(automl, "FILE_BYTES", 50_000)
    rows = [(float(i % 3 * 100 + i % 5), float(i % 3 * 100 + i % 7)) for i in range(1500)]
    blobs = frame(spark, rows, "x double, y double").coalesce(1)
    seen = []
    inner = automl.stage_table

    def stage_table(df):
        seen.append(df.rdd.getNumPartitions())
        return inner(df)

    monkeypatch.setattr(automl, "stage_table", stage_table)
    for folder in (None, f"file://{tmp_path}"):
        monkeypatch.setattr(automl, "shared_folder", lambda spark, folder=folder: folder)
        assert automl.run_automl(blobs).metrics["Clusters"] == 3.0
        assert automl.stage_vectors(blobs, 1500, 3000).count() == 1500
    cores = spark.sparkContext.defaultParallelism
    assert seen == [min(16, cores), max(min(375, cores), 12), 16, 375]


def test_rows_are_not_shuffled_by_class(spark, monkeypatch):
    """The classes' numbers go to the rows: few classes would be few tasks with all rows."""
    plans = []

    class Planned(Exception):
        pass

    def stage_vectors(vectors, rows, width):
        plans.append(vectors._jdf.queryExecution().sparkPlan().toString())
        raise Planned

    monkeypatch.setattr(automl, "stage_vectors", stage_vectors)
    df = frame(spark, [(i, float(i % 23), "abc"[i % 3]) for i in range(300)], "id long, x double, y string")
    with pytest.raises(Planned):
        automl.run_automl(df, "y", ["id"])
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def noisy_vectors(spark, width, n=1500, kinds=2):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(n, width))
    labels = (points[:, 0] + rng.normal(size=n) > 0) + (rng.random(n) < 0.2) * (kinds > 2)
    return points, labels, frame(
        spark, [(Vectors.dense(p), float(y)) for p, y in zip(points, labels)], StructType().add("features", VectorUDT()).add("label", "double")
    )


def plain_tree(bins, labels, weights, classes, min_rows):
    """Class shares by bin of a tree on one feature, cut at the first best Gini gain until none is left."""
    shares = {}

    def grow(inside):
        total = np.bincount(labels[inside], weights[inside], classes)
        best, where = 0.0, None
        for cut in sorted(set(bins[inside]))[:-1]:
            sides = [np.bincount(labels[s], weights[s], classes) for s in (inside[bins[inside] <= cut], inside[bins[inside] > cut])]
            if min(s.sum() for s in sides) < min_rows:
                continue
            gain = sum((s**2).sum() / s.sum() for s in sides) - (total**2).sum() / total.sum()
            if gain > best + 1e-9:
                best, where = gain, cut
        if where is None:
            shares.update({b: total / total.sum() for b in set(bins[inside])})
            return
        grow(inside[bins[inside] <= where])
        grow(inside[bins[inside] > where])

    grow(np.flatnonzero(weights > 0))
    return shares


@pytest.mark.parametrize("min_rows", [1, 40])
def test_forest_equals_plain_trees(spark, monkeypatch, min_rows):
    """Subtrees grown in groups, below nodes split by summed histograms or not, are those of a plain recursion."""
    points, labels, df = noisy_vectors(spark, 1, kinds=3)
    estimator = forest.ForestClassifier(3, 4, 30, min_rows, 7)
    kept = []
    inner = forest.stage_table
    monkeypatch.setattr(forest, "stage_table", lambda df: kept.append(inner(df)) or kept[-1])
    whole = estimator.fit(df.coalesce(1))
    monkeypatch.setattr(forest, "GROUP_CELLS", 1)  # 64 rows a group
    splits = []
    inner_split = forest._Tree.split
    monkeypatch.setattr(forest._Tree, "split", lambda self, node, found: splits.append(node) or inner_split(self, node, found))
    parts = estimator.fit(df.repartition(5))
    cells = sorted((r["bins"], r["label"], r["n"], r["id"]) for r in kept[0].collect())
    assert sum(n for _, _, n, _ in cells) == 1500 and (len(cells) > 64) == bool(splits)
    bins, kinds = np.array([c[0][0] for c in cells]), np.array([c[1] for c in cells])
    drawn = forest._drawn([c[3] for c in cells], [c[2] for c in cells], 4)
    expected = [plain_tree(bins, kinds, drawn[:, t].astype(float), 3, min_rows) for t in range(4)]
    for model in (whole, parts):
        rows = model.transform(df).select("features", "probability", "prediction").collect()
        own = forest._binned(np.array([r["features"].toArray() for r in rows]), whole.cuts)[:, 0]
        for r, b in zip(rows, own):
            assert r["probability"].toArray() == pytest.approx(sum(e[b] for e in expected) / 4, abs=1e-6)
            assert r["prediction"] == np.argmax(r["probability"].toArray())


def test_forest_of_sparse_and_constant_features(spark, monkeypatch):
    """Zeros count as values, constant features are never cut, and a rule is found among them, in groups of any size."""
    rows = [(Vectors.sparse(4, {0: 5.0, 1: float(i % 4 - 1), 2: float(i % 50)}), float(i % 4 > 1 and i % 50 > 24)) for i in range(800)]
    df = frame(spark, rows, StructType().add("features", VectorUDT()).add("label", "double"))
    for cells in (forest.GROUP_CELLS, 1):
        monkeypatch.setattr(forest, "GROUP_CELLS", cells)
        model = forest.ForestClassifier(2, 60, 30, 1, 3).fit(df)
        assert len(model.cuts[0]) == len(model.cuts[3]) == 0 and list(model.cuts[1]) == [-0.5, 0.5, 1.5] and 25 < len(model.cuts[2]) < 32
        assert set(np.flatnonzero(model.featureImportances.toArray())) == {1, 2}
        scored = model.transform(df)
        assert scored.where("prediction = label").count() > 780


_SENT = """
import sys
sys.path[:0] = [sys.argv[1]]
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import SparkSession
from tablewise.operators import automl
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", "file://" + sys.argv[2])
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
rng = np.random.default_rng(4)
rows = [(Vectors.dense(p), float(y)) for p, y in zip(rng.normal(size=(4000, 4)), rng.integers(0, 2, 4000))]
df = spark.createDataFrame(rows, ["features", "label"]).repartition(4).cache()
model = automl._classifier("Random Forest", 4000, 2, {"trees": 10}, 42).fit(df)
print(model.totalNumNodes if hasattr(model, "totalNumNodes") else sum(len(t[0]) for t in model.trees))
spark.stop()
"""


def test_forest_sends_few_bytes_a_node(tmp_path):
    """Noisy labels grow trees with the rows: what tasks send to the driver stays a small part of Spark's best splits."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _SENT, root, str(tmp_path)], capture_output=True, text=True, check=True, timeout=300)
    nodes = int(done.stdout.split()[-1])
    (log,) = tmp_path.iterdir()
    ends = [e for e in map(json.loads, log.read_text().splitlines()) if e["Event"] == "SparkListenerTaskEnd"]
    sent = sum(e["Task Metrics"]["Result Size"] for e in ends)
    assert nodes > 10_000
    assert (sent - 5_000 * len(ends)) / nodes < 20


# --- width and missing cells ---------------------------------------------------------------------


@pytest.mark.parametrize("width", [3, 12])
def test_pearson_is_the_same_at_every_width(spark, width):
    """Tiny columns and missing cells change nothing; a constant column has no coefficient."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, width)) + rng.normal(size=(300, 1))
    x[:, 1] = x[:, 1] * 1e-8 + 5.0
    x[:, 2] = 0.1
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)])
    pdf.loc[::7, "c0"] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(width))).repartition(3)
    got = {(r["var1"], r["var2"]): r["correlation"] for r in correlation.correlations(df).collect()}
    want = pdf.corr()
    kept = [c for c in pdf.columns if c != "c2"]
    assert set(got) == {(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :]}
    assert all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-7) for a, b in got)
    ranks = {(r["var1"], r["var2"]): r["correlation"] for r in correlation.correlations(df, "spearman").collect()}
    want = pdf.corr("spearman")
    assert set(ranks) == set(got)
    assert all(ranks[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a, b in ranks)


def test_rows_with_nan_and_null_are_duplicates(spark):
    rows = [(1, float("nan")), (1, None), (1, None), (2, float("nan")), (3, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    assert audit.duplicate_rows(df).first()["n_duplicates"] == 2
    assert audit.audit_table(df).first()["n_duplicates"] == 2
    assert clean.drop_duplicate_rows(df).count() == 3


def test_full_grid_of_many_values(spark):
    df = spark.createDataFrame([(f"a{i % 3}", f"b{i}") for i in range(1500)], "a string, b string")
    full = describe.crosstab_full(df, "a", "b")
    assert full.count() == 4500 and full.agg(F.sum("n")).first()[0] == 1500


def test_full_grids_have_a_size(spark, monkeypatch):
    df = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(4)], "a string, b string")
    assert describe.crosstab_full(df, "a", "b").count() == 16
    monkeypatch.setattr(describe, "MAX_GRID", 15)
    with pytest.raises(ValueError, match="4 x 4"):
        describe.crosstab_full(df, "a", "b")
