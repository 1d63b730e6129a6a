"""Queries for descriptive statistics, correlations and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parse import text_to_number
from ..functions.ranks import average_ranks
from ..operators import correlation, describe, hypothesis
from ..functions import shapiro
from ..schema import normalise_missing
from .dirty import EVENTS_DIRTY, ORDERS_DIRTY, events_dirty, orders_dirty
from .quality import _describe_rows, _fences, _number, _pct, _union
from .registry import query, r, rounded, table

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- description ---------------------------------------------------------------------------------


@query(
    "describe_numeric",
    f"WITH {ORDERS_DIRTY} {_describe_rows('orders_dirty', ['o_custkey', 'price', 'empty_num', 'const_num'])}",
)
def describe_numeric(spark, sf):
    return rounded(
        describe.describe_numeric(
            orders_dirty(spark, sf), ["o_custkey", "price", "empty_num", "const_num"]
        ),
        4,
    )


@query("describe_numeric_lineitem", _describe_rows("lineitem", _LINE))
def describe_numeric_lineitem(spark, sf):
    return rounded(describe.describe_numeric(table(spark, sf, "lineitem"), _LINE), 4)


def _categorical(source: str, columns: list[tuple[str, str]]) -> str:
    rows = []
    for c, t in columns:
        best = f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"
        rows.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS data_type, total AS total_rows, missing, "
            f"{_pct('missing', 'total')} AS missing_pct, k AS unique_values, coalesce(v, 'N/A') AS mode, "
            f"coalesce(n, 0) AS mode_frequency, {_pct('coalesce(n, 0)', 'total')} AS mode_pct FROM "
            f"(SELECT count(*) AS total, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS k FROM {source}) "
            f"LEFT JOIN {best} ON true"
        )
    return _union(rows)


@query(
    "describe_categorical",
    f"WITH {ORDERS_DIRTY} "
    + _categorical("orders_dirty", [("o_orderstatus", "string"), ("priority", "string"), ("price_text", "string")]),
)
def describe_categorical(spark, sf):
    return describe.describe_categorical(
        orders_dirty(spark, sf), ["o_orderstatus", "priority", "price_text"]
    )


@query(
    "describe_categorical_documents",
    _categorical("documents", [("lang", "string"), ("source", "string"), ("text", "string")]),
)
def describe_categorical_documents(spark, sf):
    return describe.describe_categorical(table(spark, sf, "documents"), ["lang", "source", "text"])


@query(
    "distinct_counts",
    _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM lineitem" for c in [*_LINE, "l_shipdate"]]),
)
def distinct_counts(spark, sf):
    return describe.distinct_counts(table(spark, sf, "lineitem"), [*_LINE, "l_shipdate"])


_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "quantiles",
    _union(
        [
            f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont({c}, {p})', 4)} AS value FROM lineitem"
            for c in _LINE
            for p in _PROBS
        ]
    ),
)
def quantiles(spark, sf):
    return rounded(describe.quantiles(table(spark, sf, "lineitem"), _LINE, _PROBS), 4)


@query("value_counts", "SELECT l_shipdate AS value, count(*) AS count FROM lineitem GROUP BY l_shipdate")
def value_counts(spark, sf):
    return describe.value_counts(table(spark, sf, "lineitem"), "l_shipdate")


@query(
    "histogram",
    "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), "
    "c AS (SELECT least(CAST(floor(20.0 * (l_extendedprice - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS bin, "
    "count(*) AS n FROM lineitem, b GROUP BY 1) "
    f"SELECT CAST(g.bin AS INTEGER) AS bin, {r('lo + (g.bin - 1) * (hi - lo) / 20', 4)} AS lower, "
    f"{r('lo + g.bin * (hi - lo) / 20', 4)} AS upper, coalesce(n, 0) AS count "
    "FROM (SELECT unnest(range(1, 21)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin",
)
def histogram(spark, sf):
    return rounded(describe.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20), 4)


@query(
    "box_summary",
    f"WITH {ORDERS_DIRTY} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", {r('any_value(q1)', 4)} AS q1, {r(f'quantile_cont({c}, 0.5)', 4)} AS median, "
            f"{r('any_value(q3)', 4)} AS q3, {r(f'min(CASE WHEN {c} >= lo THEN {c} END)', 4)} AS whisker_low, "
            f"{r(f'max(CASE WHEN {c} <= hi THEN {c} END)', 4)} AS whisker_high, "
            f"count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) AS n_outliers "
            f"FROM orders_dirty, ({_fences(c, 'orders_dirty')})"
            for c in ("price", "o_custkey")
        ]
    ),
)
def box_summary(spark, sf):
    return rounded(describe.box_summary(orders_dirty(spark, sf), ["price", "o_custkey"]), 4)


@query(
    "crosstab",
    "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2",
)
def crosstab(spark, sf):
    return describe.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "crosstab_wide",
    "SELECT o_orderpriority, "
    + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS \"{s}\"" for s in "FOP")
    + " FROM orders GROUP BY 1",
)
def crosstab_wide(spark, sf):
    return describe.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "crosstab_full",
    "SELECT a, b, (SELECT count(*) FROM part WHERE p_brand = a AND p_type = b) AS n "
    "FROM (SELECT DISTINCT p_brand AS a FROM part), (SELECT DISTINCT p_type AS b FROM part)",
)
def crosstab_full(spark, sf):
    return describe.crosstab_full(table(spark, sf, "part"), "p_brand", "p_type")


@query(
    "group_means",
    f"WITH {EVENTS_DIRTY} SELECT event_type AS category, count(*) AS n, {r('avg(value)')} AS mean "
    "FROM events_dirty WHERE value IS NOT NULL GROUP BY 1",
)
def group_means(spark, sf):
    return rounded(describe.group_means(events_dirty(spark, sf), "event_type", "value"))


@query(
    "column_options",
    "SELECT DISTINCT 'c_mktsegment' AS \"column\", c_mktsegment AS option FROM customer "
    "UNION ALL SELECT DISTINCT 'c_name', c_name FROM customer",
)
def column_options(spark, sf):
    return describe.column_options(table(spark, sf, "customer"))


@query(
    "numeric_ranges",
    _union(
        [
            f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", "
            f"{r(f'quantile_cont({c}, 0.5)', 4)} AS median FROM part"
            for c in ("p_partkey", "p_size", "p_retailprice")
        ]
    ),
)
def numeric_ranges(spark, sf):
    return rounded(describe.numeric_ranges(table(spark, sf, "part")), 4)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark, sf):
    return describe.preview(table(spark, sf, "orders"), ["o_orderkey"])


# --- correlation ---------------------------------------------------------------------------------


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _corr_rows(source: str, columns: list[str], value=lambda a, b: f"corr({a}, {b})") -> str:
    return _union(
        [
            f"SELECT '{a}' AS var1, '{b}' AS var2, {r(value(a, b))} AS correlation, "
            f"{r(f'abs({value(a, b)})')} AS abs_correlation FROM {source}"
            for a, b in _pairs(columns)
        ]
    )


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("pearson_matrix", _corr_rows("lineitem", _LINE))
def pearson_matrix(spark, sf):
    return rounded(correlation.correlations(table(spark, sf, "lineitem"), "pearson", _LINE))


# Twelve columns, one of them tiny and one of them shifted far from zero.
_WIDE = {
    **{c: c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    "tiny": "l_discount * 1e-8 + l_quantity * 1e-9", "far": "l_quantity + l_tax + 1e6", "net": "l_extendedprice * (1 - l_discount)",
    "square": "l_quantity * l_quantity",
}
_WIDE_SQL = "w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem)"
# Every third column misses cells of its own.
_GAPS = {c: f"CASE WHEN l_orderkey % {5 + i} = 1 THEN NULL ELSE {e} END" if i % 3 == 0 else e for i, (c, e) in enumerate(_WIDE.items())}
_GAPS_SQL = "w AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GAPS.items()) + " FROM lineitem)"


@query("pearson_wide", f"WITH {_WIDE_SQL} {_corr_rows('w', list(_WIDE))}")
def pearson_wide(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()])
    return rounded(correlation.correlations(df, "pearson", list(_WIDE)))


@query("pearson_wide_nulls", f"WITH {_GAPS_SQL} {_corr_rows('w', list(_WIDE))}")
def pearson_wide_nulls(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _GAPS.items()])
    return rounded(correlation.correlations(df, "pearson", list(_WIDE)))


_NULLS = ["o_custkey", "price", "price_num"]
_NULL_SOURCE = f"n AS (SELECT *, {_number('price_text')} AS price_num FROM orders_dirty)"


def _null_source(spark, sf):
    return orders_dirty(spark, sf).withColumn("price_num", text_to_number(F.col("price_text")))


@query("pearson_with_nulls", f"WITH {ORDERS_DIRTY}, {_NULL_SOURCE} {_corr_rows('n', _NULLS)}")
def pearson_with_nulls(spark, sf):
    # A constant column has no coefficient and forms no pair.
    df = _null_source(spark, sf)
    return rounded(correlation.correlations(df, "pearson", [*_NULLS, "const_num"]))


_RANKED = "SELECT " + ", ".join(f"{_rank(c)} AS {c}" for c in _LINE) + " FROM lineitem"


@query("spearman_matrix", f"WITH s AS ({_RANKED}) {_corr_rows('s', _LINE)}")
def spearman_matrix(spark, sf):
    return rounded(correlation.correlations(table(spark, sf, "lineitem"), "spearman", _LINE))


@query(
    "spearman_with_nulls",
    f"WITH {ORDERS_DIRTY}, {_NULL_SOURCE} "
    + _union(
        [
            f"SELECT '{a}' AS var1, '{b}' AS var2, {r('corr(ra, rb)')} AS correlation, {r('abs(corr(ra, rb))')} AS abs_correlation "
            f"FROM (SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM n WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            for a, b in _pairs(_NULLS)
        ]
    ),
)
def spearman_with_nulls(spark, sf):
    return rounded(correlation.correlations(_null_source(spark, sf), "spearman", _NULLS))


@query(
    "top_correlations",
    f"WITH c AS ({_corr_rows('lineitem', ['l_partkey', *_LINE])}) SELECT * FROM c "
    "ORDER BY abs_correlation DESC, var1, var2 LIMIT 5",
)
def top_correlations(spark, sf):
    pairs = correlation.correlations(table(spark, sf, "lineitem"), "pearson", ["l_partkey", *_LINE])
    return rounded(correlation.top_correlations(pairs))


@query(
    "correlation_matrix",
    _union(
        [
            f"SELECT '{a}' AS \"column\", "
            + ", ".join((r(f"corr({a}, {b})") if a != b else "1.0::DOUBLE") + f" AS {b}" for b in _LINE)
            + " FROM lineitem"
            for a in _LINE
        ]
    ),
)
def correlation_matrix(spark, sf):
    pairs = correlation.correlations(table(spark, sf, "lineitem"), "pearson", _LINE)
    return rounded(correlation.correlation_matrix(pairs, _LINE))


@query(
    "average_rank",
    f"SELECT l_extendedprice AS value, count(*) AS n, any_value(rk) AS rank FROM "
    f"(SELECT l_extendedprice, CAST({_rank('l_extendedprice')} AS DOUBLE) AS rk FROM lineitem) GROUP BY 1",
)
def average_rank(spark, sf):
    prices = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value"))
    freq = prices.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return average_ranks(freq, "value", "n").select("value", "n", "rank")


# --- hypothesis tests ----------------------------------------------------------------------------


def _simpson(density: str, upper: str, steps: int = 4000) -> str:
    """Integral of ``density`` (in u) from 0 to ``upper`` as a scalar subquery."""
    return (
        f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density})) "
        f"* ({upper}) / {steps} / 3 FROM (SELECT i, i * ({upper}) / {steps} AS u FROM (SELECT unnest(range(0, {steps + 1})) AS i)))"
    )


def _t_p(t: str, v: str) -> str:
    constant = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
    body = _simpson(f"{constant} * pow(1 + u * u / {v}, -({v} + 1) / 2.0)", f"abs({t})")
    return f"greatest(0.0, 1 - 2 * {body})"


def _normal_p(z: str) -> str:
    return f"least(1.0, greatest(0.0, 1 - 2 * {_simpson('exp(-u * u / 2) / sqrt(2 * pi())', z)}))"


def _figures(result: hypothesis.TestResult, df, **extra):
    """One row with the numeric outcome of a test."""
    row = {"statistic": float(result.statistic), "p_value": float(result.p_value), **extra}
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in row.items())
    return rounded(df.sparkSession.createDataFrame([tuple(row.values())], schema))


def _corr_test_sql(source: str) -> str:
    return (
        f"c AS ({source}), t AS (SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c) "
        f"SELECT {r('rho')} AS statistic, {r(_t_p('t', '(n - 2)'))} AS p_value, n FROM t"
    )


@query(
    "pearson_sig",
    f"WITH {EVENTS_DIRTY}, "
    + _corr_test_sql("SELECT corr(user_id, value) AS rho, count(*) AS n FROM events_dirty WHERE value IS NOT NULL"),
)
def pearson_sig(spark, sf):
    df = events_dirty(spark, sf)
    result = hypothesis.correlation_test(df, "user_id", "value")
    return _figures(result, df, n=int(result.figures["n"]))


@query(
    "spearman_sig",
    f"WITH {EVENTS_DIRTY}, "
    + _corr_test_sql(
        f"SELECT corr(a, b) AS rho, count(*) AS n FROM (SELECT {_rank('user_id')} AS a, {_rank('value')} AS b "
        "FROM events_dirty WHERE value IS NOT NULL)"
    ),
)
def spearman_sig(spark, sf):
    df = events_dirty(spark, sf)
    result = hypothesis.correlation_test(df, "user_id", "value", "spearman")
    return _figures(result, df, n=int(result.figures["n"]))


def _chi_sql(source: str, a: str, b: str, yates: bool = False) -> str:
    gap = "abs(o - e)"
    gap = f"({gap} - least(0.5, {gap}))" if yates else gap
    return (
        f"WITH x AS (SELECT {a} AS a, {b} AS b FROM {source}), "
        "m AS (SELECT a, count(*) AS ra FROM x GROUP BY a), k AS (SELECT b, count(*) AS cb FROM x GROUP BY b), "
        "g AS (SELECT (SELECT count(*) FROM x WHERE x.a = m.a AND x.b = k.b) AS o, "
        "ra * cb * 1.0 / (SELECT count(*) FROM x) AS e FROM m, k), "
        f"s AS (SELECT sum({gap} * {gap} / e) AS x2, ((SELECT count(*) FROM m) - 1) * ((SELECT count(*) FROM k) - 1) AS dof FROM g) "
    )


@query(
    "chi2",
    _chi_sql("lineitem", "l_returnflag", "l_linestatus")
    + f"SELECT {r('x2')} AS statistic, {r('exp(-x2 / 2)')} AS p_value, CAST(dof AS BIGINT) AS dof FROM s",
)
def chi2(spark, sf):
    df = table(spark, sf, "lineitem")
    result = hypothesis.chi_square_test(df, "l_returnflag", "l_linestatus")
    return _figures(result, df, dof=int(result.figures["dof"]))


_BULK = "CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END"


@query(
    "chi2_yates",
    _chi_sql("lineitem", "l_linestatus", _BULK, yates=True)
    + f"SELECT {r('x2')} AS statistic, {r(_normal_p('sqrt(x2)'))} AS p_value, CAST(dof AS BIGINT) AS dof FROM s",
)
def chi2_yates(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("bulk", F.expr(_BULK))
    result = hypothesis.chi_square_test(df, "l_linestatus", "bulk")
    return _figures(result, df, dof=int(result.figures["dof"]))


@query(
    "chi2_sparse",
    _chi_sql("customer", "c_nationkey::VARCHAR", "c_mktsegment")
    + f"SELECT {r('x2')} AS statistic, CAST(dof AS BIGINT) AS dof FROM s",
)
def chi2_sparse(spark, sf):
    df = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    result = hypothesis.chi_square_test(df, "nation", "c_mktsegment")
    return _figures(result, df, dof=int(result.figures["dof"])).drop("p_value")


@query(
    "welch",
    "WITH g AS (SELECT l_linestatus AS c, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v "
    "FROM lineitem GROUP BY 1), p AS (SELECT a.m - b.m AS d, a.v / a.n AS va, b.v / b.n AS vb, a.n AS na, b.n AS nb "
    "FROM g a, g b WHERE a.c < b.c), "
    "s AS (SELECT d / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS dof FROM p) "
    f"SELECT {r('t')} AS statistic, {r('dof', 2)} AS dof, {r(_t_p('t', 'dof'))} AS p_value FROM s",
)
def welch(spark, sf):
    df = table(spark, sf, "lineitem")
    t, dof, p = hypothesis.welch_t_test(hypothesis.group_moments(df, "l_linestatus", "l_extendedprice"))
    out = spark.createDataFrame([(t, dof, p)], "statistic double, dof double, p_value double")
    return rounded(out, 6, dof=2)


@query(
    "mwu",
    f"WITH x AS (SELECT l_linestatus AS c, CAST({_rank('l_extendedprice')} AS DOUBLE) AS rk, l_extendedprice AS v FROM lineitem), "
    "w AS (SELECT c, count(*) AS n, sum(rk) AS rs FROM x GROUP BY c), "
    "tie AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY v)), "
    "u AS (SELECT a.rs - a.n * (a.n + 1) / 2.0 AS u1, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, t "
    "FROM w a, w b, tie WHERE a.c < b.c), "
    "z AS (SELECT u1, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / "
    "sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u) "
    f"SELECT {r('u1', 1)} AS statistic, {r(_normal_p('z'))} AS p_value FROM z",
)
def mwu(spark, sf):
    df = table(spark, sf, "lineitem")
    u, p, _ = hypothesis.mann_whitney(df, "l_linestatus", "l_extendedprice")
    out = spark.createDataFrame([(u, p)], "statistic double, p_value double")
    return rounded(out, 6, statistic=1)


@query(
    "anova",
    "WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v "
    "FROM orders GROUP BY 1), t AS (SELECT avg(o_totalprice) AS gm, count(*) AS nn FROM orders), "
    "s AS (SELECT sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum((n - 1) * v) / (any_value(nn) - count(*))) AS f, "
    "count(*) - 1 AS d1, any_value(nn) - count(*) AS d2 FROM g, t), "
    "x AS (SELECT *, d2 / (d2 + d1 * f) AS q FROM s) "
    f"SELECT {r('f')} AS statistic, {r('pow(q, d2 / 2.0) * (1 + d2 / 2.0 * (1 - q))')} AS p_value, "
    "CAST(d1 AS BIGINT) AS df_between, CAST(d2 AS BIGINT) AS df_within FROM x",
)
def anova(spark, sf):
    groups = hypothesis.group_moments(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    f, d1, d2, p = hypothesis.anova_test(groups)
    schema = "statistic double, p_value double, df_between bigint, df_within bigint"
    return rounded(spark.createDataFrame([(f, p, d1, d2)], schema))


@query(
    "kruskal",
    f"WITH x AS (SELECT o_orderpriority AS c, CAST({_rank('o_totalprice')} AS DOUBLE) AS rk, o_totalprice AS v FROM orders), "
    "n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x), "
    "tie AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY v)), "
    "w AS (SELECT c, count(*) AS k, sum(rk - (n + 1) / 2) AS s FROM x, n GROUP BY c), "
    "h AS (SELECT 12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) / "
    "(1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))) AS h, count(*) - 1 AS dof FROM w, n, tie) "
    f"SELECT {r('h')} AS statistic, {r('exp(-h / 2) * (1 + h / 2)')} AS p_value, CAST(dof AS BIGINT) AS dof FROM h",
)
def kruskal(spark, sf):
    h, dof, p = hypothesis.kruskal_wallis(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(spark.createDataFrame([(h, p, dof)], "statistic double, p_value double, dof bigint"))


def _k2_ctes(rows: str) -> str:
    """CTEs ending in z(grp, n, z1, z2): the two normality statistics of each group of ``rows`` (grp, x)."""
    return (
        f"c AS (SELECT grp, x, avg(x) OVER (PARTITION BY grp) AS mu FROM ({rows})), "
        "m AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4 FROM c GROUP BY grp), "
        "p AS (SELECT grp, n, m3 / pow(m2, 1.5) AS g, m4 / (m2 * m2) AS b FROM m), "
        "q AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, "
        "sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, "
        "(b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, "
        "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM p), "
        "v AS (SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a, y / sqrt(2 / (w2 - 1)) AS k FROM q), "
        "z AS (SELECT grp, n, 1 / sqrt(0.5 * ln(w2)) * ln(k + sqrt(k * k + 1)) AS z1, "
        "(1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) "
        "/ sqrt(2 / (9 * a)) AS z2 FROM v)"
    )


def _dagostino_sql() -> str:
    return (
        f"WITH {EVENTS_DIRTY}, {_k2_ctes('SELECT 1 AS grp, value AS x FROM events_dirty WHERE value IS NOT NULL')} "
        f"SELECT 'value' AS \"column\", CAST(n AS BIGINT) AS n, {r('z1 * z1 + z2 * z2', 4)} AS statistic, "
        f"{r('exp(-(z1 * z1 + z2 * z2) / 2)')} AS p_value FROM z"
    )


@query("dagostino", _dagostino_sql())
def dagostino(spark, sf):
    return rounded(hypothesis.dagostino(events_dirty(spark, sf), "value"), 6, statistic=4)


def _sql_poly(coefficients, x: str) -> str:
    return "(" + " + ".join(f"({c!r}) * pow({x}, {k})" for k, c in enumerate(coefficients)) + ")"


def _sql_quantile(p: str) -> str:
    """The normal quantile by the approximation that the library names."""
    centre, tail = ([_sql_poly(c, x) for c in pair] for pair, x in ((shapiro.CENTRE, f"(0.180625 - pow({p} - 0.5, 2))"), (shapiro.TAIL, f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)")))
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {centre[0]} / {centre[1]} ELSE sign({p} - 0.5) * {tail[0]} / {tail[1]} END"


def _shapiro_ctes(rows: str) -> str:
    """CTEs ending in sw(grp, n, p): groups of ``rows`` (grp, x) of 3 to 5,000 values."""
    u, nx, ln = "(1 / sqrt(n))", "n", "ln(n)"
    return (
        f"sr AS (SELECT grp, x, CAST(row_number() OVER (PARTITION BY grp ORDER BY x) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY grp) AS DOUBLE) AS n, "
        f"avg(x) OVER (PARTITION BY grp) AS mu FROM ({rows})), "
        "sp AS (SELECT *, (i - 0.375) / (n + 0.25) AS pp FROM sr WHERE n BETWEEN 3 AND 5000), "
        f"sm AS (SELECT *, {_sql_quantile('pp')} AS m FROM sp), "
        "sa AS (SELECT grp, n, sqrt(sum(m * m)) AS root, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2 FROM sm GROUP BY grp, n), "
        f"sb AS (SELECT *, m1 / root + {_sql_poly(shapiro.LAST, u)} AS a1, CASE WHEN n > 5 THEN m2 / root + {_sql_poly(shapiro.NEXT, u)} END AS a2 FROM sa), "
        "sc AS (SELECT *, sqrt((root * root - 2 * m1 * m1 - coalesce(CASE WHEN n > 5 THEN 2 * m2 * m2 END, 0)) / (1 - 2 * a1 * a1 - 2 * coalesce(a2 * a2, 0))) AS phi FROM sb), "
        # Each value's own weight.
        "sd AS (SELECT sm.grp, sm.n, sm.x - mu AS c, CASE WHEN sm.n = 3 THEN (i - 2) * sqrt(0.5) WHEN i = sm.n THEN a1 WHEN i = 1 THEN -a1 "
        "WHEN sm.n > 5 AND i = sm.n - 1 THEN a2 WHEN sm.n > 5 AND i = 2 THEN -a2 ELSE m / phi END AS a FROM sm JOIN sc USING (grp)), "
        "se AS (SELECT grp, n, least(pow(sum(a * c), 2) / nullif(sum(c * c), 0), 1) AS w FROM sd GROUP BY grp, n), "
        f"sf AS (SELECT *, ln(1 - w) AS y, {_sql_poly(shapiro.SMALL_GAMMA, nx)} AS gam FROM se), "
        f"sg AS (SELECT *, CASE WHEN n <= 11 THEN (-ln(gam - y) - {_sql_poly(shapiro.SMALL_MEAN, nx)}) / exp({_sql_poly(shapiro.SMALL_LOG_SD, nx)}) "
        f"ELSE (y - {_sql_poly(shapiro.LARGE_MEAN, ln)}) / exp({_sql_poly(shapiro.LARGE_LOG_SD, ln)}) END AS z "
        "FROM sf WHERE n > 3 AND w < 1 AND NOT (n <= 11 AND y >= gam)), "
        f"sh AS (SELECT grp, 0.5 - sign(z) * {_simpson('exp(-u * u / 2) / sqrt(2 * pi())', 'abs(z)', 400)} AS p FROM sg), "
        "sw AS (SELECT grp, CAST(n AS BIGINT) AS n, CASE WHEN w IS NULL OR (n BETWEEN 4 AND 11 AND y >= gam AND w < 1) THEN 0.0 "
        "WHEN n = 3 THEN least(greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0), 1) WHEN w >= 1 THEN 1.0 ELSE sh.p END AS p FROM sf LEFT JOIN sh USING (grp))"
    )


def _normality_sql(source: str, grp: str) -> str:
    rows = f"SELECT {grp} AS grp, value AS x FROM {source} WHERE value IS NOT NULL"
    big = f"SELECT grp, x FROM ({rows}) QUALIFY count(*) OVER (PARTITION BY grp) > 5000"
    return (
        f"WITH {EVENTS_DIRTY}, {_shapiro_ctes(rows)}, {_k2_ctes(big)}, "
        f"f AS (SELECT grp, n, 'shapiro' AS method, {r('greatest(p, 0)')} AS p_value, p > 0.05 AS is_normal FROM sw UNION ALL "
        f"SELECT grp, CAST(n AS BIGINT), 'k_squared', {r('exp(-(z1 * z1 + z2 * z2) / 2)')}, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 FROM z UNION ALL "
        f"SELECT grp, count(*), 'none', NULL, false FROM ({rows}) GROUP BY grp HAVING count(*) < 3) "
        "SELECT grp AS category, n, method, p_value, is_normal FROM f"
    )


@query("group_normality", _normality_sql("events_dirty", "event_type"))
def group_normality(spark, sf):
    return rounded(hypothesis.group_normality(normalise_missing(events_dirty(spark, sf)), "event_type", "value"))


@query("group_normality_users", _normality_sql("events_dirty", "user_id"))
def group_normality_users(spark, sf):
    """Many groups of a few dozen values."""
    return rounded(hypothesis.group_normality(normalise_missing(events_dirty(spark, sf)), "user_id", "value"))


def _routed(name, source, a, b, ctes, test, basis, subject):
    """A routed test; ``ctes`` end in f(statistic, p), ``test`` and ``basis`` are SQL for the choice that the data make."""
    sql = (
        f"WITH {ctes} SELECT '{a}' AS var1, '{b}' AS var2, {test} AS test_name, {r('statistic', 4)} AS statistic, {r('p')} AS p_value, "
        f"p < 0.05 AS null_rejected, {test} || ' (' || {basis} || '): statistic ' || format('{{:.4f}}', statistic) || ', p-value ' || "
        f"format('{{:.4e}}', p) || '. The evidence for {subject} is ' || CASE WHEN p < 0.05 THEN 'significant, the null hypothesis is "
        "rejected.' ELSE 'not significant, the null hypothesis stands.' END AS interpretation FROM f"
    )

    def run(spark, sf):
        df = normalise_missing(source(spark, sf))
        return rounded(hypothesis.run_hypothesis_test(df, a, b).to_df(df), 6, statistic=4)

    query(name, sql)(run)


# Whether every group passes the normality test decides between the two families of tests.
_ALL_NORMAL = "(SELECT bool_and(exp(-(z1 * z1 + z2 * z2) / 2) > 0.05) FROM z)"


def _rank_of(c: str) -> str:
    return f"CAST({_rank(c)} AS DOUBLE)"


_routed(
    "test_two_numbers", events_dirty, "user_id", "value",
    f"{EVENTS_DIRTY}, rows_ AS (SELECT user_id, value FROM events_dirty WHERE value IS NOT NULL), "
    + _k2_ctes("SELECT 'a' AS grp, user_id AS x FROM rows_ UNION ALL SELECT 'b', value FROM rows_")
    + f", rho AS (SELECT CASE WHEN {_ALL_NORMAL} THEN corr(user_id, value) ELSE corr(a, b) END AS rho, count(*) AS n "
    f"FROM (SELECT user_id, value, {_rank('user_id')} AS a, {_rank('value')} AS b FROM rows_)), "
    "t AS (SELECT rho, n, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rho), "
    f"f AS (SELECT rho AS statistic, {_t_p('t', '(n - 2)')} AS p FROM t)",
    f"CASE WHEN {_ALL_NORMAL} THEN 'Pearson Correlation Test' ELSE 'Spearman Rank Correlation Test' END",
    f"CASE WHEN {_ALL_NORMAL} THEN 'both variables look normal' ELSE 'at least one variable is not normal' END",
    "a monotonic or linear relationship between ''user_id'' and ''value''",
)
_routed(
    "test_two_categories", orders_dirty, "priority", "o_orderstatus",
    f"{ORDERS_DIRTY}, {_chi_sql('orders_dirty WHERE priority IS NOT NULL', 'priority', 'o_orderstatus').removeprefix('WITH ').rstrip()}, "
    "f AS (SELECT x2 AS statistic, dof, exp(-x2 / 2) * (SELECT sum(pow(x2 / 2, k) / gamma(k + 1)) FROM range(0, CAST(dof / 2 AS BIGINT)) t(k)) AS p FROM s)",
    "'Chi-Square Test of Independence'",
    "dof || ' degrees of freedom'",
    "a dependence between ''priority'' and ''o_orderstatus''",
)
_routed(
    "test_two_groups", lambda s, d: table(s, d, "lineitem"), "l_extendedprice", "l_linestatus",
    _k2_ctes("SELECT l_linestatus AS grp, l_extendedprice AS x FROM lineitem")
    + f", x AS (SELECT l_linestatus AS c, {_rank_of('l_extendedprice')} AS rk, l_extendedprice AS v FROM lineitem), "
    "w AS (SELECT c, count(*) AS n, sum(rk) AS rs FROM x GROUP BY c), "
    "tie AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY v)), "
    "u AS (SELECT a.rs - a.n * (a.n + 1) / 2.0 AS u1, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, t FROM w a, w b, tie WHERE a.c < b.c), "
    "zu AS (SELECT u1, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS zz FROM u), "
    f"f AS (SELECT u1 AS statistic, {_normal_p('zz')} AS p FROM zu)",
    f"CASE WHEN {_ALL_NORMAL} THEN 'Welch''s Two-Sample T-Test' ELSE 'Mann-Whitney U Test' END",
    f"CASE WHEN {_ALL_NORMAL} THEN 'all groups look normal' ELSE 'at least one group is not normal' END",
    "a difference of ''l_extendedprice'' between the levels of ''l_linestatus''",
)
_routed(
    "test_many_groups", orders_dirty, "priority", "price",
    f"{ORDERS_DIRTY}, rows_ AS (SELECT priority, price FROM orders_dirty WHERE priority IS NOT NULL AND price IS NOT NULL), "
    + _k2_ctes("SELECT priority AS grp, price AS x FROM rows_")
    + f", x AS (SELECT priority AS c, {_rank_of('price')} AS rk, price AS v FROM rows_), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x), "
    "tie AS (SELECT sum(k * k * k - k) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM x GROUP BY v)), "
    "w AS (SELECT c, count(*) AS k, sum(rk - (n + 1) / 2) AS s FROM x, nn GROUP BY c), "
    "f AS (SELECT h AS statistic, exp(-h / 2) * (1 + h / 2) AS p FROM (SELECT 12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) / "
    "(1 - any_value(t) / (pow(any_value(n), 3) - any_value(n))) AS h FROM w, nn, tie))",
    f"CASE WHEN {_ALL_NORMAL} THEN 'One-Way ANOVA Test' ELSE 'Kruskal-Wallis H Test (Non-parametric ANOVA)' END",
    f"CASE WHEN {_ALL_NORMAL} THEN 'all groups look normal' ELSE 'at least one group is not normal' END",
    "a difference of ''price'' between the levels of ''priority''",
)
