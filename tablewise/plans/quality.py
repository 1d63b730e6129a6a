"""Queries for sources, audit, cleaning and outlier treatment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.parse import currency_text, text_to_number, text_to_timestamp
from ..functions.staging import shared_folder, stage_table
from ..operators import audit, clean, describe, isolation, outliers, report, tighten
from ..operators.correlation import correlations, top_correlations
from ..schema import normalise_missing, numeric_columns, role_summary
from ..sources import load_table, write_csv
from .dirty import EVENTS_DIRTY, ORDERS_DIRTY, events_dirty, orders_dirty
from .registry import query, r, rounded, table

_OD = [
    ("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"),
    ("o_orderstatus", "string", "string"), ("o_orderdate", "temporal", "timestamp_ntz"),
    ("priority", "string", "string"), ("price", "numeric", "double"),
    ("price_text", "string", "string"), ("empty_num", "numeric", "double"),
    ("const_num", "numeric", "double"),
]
_TEXTS = ["o_orderstatus", "priority", "price_text"]
_STRIP = r"regexp_replace({c}, '[$,%\s]', '', 'g')"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(c: str) -> str:
    s = _STRIP.format(c=c)
    return f"CASE WHEN regexp_matches({s}, '{_NUMBER}') THEN TRY_CAST({s} AS DOUBLE) END"


def _pct(part: str, whole: str) -> str:
    return f"coalesce(round_even(100.0 * ({part}) / nullif({whole}, 0), 2), 0.0)"


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


# --- sources -------------------------------------------------------------------------------------


@query("scan_parquet", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def scan_parquet(spark, sf):
    return load_table(spark, f"{sf}/part.parquet").select(
        "p_partkey", "p_name", "p_size", "p_retailprice"
    )


@query(
    "csv_round_trip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def csv_round_trip(spark, sf):
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/tablewise/{uuid.uuid4().hex}.csv"
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    write_csv(table(spark, sf, "orders").select(*columns), path)
    return load_table(spark, path)


@query(
    "missing_normalised",
    f"WITH {EVENTS_DIRTY} SELECT event_id, value FROM events_dirty",
)
def missing_normalised(spark, sf):
    return normalise_missing(events_dirty(spark, sf)).select("event_id", "value")


def _advice_sql() -> str:
    # Strict bounds decide the width; the extremes come from the data.
    rows = []
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"):
        frm = "int" if c == "l_linenumber" else "bigint"
        rows.append(
            f"SELECT '{c}' AS \"column\", '{frm}' AS from_type, CASE "
            f"WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' "
            f"WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
            f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS to_type, "
            f"CAST(min({c}) AS BIGINT) AS \"min\", CAST(max({c}) AS BIGINT) AS \"max\", "
            "CAST(NULL AS BIGINT) AS n_unique, false AS dictionary_candidate FROM lineitem"
        )
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"):
        t = "timestamp_ntz" if c == "l_shipdate" else "double"
        rows.append(f"SELECT '{c}', '{t}', '{t}', NULL, NULL, NULL, false")
    for c in ("l_returnflag", "l_linestatus"):
        rows.append(
            f"SELECT '{c}', 'string', 'string', NULL, NULL, count(DISTINCT {c}), "
            f"count(DISTINCT {c}) * 1.0 / count(*) < 0.5 AND count(DISTINCT {c}) < 1000 FROM lineitem"
        )
    return _union(rows)


@query("schema_advice", _advice_sql())
def schema_advice(spark, sf):
    return tighten.schema_advice(table(spark, sf, "lineitem"))


@query(
    "tighten_schema",
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders, "
    "CAST(sum(l_linenumber) AS BIGINT) AS lines, max(CASE WHEN l_linenumber < 127 THEN 'tinyint' END) AS line_type "
    "FROM lineitem",
)
def tighten_schema(spark, sf):
    df = tighten.tighten_schema(table(spark, sf, "lineitem"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_orderkey").alias("orders"),
        F.sum("l_linenumber").alias("lines"),
    ).withColumn("line_type", F.lit(df.schema["l_linenumber"].dataType.simpleString()))


@query(
    "column_roles",
    f"WITH {ORDERS_DIRTY} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", '{role}' AS role, '{t}' AS dtype, {'true' if role == 'numeric' else 'false'} AS is_numeric, "
            f"count({c}) AS n_values FROM orders_dirty"
            for c, role, t in _OD
        ]
    ),
)
def column_roles(spark, sf):
    df = orders_dirty(spark, sf)
    filled = audit.missing_by_column(df).select("column", (F.col("n_rows") - F.col("n_missing")).alias("n_values"))
    return role_summary(df).join(filled, "column")


# --- audit ---------------------------------------------------------------------------------------


def _missing_rows(source: str, columns: list[str]) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
            f"{_pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct FROM {source}"
            for c in columns
        ]
    )


@query(
    "audit_missing",
    f"WITH {ORDERS_DIRTY}, m AS ({_missing_rows('orders_dirty', [c for c, _, _ in _OD])}) "
    "SELECT * FROM m WHERE n_missing > 0",
)
def audit_missing(spark, sf):
    return audit.missing_by_column(orders_dirty(spark, sf), only_missing=True)


@query(
    "audit_missing_nan",
    f"WITH {EVENTS_DIRTY}, m AS "
    f"({_missing_rows('events_dirty', ['event_id', 'user_id', 'event_type', 'ts_text', 'ts', 'value'])}) "
    "SELECT * FROM m",
)
def audit_missing_nan(spark, sf):
    return audit.missing_by_column(events_dirty(spark, sf))


@query(
    "audit_columns",
    f"WITH {ORDERS_DIRTY} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", '{role}' AS role, '{t}' AS dtype, count(*) AS n_rows, "
            f"count(*) - count({c}) AS n_missing, {_pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct, "
            + (
                f"coalesce(count({_number(c)}) * 1.0 / nullif(count({c}), 0) > 0.8, false)"
                if role == "string"
                else "false"
            )
            + " AS is_type_anomaly FROM orders_dirty"
            for c, role, t in _OD
        ]
    ),
)
def audit_columns(spark, sf):
    return audit.audit_columns(orders_dirty(spark, sf))


@query(
    "audit_duplicates",
    f"WITH {ORDERS_DIRTY}, d AS (SELECT DISTINCT * FROM orders_dirty), "
    "c AS (SELECT (SELECT count(*) FROM orders_dirty) AS n, (SELECT count(*) FROM d) AS k) "
    f"SELECT n AS n_rows, n - k AS n_duplicates, {_pct('n - k', 'n')} AS duplicate_pct FROM c",
)
def audit_duplicates(spark, sf):
    return audit.duplicate_rows(orders_dirty(spark, sf))


@query(
    "audit_anomalies",
    f"WITH {ORDERS_DIRTY} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS n_values, "
            f"{r(f'count({_number(c)}) * 1.0 / count({c})')} AS parse_rate, "
            f"count({_number(c)}) * 1.0 / count({c}) > 0.8 AS is_type_anomaly FROM orders_dirty"
            for c in _TEXTS
        ]
    ),
)
def audit_anomalies(spark, sf):
    return rounded(audit.anomaly_rates(orders_dirty(spark, sf)))


_CELLS = " + ".join(f"(count(*) - count({c}))" for c, _, _ in _OD)


@query(
    "audit_table",
    f"WITH {ORDERS_DIRTY}, d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM orders_dirty)), "
    f"m AS (SELECT count(*) AS n, {_CELLS} AS missing FROM orders_dirty) "
    "SELECT n AS n_rows, CAST(9 AS BIGINT) AS n_columns, n * 9 AS n_cells, missing AS n_missing, "
    f"{_pct('missing', 'n * 9')} AS missing_pct, n - k AS n_duplicates, {_pct('n - k', 'n')} AS duplicate_pct, "
    "CAST(5 AS BIGINT) AS n_numeric, CAST(4 AS BIGINT) AS n_categorical FROM m, d",
)
def audit_table(spark, sf):
    return audit.audit_table(orders_dirty(spark, sf))


@query(
    "audit_documents",
    _missing_rows("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
)
def audit_documents(spark, sf):
    return audit.missing_by_column(table(spark, sf, "documents"))


# --- cleaning ------------------------------------------------------------------------------------


_NAN = "SELECT event_type, CASE event_id % 3 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE 1.5E0 END AS x FROM "
_NAN_SQL = f"n AS (SELECT event_type, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM ({_NAN} events))"


def _nan_rows(spark, sf):
    return spark.sql(_NAN + "{events}", events=table(spark, sf, "events"))


@query(
    "audit_duplicates_nan",
    f"WITH {_NAN_SQL}, c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM n)) AS k) "
    f"SELECT n AS n_rows, n - k AS n_duplicates, {_pct('n - k', 'n')} AS duplicate_pct FROM c",
)
def audit_duplicates_nan(spark, sf):
    return audit.duplicate_rows(_nan_rows(spark, sf))


@query("dedup_nan", f"WITH {_NAN_SQL} SELECT DISTINCT * FROM n")
def dedup_nan(spark, sf):
    return clean.drop_duplicate_rows(_nan_rows(spark, sf))


@query("dedup", f"WITH {ORDERS_DIRTY} SELECT DISTINCT * FROM orders_dirty")
def dedup(spark, sf):
    return clean.drop_duplicate_rows(orders_dirty(spark, sf))


@query(
    "text_to_number",
    f"WITH {ORDERS_DIRTY} SELECT o_orderkey, price_text, {_number('price_text')} AS price_num FROM orders_dirty",
)
def text_to_number_query(spark, sf):
    return orders_dirty(spark, sf).select(
        "o_orderkey", "price_text", text_to_number(F.col("price_text")).alias("price_num")
    )


@query(
    "convert_numeric_text",
    f"WITH {ORDERS_DIRTY} SELECT o_orderkey, o_orderstatus, priority, "
    f"{_number('price_text')} AS price_text FROM orders_dirty",
)
def convert_numeric_text(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "o_orderstatus", "priority", "price_text")
    return clean.convert_numeric_text(df)


@query(
    "text_to_date",
    f"WITH {EVENTS_DIRTY} SELECT event_id, TRY_CAST(ts_text AS DATE) AS day FROM events_dirty",
)
def text_to_date(spark, sf):
    return events_dirty(spark, sf).select(
        "event_id",
        F.to_date(text_to_timestamp(F.col("ts_text"), "yyyy-MM-dd HH:mm:ss")).alias("day"),
    )


@query(
    "currency_text",
    "SELECT o_orderkey, concat('$', format('{:,.2f}', o_totalprice)) AS price_text FROM orders",
)
def currency(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", currency_text(F.col("o_totalprice")).alias("price_text")
    )


_FILL_INPUT = (
    f"f AS (SELECT o_orderkey, price, {_number('price_text')} AS price_num, empty_num, const_num FROM orders_dirty)"
)


def _fills_sql(how: str) -> str:
    def fill(c: str) -> str:
        mean, median = f"avg({c})", f"quantile_cont({c}, 0.5)"
        if how == "skew":
            return f"CASE WHEN abs(skewness({c})) > 1 THEN {median} ELSE {mean} END"
        return mean if how == "mean" else median

    return (
        f"WITH {ORDERS_DIRTY}, {_FILL_INPUT}, v AS (SELECT {fill('price')} AS a, {fill('price_num')} AS b FROM f) "
        f"SELECT o_orderkey, {r('coalesce(price, a)', 4)} AS price, {r('coalesce(price_num, b)', 4)} AS price_num, "
        "empty_num, const_num FROM f, v"
    )


def _fill_input(spark, sf):
    return orders_dirty(spark, sf).select(
        "o_orderkey", "price", text_to_number(F.col("price_text")).alias("price_num"), "empty_num", "const_num"
    )


def _impute(how):
    def run(spark, sf):
        return rounded(clean.impute_numeric(_fill_input(spark, sf), how).table, 4)

    return run


query("impute_skew", _fills_sql("skew"))(_impute("skew_based"))
query("impute_mean", _fills_sql("mean"))(_impute("mean"))
query("impute_median", _fills_sql("median"))(_impute("median"))


def _mode(source: str, c: str) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mode",
    f"WITH {ORDERS_DIRTY} SELECT o_orderkey, o_orderstatus, "
    f"coalesce(priority, {_mode('orders_dirty', 'priority')}) AS priority, "
    f"coalesce(price_text, {_mode('orders_dirty', 'price_text')}) AS price_text FROM orders_dirty",
)
def impute_mode(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "o_orderstatus", "priority", "price_text")
    return clean.impute_categorical(df, "mode").table


@query(
    "impute_constant",
    f"WITH {ORDERS_DIRTY} SELECT o_orderkey, o_orderdate, coalesce(priority, 'Missing') AS priority FROM orders_dirty",
)
def impute_constant(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "o_orderdate", "priority")
    return clean.impute_categorical(df, "constant").table


# Deduplicated, converted and filled: the expected table for everything after cleaning.
CLEANED = (
    f"{ORDERS_DIRTY}, dd AS (SELECT DISTINCT * REPLACE ({_number('price_text')} AS price_text) FROM orders_dirty), "
    "fv AS (SELECT CASE WHEN abs(skewness(price)) > 1 THEN quantile_cont(price, 0.5) ELSE avg(price) END AS pv, "
    "CASE WHEN abs(skewness(price_text)) > 1 THEN quantile_cont(price_text, 0.5) ELSE avg(price_text) END AS tv FROM dd), "
    f"cleaned AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, "
    f"coalesce(priority, {_mode('dd', 'priority')}) AS priority, coalesce(price, pv) AS price, "
    "coalesce(price_text, tv) AS price_text, empty_num, const_num FROM dd, fv)"
)


@query(
    "clean_table",
    f"WITH {CLEANED} SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, priority, "
    f"{r('price', 4)} AS price, {r('price_text', 4)} AS price_text, empty_num, const_num FROM cleaned",
)
def clean_table(spark, sf):
    return rounded(clean.clean_table(orders_dirty(spark, sf)).table, 4)


@query(
    "clean_actions",
    f"WITH {ORDERS_DIRTY}, d AS (SELECT DISTINCT * FROM orders_dirty), t AS (SELECT *, {_number('price_text')} AS num FROM d) "
    "SELECT 'deduplicate' AS step, CAST(NULL AS VARCHAR) AS \"column\", 'drop' AS action, "
    "(SELECT count(*) FROM orders_dirty) - (SELECT count(*) FROM d) AS n_affected "
    "UNION ALL SELECT 'convert_text', 'price_text', 'to_number', count(num) FROM t "
    "UNION ALL SELECT 'impute_numeric', 'price', 'median', count(*) - count(price) FROM t "
    "UNION ALL SELECT 'impute_numeric', 'price_text', 'mean', count(*) - count(num) FROM t "
    "UNION ALL SELECT 'impute_categorical', 'priority', 'mode', count(*) - count(priority) FROM t",
)
def clean_actions(spark, sf):
    return clean.clean_table(orders_dirty(spark, sf)).actions.drop("value")


@query(
    "table_kpis",
    f"WITH {CLEANED}, c AS (SELECT count(*) AS n, "
    + " + ".join(f"(count(*) - count({c}))" for c, _, _ in _OD)
    + f" AS missing FROM cleaned), m AS (SELECT count(*) AS raw, {_CELLS} AS raw_missing FROM orders_dirty) "
    "SELECT n AS rows, n - raw AS rows_delta, CAST(9 AS BIGINT) AS columns, raw - n AS duplicates_removed, "
    "raw_missing AS raw_missing_cells, missing AS missing_cells FROM c, m",
)
def table_kpis(spark, sf):
    raw = orders_dirty(spark, sf)
    return audit.table_kpis(raw, clean.clean_table(raw).table)


# --- outliers ------------------------------------------------------------------------------------


def _fences(c: str, source: str) -> str:
    return (
        f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
        f"q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {source}"
    )


_BOUNDS = ("o_custkey", "price", "const_num")


@query(
    "iqr_bounds",
    f"WITH {ORDERS_DIRTY} "
    + _union(
        [
            f"SELECT '{c}' AS \"column\", {r('q1', 4)} AS q1, {r('q3', 4)} AS q3, {r('lo', 4)} AS lower, "
            f"{r('hi', 4)} AS upper, (SELECT count(*) FROM orders_dirty WHERE {c} < lo OR {c} > hi) AS n_outliers "
            f"FROM ({_fences(c, 'orders_dirty')})"
            for c in _BOUNDS
        ]
    ),
)
def iqr_bounds(spark, sf):
    return rounded(outliers.outlier_summary(orders_dirty(spark, sf), [*_BOUNDS, "priority"]), 4)


@query(
    "iqr_mask",
    f"WITH {ORDERS_DIRTY}, b AS ({_fences('price', 'orders_dirty')}) "
    "SELECT o_orderkey, coalesce(price < lo OR price > hi, false) AS is_outlier FROM orders_dirty, b",
)
def iqr_mask(spark, sf):
    df = orders_dirty(spark, sf)
    return df.select("o_orderkey", outliers.outlier_mask(df, "price").alias("is_outlier"))


@query(
    "iqr_cap",
    f"WITH {ORDERS_DIRTY}, b AS ({_fences('price', 'orders_dirty')}) SELECT o_orderkey, o_custkey, "
    f"{r('CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END', 4)} AS price FROM orders_dirty, b",
)
def iqr_cap(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "o_custkey", "price")
    return rounded(outliers.treat_outliers(df, ["o_custkey", "price"], "iqr", "cap").table, 4)


@query(
    "iqr_remove",
    f"WITH {ORDERS_DIRTY}, b AS ({_fences('price', 'orders_dirty')}), c AS ({_fences('o_custkey', 'orders_dirty')}) "
    "SELECT o_orderkey, o_custkey, price FROM orders_dirty, b, c "
    "WHERE NOT coalesce(price < b.lo OR price > b.hi, false) AND NOT (o_custkey < c.lo OR o_custkey > c.hi)",
)
def iqr_remove(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "o_custkey", "price")
    return outliers.treat_outliers(df, ["price", "o_custkey"], "iqr", "remove").table


@query("isolation_forest_remove")
def isolation_forest_remove(spark, sf):
    df = table(spark, sf, "orders")
    return outliers.treat_outliers(
        df, ["o_totalprice", "o_custkey"], "isolation_forest", "remove", keys=["o_orderkey"]
    ).table


@query("isolation_forest_planted", "SELECT p_partkey FROM part WHERE p_partkey % 20 = 7")
def isolation_forest_planted(spark, sf):
    """Rows far away in several directions, five in a hundred, are all that is flagged."""
    far = "CASE WHEN p_partkey % 20 = 7 THEN (1 + p_partkey % 3) * IF(p_partkey % 40 = 7, 1, -1) ELSE 0 END"
    df = table(spark, sf, "part").selectExpr("p_partkey", f"p_size + 1000 * {far} AS size", f"p_retailprice + 20000 * {far} AS price")
    return isolation.flag_isolated(df, ["size", "price"], keys=["p_partkey"]).where("is_outlier").select("p_partkey")


@query("isolation_forest_flags")
def isolation_forest_flags(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return isolation.flag_isolated(df, ["p_size", "p_retailprice"], keys=["p_partkey"])


@query(
    "isolation_forest_cap",
    f"WITH {ORDERS_DIRTY}, b AS ({_fences('price', 'orders_dirty')}) SELECT o_orderkey, "
    f"{r('CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END', 4)} AS price FROM orders_dirty, b",
)
def isolation_forest_cap(spark, sf):
    df = orders_dirty(spark, sf).select("o_orderkey", "price")
    return rounded(
        outliers.treat_outliers(df, ["price"], "isolation_forest", "cap", keys=["o_orderkey"]).table, 4
    )


def _describe_rows(source: str, columns: list[str], digits: int = 4) -> str:
    rows = []
    for c in columns:
        x = f"CAST({c} AS DOUBLE)"
        stats = [
            ("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"),
            ("p25", f"quantile_cont({x}, 0.25)"), ("p50", f"quantile_cont({x}, 0.5)"),
            ("p75", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})"),
            (
                "skewness",
                f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END",
            ),
            (
                "kurtosis",
                f"CASE WHEN count({c}) < 4 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE kurtosis({x}) END",
            ),
        ]
        rows.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", "
            + ", ".join(f'{r(e, digits)} AS "{n}"' for n, e in stats)
            + f" FROM {source}"
        )
    return _union(rows)


# Cleaned, capped and described: the whole cleaning chain in one query.
_CAPPED = (
    f"{CLEANED}, pb AS ({_fences('price', 'cleaned')}), capped AS (SELECT cleaned.* REPLACE "
    "(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END AS price) FROM cleaned, pb)"
)
_NUMBERS = ["o_orderkey", "o_custkey", "price", "price_text", "empty_num", "const_num"]


@query("clean_cap_describe", f"WITH {_CAPPED} {_describe_rows('capped', _NUMBERS)}")
def clean_cap_describe(spark, sf):
    # The cleaned and the treated table are kept between the steps, as a user of them would.
    cleaned = stage_table(clean.clean_table(orders_dirty(spark, sf)).table)
    treated = stage_table(outliers.treat_outliers(cleaned, numeric_columns(cleaned)).table)
    return rounded(describe.describe_numeric(treated, _NUMBERS), 4)


# --- findings ------------------------------------------------------------------------------------


def _findings(spark, sf):
    dirty = orders_dirty(spark, sf)
    pairs = correlations(dirty, "pearson", ["o_orderkey", "o_custkey", "price"])
    return report.combine_findings(
        spark,
        report.audit_findings(audit.audit_table(dirty), audit.audit_columns(dirty)),
        report.correlation_findings(top_correlations(pairs)),
    )


_FINDINGS = (
    f"WITH {ORDERS_DIRTY}, d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM orders_dirty)), "
    f"m AS (SELECT count(*) AS n, {_CELLS} AS missing FROM orders_dirty), "
    f"a AS (SELECT n, missing, n - k AS dup, {_pct('missing', 'n * 9')} AS mp, {_pct('n - k', 'n')} AS dp FROM m, d), "
    f"c AS ({_missing_rows('orders_dirty', [c for c, _, _ in _OD])}) "
    + _union(
        [
            f"SELECT 'audit' AS section, 'table' AS item, '{metric}' AS metric, {r(e)} AS value, "
            "CAST(NULL AS VARCHAR) AS text FROM a"
            for metric, e in [
                ("n_rows", "n"), ("n_columns", "9"), ("n_missing", "missing"), ("missing_pct", "mp"),
                ("n_duplicates", "dup"), ("duplicate_pct", "dp"), ("n_numeric", "5"), ("n_categorical", "4"),
            ]
        ]
        + [
            "SELECT 'missing', \"column\", 'n_missing', CAST(n_missing AS DOUBLE), "
            "concat(CAST(missing_pct AS VARCHAR), '%') FROM c WHERE n_missing > 0"
        ]
        + [
            f"SELECT 'correlations', '{x} | {y}', 'correlation', {r(f'corr({x}, {y})')}, NULL FROM orders_dirty"
            for x, y in [("o_orderkey", "o_custkey"), ("o_orderkey", "price"), ("o_custkey", "price")]
        ]
    )
)


@query("findings", _FINDINGS)
def findings(spark, sf):
    return rounded(_findings(spark, sf))


# The sections that a run of audit and correlations fills; the others say that they are empty.
_BRIEF = (
    f"WITH f AS ({_FINDINGS}), "
    "k(place, part, line) AS (VALUES (-1, 0, '# Orders'), (0, 0, '## 1. Data ingestion and audit'), (1, 0, '### Columns with missing values'), "
    "(1, 1, '| Column | Missing | Share |'), (1, 2, '|---|---|---|'), (2, 0, '## 2. Statistics' || chr(10) || chr(10) || '### Strongest correlations'), "
    "(2, 1, '| Variable 1 | Variable 2 | r |'), (2, 2, '|---|---|---|'), (3, 0, '### Hypothesis test'), (3, 1, '*No hypothesis test was run.*'), "
    "(4, 0, '## 3. Automated model choice'), (4, 1, '*No model was trained.*'), (5, 0, '### Feature importance'), (5, 1, '*No importances are available.*'), "
    "(6, 0, '## 4. Trend and forecast'), (6, 1, '*No forecast was made.*'), (7, 0, '## 5. Notes'), (7, 3, 'Damaged orders, before cleaning.')), "
    "x AS (SELECT *, CASE WHEN metric LIKE 'n\\_%' ESCAPE '\\' THEN format('{:.0f}', value) ELSE format('{:.4f}', value) END AS v FROM f), "
    "l AS (SELECT place, part, line, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS item FROM k "
    "UNION ALL SELECT -1, 1, '**Shape:** ' || (SELECT v FROM x WHERE metric = 'n_rows') || ' rows, ' || (SELECT v FROM x WHERE metric = 'n_columns') || ' columns', NULL, NULL "
    "UNION ALL SELECT 0, 3, '- **' || item || '** ' || metric || ': ' || v, value, item FROM x WHERE section = 'audit' "
    "UNION ALL SELECT 1, 3, '| ' || item || ' | ' || v || ' | ' || text || ' |', value, item FROM x WHERE section = 'missing' "
    "UNION ALL SELECT 2, 3, '| ' || item || ' | ' || v || ' |', value, item FROM x WHERE section = 'correlations') "
    "SELECT CAST(row_number() OVER (ORDER BY place, part, abs(value) DESC NULLS LAST, item, line) AS INTEGER) AS line_no, line AS text FROM l"
)


def _brief(spark, sf):
    return report.render_markdown(rounded(_findings(spark, sf)), "Orders", "Damaged orders, before cleaning.")


@query("markdown_brief", _BRIEF)
def markdown_brief(spark, sf):
    return _brief(spark, sf)


@query("report_file", f"WITH b AS ({_BRIEF}) SELECT unnest(string_split(text, chr(10))) AS text FROM b")
def report_file(spark, sf):
    folder = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/tablewise/{uuid.uuid4().hex}.md"
    report.write_markdown(_brief(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("text"))
