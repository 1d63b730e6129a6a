"""Views that damage the test tables by key arithmetic, written alike for Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
  CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 29 = 4 THEN NULL
       WHEN o_orderkey % 97 = 5 THEN o_totalprice * 25 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 23 = 6 THEN NULL
       WHEN o_orderkey % 41 = 7 THEN 'n/k' ELSE concat('$', {fmt}) END AS price_text,
  CAST(NULL AS DOUBLE) AS empty_num, 1.0E0 AS const_num
FROM {orders}
"""

_EVENTS = """
SELECT event_id, user_id, event_type,
  CASE WHEN event_id % 31 = 2 THEN 'not a date' ELSE {fmt} END AS ts_text, ts,
  CASE WHEN event_id % 19 = 1 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 43 = 2 OR (event_type = 'purchase' AND EXTRACT(DAY FROM ts) IN (5, 6, 17)) THEN NULL
       ELSE value END AS value
FROM {events}
"""

_CALENDAR = "%Y-%m-%d %H:%M:%S"

ORDERS_DIRTY = (
    "base AS ("
    + _ORDERS.format(fmt="format('{:,.2f}', o_totalprice)", orders="orders")
    + "), orders_dirty AS (SELECT * FROM base UNION ALL "
    "SELECT * FROM base WHERE o_orderkey % 50 = 0)"
)
EVENTS_DIRTY = (
    "events_raw AS ("
    + _EVENTS.format(fmt=f"strftime(ts, '{_CALENDAR}')", events="events")
    + "), events_dirty AS (SELECT * REPLACE "
    "(CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM events_raw)"
)


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing values, outliers, currency text and duplicate rows."""
    orders = table(spark, sf_dir, "orders")
    sql = _ORDERS.replace("{fmt}", "format_number(o_totalprice, 2)")
    base = spark.sql(sql, orders=orders)
    return base.unionAll(base.where("o_orderkey % 50 = 0"))


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with unparseable dates, NaN and NULL values, and days on which no purchase has a value."""
    sql = _EVENTS.replace("{fmt}", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))
