"""Queries for task detection, features, model quality, AutoML and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import automl, features, metrics
from .dirty import ORDERS_DIRTY, orders_dirty
from .quality import _union
from .registry import query, r, rounded, table


@query(
    "task_detection",
    _union(
        [
            f"SELECT '{c}' AS target, CASE WHEN {'true' if text else 'false'} OR count(DISTINCT {c}) <= 10 "
            "THEN 'classification' ELSE 'regression' END AS task_type FROM lineitem"
            for c, text in [
                ("l_linenumber", False), ("l_quantity", False), ("l_discount", False), ("l_tax", False),
                ("l_extendedprice", False), ("l_returnflag", True),
            ]
        ]
    ),
)
def task_detection(spark, sf):
    targets = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"]
    return features.task_types(table(spark, sf, "lineitem"), targets)


def _selection_row(source: str, c: str, text: bool) -> str:
    n_unique = f"count(DISTINCT {c})"
    ident = f"WHEN count(DISTINCT {c}) * 1.0 / count(*) > 0.95 AND count(DISTINCT {c}) > 50 THEN 'looks like an identifier'"
    return (
        f"SELECT '{c}' AS \"column\", {r(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct, "
        f"CAST({n_unique} AS BIGINT) AS n_unique, CASE WHEN (count(*) - count({c})) * 1.0 / count(*) > 0.9 THEN 'too many missing values' "
        f"WHEN ({n_unique}) <= 1 THEN 'single unique value' {ident if text else ''} END AS reason FROM {source}"
    )


@query(
    "feature_selection",
    f"WITH {ORDERS_DIRTY}, f AS ("
    + _union(
        [
            _selection_row("orders_dirty", c, text)
            for c, text in [
                ("o_orderkey", False), ("o_custkey", False), ("o_orderdate", False), ("priority", True),
                ("price", False), ("price_text", True), ("empty_num", False), ("const_num", False),
            ]
        ]
    )
    + ') SELECT "column", missing_pct, n_unique, reason IS NULL AS kept, reason FROM f',
)
def feature_selection(spark, sf):
    return rounded(features.feature_selection(orders_dirty(spark, sf), "o_orderstatus"))


@query(
    "feature_selection_ids",
    "WITH f AS ("
    + _union([_selection_row("customer", c, t) for c, t in [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_mktsegment", True)]])
    + ') SELECT "column", missing_pct, n_unique, reason IS NULL AS kept, reason FROM f',
)
def feature_selection_ids(spark, sf):
    return rounded(features.feature_selection(table(spark, sf, "customer"), "c_acctbal"))


@query(
    "preprocess",
    f"WITH {ORDERS_DIRTY}, f AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM orders_dirty)) AS x, "
    "coalesce(priority, (SELECT priority FROM orders_dirty WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS p FROM orders_dirty), "
    "m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f) "
    f"SELECT o_orderkey, {r('(x - mu) / sd')} AS z, p AS filled, "
    "CAST(list_position((SELECT list(DISTINCT p ORDER BY p) FROM f), p) - 1 AS BIGINT) AS hot FROM f, m",
)
def preprocess(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = orders_dirty(spark, sf).select("o_orderkey", "price", "priority")
    fitted = automl.fit_preprocessor(df, ["price"], ["priority"])
    v = vector_to_array("features")
    common = F.coalesce("priority", F.lit(fitted.common["priority"]))
    out = fitted.transform(df).select(
        "o_orderkey",
        v[0].alias("z"),
        common.alias("filled"),
        (F.array_position(F.slice(v, 2, 100), 1.0) - 1).alias("hot"),
    )
    return rounded(out)


# A fixed score from the keys stands in for a model, so that the metrics can be checked.
_SCORED = (
    "s AS (SELECT l_orderkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label, "
    "(l_partkey % 97) / 97.0 + l_quantity / 200.0 AS score FROM lineitem)"
)


def _scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("label"),
        ((F.col("l_partkey") % 97) / 97.0 + F.col("l_quantity") / 200.0).alias("score"),
    )


def _macro_sql(classes: str) -> str:
    """Macro metrics from l(label, p(rediction)) in a CTE named z and classes in k."""
    return (
        f"k AS ({classes}), t AS (SELECT k, (SELECT count(*) FROM z WHERE l = k) AS n, (SELECT count(*) FROM z WHERE p = k) AS g, "
        "(SELECT count(*) FROM z WHERE l = k AND p = k) AS h FROM k) "
        f"SELECT {r('sum(h) * 1.0 / sum(n)')} AS accuracy, {r('avg(coalesce(h * 1.0 / nullif(g, 0), 0))')} AS precision, "
        f"{r('avg(coalesce(h * 1.0 / nullif(n, 0), 0))')} AS recall, {r('avg(coalesce(2.0 * h / nullif(n + g, 0), 0))')} AS f1 FROM t"
    )


_EITHER = "SELECT l AS k FROM z UNION SELECT p FROM z"


@query(
    "binary_metrics",
    f"WITH {_SCORED}, z AS (SELECT label AS l, CASE WHEN score > 0.6 THEN 1 ELSE 0 END AS p FROM s), {_macro_sql(_EITHER)}",
)
def binary_metrics(spark, sf):
    df = _scored(spark, sf).withColumn("prediction", F.when(F.col("score") > 0.6, 1).otherwise(0))
    return rounded(metrics.classification_metrics(df, "label", "prediction"))


@query(
    "multiclass_metrics",
    "WITH z AS (SELECT o_orderpriority AS l, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority WHEN o_custkey % 3 = 1 THEN '5-LOW' ELSE '6-NONE' END AS p "
    f"FROM orders), {_macro_sql(_EITHER)}",
)
def multiclass_metrics(spark, sf):
    guess = (
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))
        .when(F.col("o_custkey") % 3 == 1, "5-LOW")
        .otherwise("6-NONE")
    )
    df = table(spark, sf, "orders").withColumn("guess", guess)
    return rounded(metrics.classification_metrics(df, "o_orderpriority", "guess"))


def _auc(label: str, score: str, source: str) -> str:
    return (
        f"(SELECT (sum(CASE WHEN hit = 1 THEN rk END) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)) * 1.0) FROM "
        f"(SELECT {label} AS hit, CAST(rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS DOUBLE) AS rk FROM {source}))"
    )


@query("roc_auc", f"WITH {_SCORED} SELECT {r(_auc('label', 'score', 's'))} AS roc_auc")
def roc_auc(spark, sf):
    df = _scored(spark, sf).withColumn("scores", F.array(1.0 - F.col("score"), "score"))
    return rounded(metrics.roc_auc(df, "label", [0, 1], "scores"))


_FLAGS = ["A", "N", "R"]


@query(
    "roc_auc_multiclass",
    "WITH s AS (SELECT l_returnflag AS label, CAST((l_partkey % (7 + k)) / 10.0 + (CASE WHEN l_returnflag = f THEN 0.05 ELSE 0 END) AS DOUBLE) AS score, f "
    "FROM lineitem, (VALUES ('A', 0), ('N', 1), ('R', 2)) v(f, k)) SELECT "
    + r(
        "("
        + " + ".join(
            _auc(f"CASE WHEN label = '{c}' THEN 1 ELSE 0 END", "score", f"(SELECT * FROM s WHERE f = '{c}')")
            for c in _FLAGS
        )
        + ") / 3"
    )
    + " AS roc_auc",
)
def roc_auc_multiclass(spark, sf):
    scores = [
        (F.col("l_partkey") % (7 + k)) / 10.0 + F.when(F.col("l_returnflag") == c, 0.05).otherwise(0.0)
        for k, c in enumerate(_FLAGS)
    ]
    df = table(spark, sf, "lineitem").select("l_returnflag", F.array(*scores).alias("scores"))
    return rounded(metrics.roc_auc(df, "l_returnflag", _FLAGS, "scores"))


@query(
    "regression_metrics",
    "WITH s AS (SELECT l_extendedprice AS y, l_quantity * 2000 + (l_partkey % 10) AS p FROM lineitem) "
    f"SELECT {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2, {r('avg(abs(y - p))', 4)} AS mae, "
    f"{r('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse FROM s",
)
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 2000 + F.col("l_partkey") % 10).alias("p"),
    )
    return rounded(metrics.regression_metrics(df, "y", "p"), 4, r2=6)


def _described(spark, sf):
    """Figures of every document's whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.split(text, "\n"))
    words = F.size(F.split(F.trim(text), "\\s+"))
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars", lines.alias("n_lines"), words.alias("n_words"), (F.length(text) / words).alias("word_length")
    )


@query("automl_classification")
def automl_classification(spark, sf):
    """Fitted on the labelled documents, applied to all."""
    documents = _described(spark, sf)
    labelled = documents.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return automl.run_automl(labelled, "toxic", ["doc_id"]).score(documents).select("doc_id", "prediction")


# Three classes of a rule that no plane parts, but a tree does.
_RULE = "CASE WHEN p_partkey % 7 > 3 AND p_size % 5 < 2 THEN 'both' WHEN p_partkey % 7 > 3 OR p_size % 5 < 2 THEN 'one' ELSE 'none' END"


@query("automl_rule", f"SELECT p_partkey, {_RULE} AS prediction FROM part")
def automl_rule(spark, sf):
    """Three classes, so that boosting is one against the rest; the best model is tuned and reproduces the rule on every row."""
    df = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey % 7 AS seven", "p_size % 5 AS five", f"{_RULE} AS class")
    model = automl.run_automl(df, "class", ["p_partkey"], max_depth=6)
    return model.score(df.drop("class")).select("p_partkey", "prediction")


@query("automl_regression")
def automl_regression(spark, sf):
    """Every column is read: whether names are a feature is for the operator to find."""
    df = table(spark, sf, "customer")
    return automl.run_automl(df, "c_acctbal", ["c_custkey"]).score(df)


@query("kmeans")
def kmeans(spark, sf):
    df = table(spark, sf, "customer").drop("c_name")
    return automl.cluster_sizes(automl.run_automl(df, None, ["c_custkey"]), df)


# Targets that are exact functions of the features: the right model reproduces them.
_PLANE = "3.0 * p_size + 0.01 * p_retailprice + 7"


def _plane(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "p_size", "p_retailprice", f"{_PLANE} AS target")


@query("automl_plane", f"SELECT p_partkey, {r(_PLANE, 3)} AS prediction FROM part")
def automl_plane(spark, sf):
    df = _plane(spark, sf)
    model = automl.run_automl(df, "target", ["p_partkey"], max_depth=6)
    return rounded(model.score(df.drop("target")).select("p_partkey", "prediction"), 3)


@query(
    "automl_plane_importance",
    "WITH s AS (SELECT 3.0 * stddev_pop(p_size) AS a, 0.01 * stddev_pop(p_retailprice) AS b FROM part) "
    "SELECT 1 AS place, CASE WHEN a > b THEN 'p_size' ELSE 'p_retailprice' END AS feature FROM s "
    "UNION ALL SELECT 2, CASE WHEN a > b THEN 'p_retailprice' ELSE 'p_size' END FROM s",
)
def automl_plane_importance(spark, sf):
    found = automl.run_automl(_plane(spark, sf), "target", ["p_partkey"], max_depth=6).feature_importance().collect()
    return spark.createDataFrame([(i + 1, x["feature"]) for i, x in enumerate(found)], "place int, feature string")


_SPLIT = "SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0"


@query("split_is_by_key", f"SELECT o_orderkey, 1 AS sides FROM ({_SPLIT}) GROUP BY o_orderkey")
def split_is_by_key(spark, sf):
    """Equal keys fall on the same side, and every row is on one."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    rows = orders.unionAll(orders.where("o_orderkey % 3 = 0")).repartition(5)
    marked = rows.withColumn("test", automl.split_rows(rows, ["o_orderkey"]))
    return marked.groupBy("o_orderkey").agg(F.count_distinct("test").cast("int").alias("sides"))


@query("kmeans_planted", "SELECT count(*) AS n FROM part GROUP BY p_partkey % 3")
def kmeans_planted(spark, sf):
    """Three clusters far apart: their number and sizes are found."""
    parts = table(spark, sf, "part")
    df = parts.selectExpr("p_partkey", "p_partkey % 3 * 100.0 + p_size % 5 AS x", "p_partkey % 3 * 100.0 + p_size % 7 AS y")
    return automl.cluster_sizes(automl.run_automl(df, None, ["p_partkey"]), df).select(F.col("count").alias("n"))
