"""Findings of all operators as one long table, and a Markdown brief made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TOP_IMPORTANCES = 10  # fixed value
SCHEMA = "section string, item string, metric string, value double, text string"
_COLUMNS = ["section", "item", "metric", "value", "text"]


def audit_findings(table: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows from :func:`audit_table` and the columns with missing cells of :func:`audit_columns`."""
    figures = [
        "n_rows", "n_columns", "n_missing", "missing_pct", "n_duplicates", "duplicate_pct",
        "n_numeric", "n_categorical",
    ]
    whole = table.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("value"))
                    for f in figures
                ]
            )
        ).alias("f")
    ).select(
        F.lit("audit").alias("section"), F.lit("table").alias("item"), "f.metric", "f.value",
        F.lit(None).cast("string").alias("text"),
    )
    missing = columns.where("n_missing > 0").select(
        F.lit("missing").alias("section"),
        F.col("column").alias("item"),
        F.lit("n_missing").alias("metric"),
        F.col("n_missing").cast("double").alias("value"),
        F.format_string("%s%%", F.col("missing_pct")).alias("text"),
    )
    return whole.unionByName(missing)


def correlation_findings(top: DataFrame) -> DataFrame:
    return top.select(
        F.lit("correlations").alias("section"),
        F.concat_ws(" | ", "var1", "var2").alias("item"),
        F.lit("correlation").alias("metric"),
        F.col("correlation").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )


def hypothesis_findings(result: DataFrame) -> DataFrame:
    pair = F.format_string("`%s` vs. `%s`", "var1", "var2")
    rows = F.array(
        F.struct(F.lit("statistic").alias("metric"), F.col("statistic").alias("value"), F.col("test_name").alias("text")),
        F.struct(F.lit("p_value").alias("metric"), F.col("p_value").alias("value"), F.col("interpretation").alias("text")),
    )
    return result.select(pair.alias("item"), F.explode(rows).alias("r")).select(
        F.lit("hypothesis").alias("section"), "item", "r.metric", "r.value", "r.text"
    )


def model_findings(model) -> DataFrame:
    """Metrics and the strongest features of a fitted :class:`AutoMLModel`."""
    metrics = model.metrics_df().select(
        F.lit("model").alias("section"),
        F.lit(model.model_name).alias("item"),
        "metric",
        "value",
        F.lit(model.task_type).alias("text"),
    )
    if model.task_type == "clustering":
        return metrics
    top = model.feature_importance(TOP_IMPORTANCES).select(
        F.lit("importance").alias("section"),
        F.col("feature").alias("item"),
        F.lit("importance").alias("metric"),
        F.col("importance").alias("value"),
        F.lit(None).cast("string").alias("text"),
    )
    return metrics.unionByName(top)


def forecast_findings(
    metrics: DataFrame, date_col: str, target_col: str, freq: str, horizon: int | None = None
) -> DataFrame:
    """Figures of a forecast; ``horizon`` is its number of steps of the frequency."""
    names = ["historical_growth_pct", "model_r2", "forecast_average", "forecast_pct_change"]
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names],
        *([F.struct(F.lit("horizon").alias("metric"), F.lit(float(horizon)).alias("value"))] if horizon else []),
    )
    return metrics.select("forecast_direction", F.explode(rows).alias("r")).select(
        F.lit("forecast").alias("section"),
        F.lit(f"{target_col} by {date_col} ({freq})").alias("item"),
        "r.metric",
        "r.value",
        F.col("forecast_direction").alias("text"),
    )


def combine_findings(spark: SparkSession, *parts: DataFrame | None) -> DataFrame:
    """One long table (section, item, metric, value, text) of whatever parts exist."""
    out = spark.createDataFrame([], SCHEMA)
    for part in parts:
        if part is not None:
            out = out.unionByName(part.select(*_COLUMNS))
    return out


# Section, place, heading, table header, line for an empty section.
_HEADINGS = [
    ("audit", 0, "## 1. Data ingestion and audit", None, None),
    ("missing", 1, "### Columns with missing values", "| Column | Missing | Share |", "No column has missing values."),
    ("correlations", 2, "## 2. Statistics\n\n### Strongest correlations", "| Variable 1 | Variable 2 | r |", "No numeric column pair."),
    ("hypothesis", 3, "### Hypothesis test", None, "No hypothesis test was run."),
    ("model", 4, "## 3. Automated model choice", None, "No model was trained."),
    ("importance", 5, "### Feature importance", "| Feature | Importance |", "No importances are available."),
    ("forecast", 6, "## 4. Trend and forecast", None, "No forecast was made."),
    ("notes", 7, "## 5. Notes", None, None),
]


def render_markdown(findings: DataFrame, title: str = "Analytics report", notes: str = "") -> DataFrame:
    """(line_no, text) of the brief: the table's shape, then a heading per section, its findings or a line saying none.

    Missing cells, correlations and importances are tables, the rest are lists. ``findings`` holds a few rows per column and
    test, so numbering its lines is cheap.
    """
    spark = findings.sparkSession
    order = spark.createDataFrame(_HEADINGS, "section string, place int, heading string, header string, none string")
    first = spark.createDataFrame([(-1, 0, f"# {title}")], "place int, part int, line string")
    shape = findings.where("section = 'audit'").agg(
        F.max(F.when(F.col("metric") == "n_rows", F.col("value"))).alias("n"),
        F.max(F.when(F.col("metric") == "n_columns", F.col("value"))).alias("k"),
    )
    shape = shape.where("n IS NOT NULL").select(
        F.lit(-1).alias("place"), F.lit(1).alias("part"), F.format_string("**Shape:** %.0f rows, %.0f columns", "n", "k").alias("line")
    )
    headings = order.select("place", F.lit(0).alias("part"), F.col("heading").alias("line"))
    used = findings.select("section").distinct()
    absent = (
        order.join(used, "section", "left_anti")
        .where("none IS NOT NULL")
        .select("place", F.lit(1).alias("part"), F.format_string("*%s*", "none").alias("line"))
    )
    rule = F.regexp_replace(F.regexp_replace("header", "[^|]+", "---"), "[|]---$", "|")
    headers = order.join(used, "section", "left_semi").where("header IS NOT NULL")
    tables = headers.select("place", F.lit(1).alias("part"), F.col("header").alias("line")).unionByName(
        headers.select("place", F.lit(2).alias("part"), rule.alias("line"))
    )
    number = F.format_string("%.4f", F.col("value"))
    number = F.when(F.col("metric") == "importance", F.format_string("%.2f%%", F.col("value") * 100.0)).otherwise(number)
    number = F.when(F.col("metric") == "p_value", F.format_string("%.4e", F.col("value"))).otherwise(number)
    whole = F.col("metric").startswith("n_") | (F.col("metric") == "horizon")
    number = F.when(whole, F.format_string("%.0f", F.col("value"))).otherwise(number)
    text = F.when(F.col("text").isNotNull(), F.concat(F.lit(" ("), "text", F.lit(")"))).otherwise("")
    listed = F.concat(F.lit("- **"), "item", F.lit("** "), "metric", F.lit(": "), number, text)
    cell = F.when(F.col("text").isNotNull(), F.concat(F.lit(" | "), "text")).otherwise("")
    row = F.concat(F.lit("| "), "item", F.lit(" | "), number, cell, F.lit(" |"))
    body = findings.join(F.broadcast(order.select("section", "place", "header")), "section").select(
        "place",
        F.lit(3).alias("part"),
        F.when(F.col("header").isNull(), listed).otherwise(row).alias("line"),
        "value",
        "item",
    )
    closing = spark.createDataFrame([(7, 3, notes)], "place int, part int, line string")
    lines = first.unionByName(shape).unionByName(headings).unionByName(tables).unionByName(absent).unionByName(closing)
    lines = lines.withColumns({"value": F.lit(None).cast("double"), "item": F.lit(None).cast("string")})
    ranked = lines.unionByName(body)
    w = Window.partitionBy(F.lit(0)).orderBy(
        "place", "part", F.desc_nulls_last(F.abs("value")), "item", "line"
    )
    return ranked.select(F.row_number().over(w).alias("line_no"), F.col("line").alias("text"))


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write the brief as one text file in the folder ``path``."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("text").write.text(path)
