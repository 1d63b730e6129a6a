"""Model quality from scored tables, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ranks import average_ranks


def classification_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, precision, recall, f1), the last three averaged over classes without weights.

    The confusion counts are grouped once; classes that occur only as label or only as prediction
    count with 0, as does an undefined ratio.
    """
    cells = (
        scored.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("l IS NOT NULL AND p IS NOT NULL")
    )
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("l").alias("c"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("g"), hit.cast("bigint").alias("h")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("h")),
    )
    per_class = (
        cells.select(F.explode(sides).alias("s"))
        .groupBy("s.c")
        .agg(F.sum("s.t").alias("t"), F.sum("s.g").alias("g"), F.sum("s.h").alias("h"))
    )
    zero = F.lit(0.0)
    return per_class.agg(
        F.try_divide(F.sum("h"), F.sum("t")).alias("accuracy"),
        F.avg(F.coalesce(F.try_divide(F.col("h"), F.col("g")), zero)).alias("precision"),
        F.avg(F.coalesce(F.try_divide(F.col("h"), F.col("t")), zero)).alias("recall"),
        F.avg(F.coalesce(F.try_divide(F.col("h") * 2, F.col("t") + F.col("g")), zero)).alias("f1"),
    )


def roc_auc_per_class(scored: DataFrame, label: str, classes: list, scores: str) -> DataFrame:
    """(class, n_pos, n_neg, auc): one class against the rest, ties by average rank.

    ``scores`` is an array with one score per entry of ``classes``. All classes are ranked in one
    pass over (class, score) counts; a class without positives or negatives has no value.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("class"),
                F.col(scores)[i].cast("double").alias("score"),
                (F.col(label) == F.lit(c)).cast("int").alias("hit"),
            )
            for i, c in enumerate(classes)
        ]
    )
    freq = (
        scored.select(F.explode(entries).alias("e"))
        .groupBy("e.class", "e.score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("e.hit").alias("pos"))
    )
    ranked = average_ranks(freq, "score", "n", ["class"])
    sums = ranked.groupBy("class").agg(
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("n") - F.col("pos")).alias("n_neg"),
        F.sum(F.col("pos") * F.col("rank")).alias("r"),
    )
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return sums.select(
        "class", "n_pos", "n_neg", F.try_divide(F.col("r") - p * (p + 1) / 2.0, p * q).alias("auc")
    )


def roc_auc(scored: DataFrame, label: str, classes: list, scores: str) -> DataFrame:
    """(roc_auc): P(second class) for two classes, else the mean over classes; 0.5 if undefined."""
    per_class = roc_auc_per_class(scored, label, classes, scores)
    if len(classes) == 2:
        per_class = per_class.where(F.col("class") == 1)
    complete = F.count("auc") == F.lit(1 if len(classes) == 2 else len(classes))
    return per_class.agg(F.when(complete, F.avg("auc")).otherwise(0.5).alias("roc_auc"))


def regression_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """(r2, mae, rmse)."""
    gap = F.col(label) - F.col(prediction)
    sums = scored.agg(
        F.sum(gap * gap).alias("sse"),
        (F.var_pop(label) * F.count(label)).alias("sst"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )
    constant = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("sst") > 0, 1.0 - F.try_divide(F.col("sse"), F.col("sst"))).otherwise(constant)
    return sums.select(r2.alias("r2"), "mae", "rmse")
