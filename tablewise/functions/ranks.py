"""Average ranks with ties, computed on distinct values in range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .staging import stage_table


def average_ranks(freq: DataFrame, value: str, count: str, parts: list[str] | None = None) -> DataFrame:
    """Add ``rank`` to a table with one row per distinct ``value`` (within ``parts``).

    The table is range-partitioned by value and written with its partition number, which from
    then on is data: each bucket accumulates its own counts, and the buckets' totals (one row per
    bucket) give the offsets. Nothing is sorted in a single task, and a repeated value is one row.
    """
    parts = parts or []
    spark = freq.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = stage_table(
        freq.repartitionByRange(buckets, *parts, value).withColumn("_bucket", F.spark_partition_id())
    )
    group = [*parts, "_bucket"]
    earlier = (
        Window.partitionBy(*(parts or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        staged.groupBy(*group)
        .agg(F.sum(count).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    smaller = (
        Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = staged.withColumn("_before", F.coalesce(F.sum(count).over(smaller), F.lit(0)))
    n = F.col(count)
    rank = F.col("_offset") + F.col("_before") + (n + 1) / 2.0
    return (
        ranked.join(F.broadcast(offsets), group)
        .withColumn("rank", rank.cast("double"))
        .drop("_bucket", "_before", "_offset")
    )
