"""Join a large table to a keyed lookup table without overloading the task of a frequent key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_SHARE = 2_000  # a key holding more than 1/2000 of the rows is hot: at most 2000 keys are


def attach(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner-join ``rows`` to ``table``, whose ``on`` columns are unique, in one pass over the rows.

    ``weight`` is the table column that counts the rows carrying each key, ``total`` their sum. Hot keys, whose number
    is bounded by their share, are broadcast. The rest of the table is joined as its size suggests; where that is
    a shuffle, rows of hot keys go to partitions of their own choice, as they look for nothing there.
    """
    values = [c for c in table.columns if c not in on]
    is_hot: Column = F.col(weight) * HOT_SHARE > total
    hot = table.where(is_hot).select(*on, F.struct(*values).alias("_hot"))
    cold = table.where(~is_hot).select(*on, F.lit(0).alias("_spread"), F.struct(*values).alias("_cold"))
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SHARE)).cast("int"))
    marked = rows.join(F.broadcast(hot), on, "left").withColumn("_spread", spread)
    found = marked.join(cold, [*on, "_spread"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.where(F.col("_found").isNotNull()).select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])
