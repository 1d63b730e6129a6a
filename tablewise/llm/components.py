"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage_table

#: Rounds after which the links must have settled; a chain of n nodes takes about log2(n).
MAX_ROUNDS = 60


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: the smallest node that it can reach.

    Alternating star contractions: each node hands the smallest neighbour on, first to its larger
    neighbours, then to the others. A node's neighbours are never gathered: the smallest one is an
    aggregate, which is joined back to the links. Each round is stored, so that lineage stays short.
    Ends when every link leads straight to a root. Nodes without links are not listed.
    """
    links = _pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    links = stage_table(links)
    for _ in range(MAX_ROUNDS):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        # Larger neighbours of a node get its smallest neighbour (links hold them as a, the node as b).
        large = links.join(low.select(F.col("a").alias("b"), "low"), "b").select("a", F.col("low").alias("b"))
        large = _pairs(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("l")
        )
        links = stage_table(_pairs(small.select("l.a", "l.b")))
        # Settled: no node has two parents and no parent is itself a child.
        state = links.agg(F.count("a").alias("n"), F.count_distinct("a").alias("children")).first()
        chained = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if state.n == state.children and chained.isEmpty():
            roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")


def _pairs(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") > F.col("b")).distinct()
