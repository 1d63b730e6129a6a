"""Isolation forest after Liu, Ting and Zhou (2008): grouped fit on samples, Arrow scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..schema import as_double, col

# The usual forest size and subsample of the published method.
N_TREES = 100
SUBSAMPLE = 256
EULER_GAMMA = 0.5772156649015329

_TREE_SCHEMA = "tree int, node int, feature int, threshold double, child int, depth double"


def _expected_depth(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """Nodes as (feature, threshold, left child, depth); the right child follows the left one.

    Leaves have feature -1 and carry their depth plus the expected depth of the points they hold.
    """
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple[int, float, int, float]] = [(-1, 0.0, -1, 0.0)]
    queue = [(0, points, 0)]
    while queue:
        at, subset, depth = queue.pop()
        low, high = subset.min(axis=0), subset.max(axis=0)
        splittable = np.flatnonzero(low < high)
        if depth >= limit or len(subset) <= 1 or len(splittable) == 0:
            nodes[at] = (-1, 0.0, -1, depth + _expected_depth(len(subset)))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        left = subset[:, feature] <= threshold
        child = len(nodes)
        nodes[at] = (feature, threshold, child, 0.0)
        nodes += [(-1, 0.0, -1, 0.0)] * 2
        queue += [(child, subset[left], depth + 1), (child + 1, subset[~left], depth + 1)]
    return nodes


def isolation_scores(
    df: DataFrame,
    columns: list[str],
    keys: list[str] | None = None,
    seed: int = 42,
    n_estimators: int = N_TREES,
    max_samples: int = SUBSAMPLE,
) -> DataFrame:
    """Add ``isolation_score`` in (0, 1); rows that are easily isolated score high.

    Missing cells are read as the column's median. Each of ``n_estimators`` trees draws about ``max_samples`` rows of
    its own from the whole table, by a hash of the row and the tree, and is fitted in its own group; the forest
    is broadcast to score every row. With ``keys`` (unique per row) the draw depends on the keys only, otherwise
    on the seed and the input splits.
    """
    spark = df.sparkSession
    medians = exact_quantiles(df, {c: as_double(df, c) for c in columns}, [0.5])
    fill = {c: medians[c][0] if medians[c][0] is not None else 0.0 for c in columns}
    vector = F.array(*[F.coalesce(as_double(df, c), F.lit(float(fill[c]))) for c in columns])
    rows = df.withColumn("_vector", vector)
    total = df.count()
    threshold = int(min(1.0, max_samples / max(total, 1)) * (1 << 30))
    if keys:
        first, second = (F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed + i)), F.lit(1 << 30)) for i in (0, 1))
    else:
        first, second = (F.floor(F.rand(seed + i) * (1 << 30)).cast("long") for i in (0, 1))
    # Two hashes a row give its draw in every tree: tree t has first + t * second, with second odd.
    drawn = rows.select("_vector", first.alias("_first"), (second.bitwiseOR(F.lit(1))).alias("_second"))
    trees = F.filter(
        F.sequence(F.lit(1), F.lit(n_estimators)),
        lambda t: F.pmod(F.col("_first") + t * F.col("_second"), F.lit(1 << 30)) < threshold,
    )

    def fit(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(members.sort_values("order")["_vector"].to_numpy())
        nodes = _grow(points, np.random.default_rng([seed, int(key[0])]))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "child", "depth"])
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "tree", int(key[0]))
        return out

    order = F.xxhash64("_first", "_second", "tree", F.lit(seed))
    chosen = drawn.withColumn("tree", F.explode(trees)).withColumn("order", order)
    forest = chosen.groupBy("tree").applyInPandas(fit, _TREE_SCHEMA).toPandas()
    grown = [
        (
            t["feature"].to_numpy(),
            t["threshold"].to_numpy(),
            t["child"].to_numpy(),
            t["depth"].to_numpy(),
        )
        for _, t in forest.sort_values(["tree", "node"]).groupby("tree")
    ]
    shared = spark.sparkContext.broadcast(grown)
    scale = _expected_depth(min(max_samples, max(total, 2)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            points = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(columns)))
            path = np.zeros(len(points))
            for feature, threshold, child, depth in shared.value:
                at = np.zeros(len(points), dtype=np.int64)
                while True:
                    split = feature[at]
                    inner = np.flatnonzero(split >= 0)
                    if len(inner) == 0:
                        break
                    here = at[inner]
                    right = points[inner, split[inner]] > threshold[here]
                    at[inner] = child[here] + right
                path += depth[at]
            yield pd.Series(np.power(2.0, -path / (len(shared.value) * scale)))

    return rows.withColumn("isolation_score", score("_vector")).drop("_vector")


def flag_isolated(
    df: DataFrame,
    columns: list[str],
    contamination: float = 0.05,
    keys: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Add ``isolation_score`` and ``is_outlier``, true above the contamination quantile."""
    from ..functions.staging import stage_table

    scored = stage_table(isolation_scores(df, columns, keys, seed))
    (cut,) = exact_quantiles(scored, ["isolation_score"], [1.0 - contamination])["isolation_score"]
    above = F.col("isolation_score") > (cut if cut is not None else 1.0)
    return scored.withColumn("is_outlier", above)
