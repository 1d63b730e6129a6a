"""Random forest classifier whose nodes stay in tasks until they are a few bytes each.

Spark's forest sends the best split of every node to the driver as Java objects with the class counts on both sides, so
that unlimited depth on noisy labels outgrows the driver. Here features are cut into bins once and equal rows are
counted. While a node holds many rows, its histograms are summed in a shuffle; the rows of smaller nodes are dealt by
tree and node, and each group grows its subtree to the end. Only finished nodes are sent, as packed arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage_table

# Fixed values, those of Spark's forest.
BINS = 32
MIN_GAIN = 1e-12

# Limits of this implementation.
GROUP_CELLS = 1 << 22  # a group's rows times its features, or times the bins and classes of a node
TASK_BYTES = 32 << 20
FEW_VALUES = 40  # features of about as many values have these read

_SUBTREE = "tree int, node int, feature binary, cut binary, gain binary, value binary"
_SPLIT = "slot int, feature int, cut int, gain double, rows_left long, rows_right long, counts_left binary, counts_right binary"


def _cuts(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """Up to 31 ascending cuts a feature: between all its values if these are few, else at quantiles; zeros are not sent."""
    cells = F.filter(
        F.transform(F.col("a"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda x: x["v"] != 0
    )
    entries = vectors.select(F.explode(cells).alias("x")).select("x.i", "x.v")
    steps = [j / BINS for j in range(1, BINS)]
    found = {
        r["i"]: r for r in entries.groupBy("i").agg(
            F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("kinds"), F.percentile_approx("v", steps).alias("q"),
            F.max("v").alias("high"),
        ).collect()
    }
    rows = vectors.count()
    few = [(i,) for i, r in found.items() if r["kinds"] <= FEW_VALUES]
    values: dict[int, list[float]] = {}
    if few:
        named = vectors.sparkSession.createDataFrame(few, "i int")
        for r in entries.join(F.broadcast(named), "i").distinct().collect():
            values.setdefault(r["i"], []).append(r["v"])
    out = [np.empty(0)] * width
    for i, r in found.items():
        zeros = [0.0] if r["n"] < rows else []
        known = np.array(sorted(values.get(i, []) + zeros))
        if i in values and len(known) <= BINS:
            out[i] = (known[:-1] + known[1:]) / 2
            continue
        at = np.union1d(r["q"], zeros)
        if len(at) >= BINS:  # zero is one more: it takes the place of the quantile next to it
            at = np.delete(at, np.argsort(np.abs(at))[1])
        out[i] = at[at < max([r["high"], *zeros])]
    return out


def _binned(cells: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(cells.shape, np.uint8)
    for i, at in enumerate(cuts):
        if len(at):
            out[:, i] = np.searchsorted(at, cells[:, i], side="left")
    return out


def _unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)


def _drawn(ids: np.ndarray, counts: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree draws each row: a sum of Poisson(1) draws for equal rows, the same in whatever task."""
    out = np.empty((len(ids), trees), np.int64)
    for i, (key, n) in enumerate(zip(ids, counts)):
        out[i] = np.random.Generator(np.random.Philox(key=int(key) & (2**64 - 1))).poisson(n, trees)
    return out


def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node at which each row ends; nodes are (feature or -1, cut, left child), the right child follows the left one."""
    feature, cut, left = tree
    at = np.zeros(len(bins), np.int64)
    inner = np.arange(len(bins))
    while True:
        here = at[inner]
        going = feature[here] >= 0
        inner, here = inner[going], here[going]
        if len(inner) == 0:
            return at
        at[inner] = left[here] + (bins[inner, feature[here]] > cut[here])


def _best_cut(hist: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) of each node from its class counts by bin (node, bin, class); the gain is Gini's times the rows."""
    below = hist.cumsum(axis=1)
    total = below[:, -1]
    left, right = below[:, :-1], total[:, None] - below[:, :-1]
    n_left, n_right = left.sum(axis=2), right.sum(axis=2)
    n = n_left[:, :1] + n_right[:, :1]
    pure = (left**2).sum(axis=2) / np.maximum(n_left, 1) + (right**2).sum(axis=2) / np.maximum(n_right, 1)
    gain = pure - (total**2).sum(axis=1)[:, None] / np.maximum(n, 1)
    gain[(n_left < min_rows) | (n_right < min_rows) | (gain <= MIN_GAIN * n)] = 0.0
    cut = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), cut], cut


def _subsets(rng: np.random.Generator, nodes: int, width: int) -> np.ndarray:
    """The features each node may use: the root of their number, as Spark's forest takes by default."""
    size = math.ceil(math.sqrt(width))
    return np.argpartition(rng.random((nodes, width)), size - 1, axis=1)[:, :size]


def _grow(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: int, depth: int, min_rows: int, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, gain of inner nodes, class counts of leaves) level by level; the r-th inner node's children are 2r+1 and 2r+2."""
    at, size = np.zeros(len(bins), np.int64), 1
    levels: list[tuple[np.ndarray, ...]] = []
    for level in range(depth + 1):
        feature, cut, best = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size)
        if level < depth:
            chosen = _subsets(rng, size, bins.shape[1])
            for j in range(chosen.shape[1]):
                used = chosen[:, j]
                cell = (at * BINS + bins[np.arange(len(at)), used[at]]) * classes + labels
                hist = np.bincount(cell, weights, size * BINS * classes).reshape(size, BINS, classes)
                gain, where = _best_cut(hist, min_rows)
                better = gain > best
                feature[better], cut[better], best[better] = used[better], where[better], gain[better]
        inner = feature >= 0
        counts = np.bincount(at * classes + labels, weights, size * classes).reshape(size, classes)
        levels.append((feature, cut, best[inner], counts[~inner]))
        size = 2 * int(inner.sum())
        if size == 0:
            break
        going = inner[at]
        bins, labels, weights, at = bins[going], labels[going], weights[going], at[going]
        at = 2 * (np.cumsum(inner) - 1)[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
    return tuple(np.concatenate(part) for part in zip(*levels))


class _Tree:
    """A tree on the driver: its nodes so far, and the open ones with (rows, depth)."""

    def __init__(self, rows: int, classes: int):
        self.feature, self.cut, self.left, self.gain = [-1], [0], [0], [0.0]
        self.value = [np.zeros(classes)]
        self.open = {0: (rows, 0)}

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.uint8), np.array(self.left, np.int64)

    def split(self, node: int, found) -> None:
        depth = self.open.pop(node)[1] + 1
        if found["gain"] <= 0:  # a leaf
            self.value[node] = sum(np.frombuffer(found[f"counts_{side}"]) for side in ("left", "right"))
            return
        self.feature[node], self.cut[node], self.gain[node] = found["feature"], found["cut"], found["gain"]
        self.left[node] = len(self.feature)
        for side in ("left", "right"):
            self.open[len(self.feature)] = (found[f"rows_{side}"], depth)
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.gain.append(0.0)
            self.value.append(np.frombuffer(found[f"counts_{side}"]))

    def joined(self, subtrees: dict[int, tuple], classes: int) -> tuple[np.ndarray, ...]:
        """(feature, cut, left, gain, class counts) with the subtrees in the place of open nodes."""
        feature, cut, left = self.arrays()
        gain, value = np.array(self.gain), np.array(self.value).reshape(-1, classes)
        parts = [[feature], [cut], [left], [gain], [value]]
        size = len(feature)
        for node, (f, c, g, v) in subtrees.items():
            inner = f >= 0
            children = np.where(inner, size + 2 * (np.cumsum(inner) - 1), 0)
            gains, values = np.zeros(len(f)), np.zeros((len(f), classes))
            gains[inner], values[~inner] = g, v
            for whole, part in zip(parts, (f, c, children, gains, values)):
                whole[0][node] = part[0]
                whole.append(part[1:])
            size += len(f) - 1
        return tuple(np.concatenate(p) for p in parts)


class ForestClassifier(Estimator):
    """Bagged trees on ``features`` and ``label`` (0.0, 1.0, ...); a tree draws rows and its nodes draw features."""

    def __init__(self, classes: int, trees: int, depth: int, min_rows: int, seed: int):
        super().__init__()
        self.classes, self.trees, self.depth, self.min_rows, self.seed = classes, trees, depth, min_rows, seed

    def _fit(self, dataset: DataFrame) -> ForestModel:
        classes, trees, min_rows, seed = self.classes, self.trees, self.min_rows, self.seed
        vectors = dataset.select(vector_to_array("features").alias("a"), F.col("label").cast("int").alias("label"))
        first = vectors.first()
        if first is None:
            raise ValueError("No training rows.")
        width = len(first["a"])
        cuts = _cuts(vectors, width)

        @F.pandas_udf("binary")
        def pack(cells: pd.Series) -> pd.Series:
            bins = _binned(np.stack(cells.to_numpy()), cuts) if len(cells) else np.empty((0, width), np.uint8)
            return pd.Series([b.tobytes() for b in bins], dtype=object)

        counted = vectors.select(pack("a").alias("bins"), "label").groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n"))
        # Draws go by the row and sums are of whole numbers, so that the same cuts give the same trees however rows are dealt.
        rows = stage_table(counted.withColumn("id", F.xxhash64("bins", "label", F.lit(seed))))
        total = rows.count()
        most = max(GROUP_CELLS // max(width, BINS * classes), 64)
        grown = [_Tree(total, classes) for _ in range(trees)]
        while large := [(t, node) for t, tree in enumerate(grown) for node, (n, d) in tree.open.items() if n > most and d < self.depth]:
            slots = max(GROUP_CELLS // (math.ceil(math.sqrt(width)) * BINS * (classes + 1)), 1)
            for i in range(0, len(large), slots):
                self._split(rows, grown, large[i : i + slots], width)
        for tree in grown:
            for node in [node for node, (_, depth) in tree.open.items() if depth >= self.depth]:
                del tree.open[node]
        return ForestModel(self._finish(rows, grown, width, total), cuts, width, classes)

    def _split(self, rows: DataFrame, grown: list[_Tree], large: list[tuple[int, int]], width: int) -> None:
        """Split the named nodes at the best cut of their summed histograms."""
        classes, trees, min_rows, seed = self.classes, self.trees, self.min_rows, self.seed
        chosen = np.concatenate([_subsets(np.random.default_rng([seed, t, node]), 1, width) for t, node in large])
        by_tree: dict[int, list[int]] = {}
        for slot, (t, _) in enumerate(large):
            by_tree.setdefault(t, []).append(slot)
        walks = {t: (grown[t].arrays(), slots, [large[s][1] for s in slots]) for t, slots in by_tree.items()}
        shared = rows.sparkSession.sparkContext.broadcast(walks)
        channels = classes + 1  # the classes' draws, then the rows

        def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(large), chosen.shape[1], BINS, channels))
            for batch in batches:
                if len(batch) == 0:
                    continue
                bins, labels = _unpack(batch["bins"], width), batch["label"].to_numpy()
                drawn = _drawn(batch["id"].to_numpy(), batch["n"].to_numpy(), trees)
                for t, (tree, slots, nodes) in shared.value.items():
                    place = np.full(len(tree[0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[_walk(tree, bins)]
                    held = np.flatnonzero((at >= 0) & (drawn[:, t] > 0))
                    at, weights, kinds = at[held], drawn[held, t], labels[held]
                    for j in range(chosen.shape[1]):
                        cell = (at * BINS + bins[held, chosen[slots, j][at]]) * channels
                        size = len(slots) * BINS * channels
                        part = np.bincount(cell + kinds, weights, size) + np.bincount(cell + classes, minlength=size)
                        sums[slots, j] += part.reshape(len(slots), BINS, channels)
            yield pd.DataFrame({"slot": np.arange(len(large), dtype=np.int32), "hist": [s.tobytes() for s in sums]})

        def best(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            slot = int(key[0])
            hist = sum(np.frombuffer(p).reshape(-1, BINS, channels) for p in parts["hist"])
            gain, cut = _best_cut(hist[:, :, :classes], min_rows)
            j = int(gain.argmax())
            left, right = hist[j, : cut[j] + 1].sum(axis=0), hist[j, cut[j] + 1 :].sum(axis=0)
            found = (
                slot, int(chosen[slot, j]), int(cut[j]), float(gain[j]), int(left[classes]), int(right[classes]),
                left[:classes].tobytes(), right[:classes].tobytes(),
            )
            return pd.DataFrame([found], columns=[c.split()[0] for c in _SPLIT.split(", ")])

        sent = rows.select("id", "bins", "label", "n").mapInPandas(histograms, "slot int, hist binary")
        for r in sent.groupBy("slot").applyInPandas(best, _SPLIT).collect():
            t, node = large[r["slot"]]
            grown[t].split(node, r)
        shared.unpersist()

    def _finish(self, rows: DataFrame, grown: list[_Tree], width: int, total: int) -> list[tuple[np.ndarray, ...]]:
        """Grow what is below every open node in a group of its own."""
        classes, trees, min_rows, seed, depth = self.classes, self.trees, self.min_rows, self.seed, self.depth
        spark = rows.sparkSession
        walks = {t: (tree.arrays(), list(tree.open)) for t, tree in enumerate(grown) if tree.open}
        depths = {(t, node): d for t, tree in enumerate(grown) for node, (_, d) in tree.open.items()}
        shared, started = spark.sparkContext.broadcast(walks), spark.sparkContext.broadcast(depths)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) == 0:
                    continue
                bins, packed, labels = _unpack(batch["bins"], width), batch["bins"].to_numpy(), batch["label"].to_numpy()
                drawn = _drawn(batch["id"].to_numpy(), batch["n"].to_numpy(), trees)
                sent, size = [], 0
                for t, (tree, nodes) in shared.value.items():
                    still = np.zeros(len(tree[0]), bool)
                    still[nodes] = True
                    at = _walk(tree, bins)
                    held = np.flatnonzero(still[at] & (drawn[:, t] > 0))
                    sent.append(pd.DataFrame({
                        "tree": np.int32(t), "node": at[held].astype(np.int32), "label": labels[held],
                        "weight": drawn[held, t], "bins": packed[held],
                    }))
                    size += len(held) * (width + 20)
                    if size > GROUP_CELLS:
                        yield pd.concat(sent)
                        sent, size = [], 0
                if sent:
                    yield pd.concat(sent)

        def grow(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
            t, node = int(key[0]), int(key[1])
            feature, cut, gain, value = _grow(
                _unpack(members["bins"], width), members["label"].to_numpy().astype(np.int64), members["weight"].to_numpy().astype(float),
                classes, depth - started.value[t, node], min_rows, np.random.default_rng([seed, t, node]),
            )
            packed = (feature.tobytes(), cut.tobytes(), gain.astype(np.float32).tobytes(), value.astype(np.float32).tobytes())
            return pd.DataFrame([(t, node, *packed)], columns=[c.split()[0] for c in _SUBTREE.split(", ")])

        dealt = rows.select("id", "bins", "label", "n").mapInPandas(deal, "tree int, node int, label int, weight long, bins binary")
        tasks = max(min(len(depths), spark.sparkContext.defaultParallelism), math.ceil(total * trees * (width + 20) / TASK_BYTES), 1)
        subtrees: list[dict[int, tuple]] = [{} for _ in grown]
        for r in dealt.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(grow, _SUBTREE).collect():
            subtrees[r["tree"]][r["node"]] = (
                np.frombuffer(r["feature"], np.int32), np.frombuffer(r["cut"], np.uint8),
                np.frombuffer(r["gain"], np.float32), np.frombuffer(r["value"], np.float32).reshape(-1, classes),
            )
        shared.unpersist()
        started.unpersist()
        return [tree.joined(below, classes) for tree, below in zip(grown, subtrees)]


class ForestModel(Model):
    """Adds ``probability``, the mean of the leaves' class shares, and ``prediction``."""

    def __init__(self, grown: list[tuple[np.ndarray, ...]], cuts: list[np.ndarray], width: int, classes: int):
        super().__init__()
        self.cuts, self.width, self.classes = cuts, width, classes
        self.trees = []
        importance = np.zeros(width)
        for feature, cut, left, gain, value in grown:
            share = value / np.maximum(value.sum(axis=1, keepdims=True), 1)
            self.trees.append((feature, cut, left, share))
            inner = feature >= 0
            each = np.bincount(feature[inner], gain[inner], width)
            importance += each / max(each.sum(), MIN_GAIN)
        self.importance = importance / max(importance.sum(), MIN_GAIN)

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.importance)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees, self.cuts))
        classes = self.classes

        @F.pandas_udf("array<double>")
        def score(cells: pd.Series) -> pd.Series:
            if len(cells) == 0:
                return pd.Series([], dtype=object)
            trees, cuts = shared.value
            bins = _binned(np.stack(cells.to_numpy()), cuts)
            total = np.zeros((len(bins), classes))
            for feature, cut, left, share in trees:
                total += share[_walk((feature, cut, left), bins)]
            return pd.Series(list(total / len(trees)))

        scored = dataset.withColumn("probability", array_to_vector(score(vector_to_array("features"))))
        shares = vector_to_array("probability")
        return scored.withColumn("prediction", (F.array_position(shares, F.array_max(shares)) - 1).cast("double"))
